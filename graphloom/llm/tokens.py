"""Token ids by a public byte-level BPE vocabulary, and the cutting of documents into pieces."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed

CACHE_WORDS = 60_000  # words a worker remembers in each of two generations; more of them save no time
CACHE_CHARS = 64  # longer words are encoded each time
# Fixed value: how byte-level BPE cuts texts into units.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_SAFE_CUT = re.compile(r" (?=\S)")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes whole texts through the library, word by word.

    Byte-level BPE never merges across the boundary before a space that a non-space follows (its pre-tokenizer starts
    a new unit there), so the ids of a text are the ids of its space-led words put together.  Words repeat: each is
    remembered in a cache of two generations of bounded size.  Texts that hold the string of an added token, which the
    library takes for the token, go through the library whole.  New words are encoded many in one string and cut apart
    at the ids that begin with the space, of which each word has one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)  # ids whose token begins with the space, written U+0120
        self.leads[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.many = self._merger(path, vocab)

    def _merger(self, path: str, vocab: dict[str, int]):
        """Encodes a string of many new words.  Where the file's merges stand in the order of their ids, the ids are
        ranks and a faster merge loop over the same vocabulary gives the same ids; else the library itself does it."""
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        at = [vocab.get(a + b, -1) for a, b in merges]
        if model.get("type") == "BPE" and at and at == sorted(at) and at[0] == 256 and len(set(at)) == len(at):
            import tiktoken

            # The printable stand-ins of bytes: themselves where they print, else code points from 256 on.
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i <= at[-1] and all(c in byte for c in t)}
            enc = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return enc.encode_ordinary
        return lambda text: self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _learn(self, new: set[str]) -> list[str]:
        """Make ``new`` words known; which of them are long or hold spaces."""
        seen = new.intersection(self.older)
        self.known.update(zip(seen, map(self.older.__getitem__, seen)))
        fresh = new - seen
        odd = [w for w in fresh if len(w) > CACHE_CHARS or " " in w] if fresh else []
        for w in odd:
            self.known[w] = self._ids(" " + w)
        fresh = list(fresh.difference(odd))
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            ids = np.asarray(self.many(" " + " ".join(part)), dtype="<u4")
            cuts = np.flatnonzero(self.leads[ids]) * 4
            assert len(cuts) == len(part)
            raw, cuts = ids.tobytes(), [*cuts.tolist(), 4 * len(ids)]
            self.known.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        return odd

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text; null counts as empty."""
        whole = {i: self._ids(t) for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        texts = ["" if i in whole else t or "" for i, t in enumerate(texts)]
        parts = [_SAFE_CUT.split(t) if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        rest = [p[1:] for p in parts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        new = set().union(*rest).difference(self.known)
        odd = self._learn(new)
        out = [(self._ids(p[0]) if p[0] else b"") + b"".join(map(self.known.__getitem__, r)) for p, r in zip(parts, rest)]
        for i, ids in whole.items():
            out[i] = ids
        for w in odd:
            if len(w) > CACHE_CHARS:
                self.known.pop(w, None)
        return out


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of each row's ids followed by ``separator``; rows longer than ``capacity`` are cut, and then only the
    first piece may be shorter.  Null or empty text: one piece that holds the separator.  Repeated rows give repeated
    pieces.  Columns: ``id_col``, piece, start, length, ids_crc32 and, with ``keep_ids``, ids."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sep = np.asarray([separator], dtype="<u4").tobytes()

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                src, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, raw_ids in enumerate(enc.encode_many(texts.slice(at, 256).to_pylist()), at):
                    b = memoryview(raw_ids + sep)
                    n = len(b) // 4
                    first = n % capacity or capacity
                    for k, s in enumerate([0, *range(first, n, capacity)]):
                        e = first if k == 0 else s + capacity
                        src.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(b[4 * s : 4 * e]))
                        if keep_ids:
                            raw.append(np.frombuffer(b[4 * s : 4 * e], dtype="<u4").astype("int32"))
                cols = [ids.take(pa.array(src, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(raw, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)
