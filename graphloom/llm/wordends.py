"""Token ids by a public BPE vocabulary with word ends, for many texts at once.

Units of text repeat, so work is done once for each: Arrow numbers the words of a chunk, Python looks at its distinct words,
a bounded memory at their units (letter runs, digits, symbol runs), and the library's BPE model at new units only.  The
ids of whole texts are then put together by Arrow's take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

KNOWN = 1_000_000  # units remembered; beyond them only those of the last chunk are
# Fixed value: how the vocabulary cuts lower-case text into units; the line end parts words here.
UNITS = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Words that the library encodes itself: control characters and spaces beyond ASCII's, letters beyond U+024F (normal forms, case
# rules and classes that depend on the version of Unicode) and U+0130, and the beginning of an added token's string.
ODD = r"[\x00-\x1f\x7f-\x{a0}\x{130}\x{250}-\x{10ffff}]|<\|"
MIXED = r"['0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}]"  # words with numbers or apostrophes: UNITS cuts them
SYMBOLS = r"([^\p{L}]+)"  # in all other words, what is no letter
END = "</w>"
_encoders: dict[str, "WordEnds"] = {}


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and where each text's begin in it."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words, at = lists.flatten(), lists.offsets.to_numpy()
    at = at - at[0]
    empty = pc.equal(words, "")
    if pc.any(empty).as_py():  # the one word of an empty text
        full = pc.invert(empty)
        at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[at]
        words = words.filter(full)
    return words, at


def _joined(parts: pa.BinaryArray, at: np.ndarray) -> pa.BinaryArray:
    """Neighbouring values put together: value k is those from at[k] to at[k + 1]."""
    offsets = np.frombuffer(parts.buffers()[1], "<i4")[parts.offset : parts.offset + len(parts) + 1][at]
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), parts.buffers()[2]])


class WordEnds:
    """Encodes texts as the library with this file does (no special tokens added), as little-endian ids of ``dtype``.

    Exact for files whose normaliser is NFC, space runs to one space, lower case, and whose units are UNITS: white space never
    stands in a unit, so the ids of a text are those of its words put together."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tok.model)  # takes units already cut, in the printable stand-ins of bytes
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tok.get_vocab()
        top = max(vocab.values())
        self.dtype = np.dtype("<u2" if top <= 65535 else "<u4")
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.stand_in = {b: chr(256 + i) for i, b in enumerate(hidden)} | {32: " "}
        self.known = pa.array([], pa.string())
        self.known_ids = pa.array([], pa.binary())

    def _model(self, units: list[str]) -> pa.BinaryArray:
        """The ids of new units, by the library's model: each ends with the one id whose token has a word end."""
        found = [np.zeros(0, self.dtype)]
        for at in range(0, len(units), 4096):
            text = " ".join(units[at : at + 4096]).encode().decode("latin-1").translate(self.stand_in)
            found.append(np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype))
        ids = np.concatenate(found)
        offsets = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]) * self.dtype.itemsize
        assert len(offsets) == len(units) + 1
        return pa.BinaryArray.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids)])

    def _units(self, units: pa.Array) -> pa.BinaryArray:
        """The ids of all units, each looked up or encoded once."""
        numbered = units.dictionary_encode()
        names = numbered.dictionary
        at = pc.index_in(names, value_set=self.known)
        new = names.filter(at.is_null())
        place = at.to_numpy(zero_copy_only=False).astype(float)
        place[np.isnan(place)] = len(self.known) + np.arange(len(new))
        ids = pa.concat_arrays([self.known_ids, self._model(new.to_pylist())])
        mine = ids.take(pa.array(place.astype(np.int64)))
        if len(ids) > KNOWN:
            self.known, self.known_ids = names, mine
        elif len(new):
            self.known, self.known_ids = pa.concat_arrays([self.known, new]), ids
        return mine.take(numbered.indices)

    def _words(self, words: pa.Array) -> pa.BinaryArray:
        """The ids of each of the distinct ``words``."""
        odd = pc.match_substring_regex(words, ODD)
        mixed = pc.and_not(pc.match_substring_regex(words, MIXED), odd)
        plain = pc.invert(pc.or_(odd, mixed))
        low = pc.utf8_lower(words.filter(plain))
        units, at = _split(pc.replace_substring_regex(low, SYMBOLS, " \\1 "))
        parts = [_joined(self._units(units), at)]
        listed = words.filter(mixed).to_pylist()
        if listed:
            units = UNITS.findall("\n".join(listed).lower())
            stops = np.flatnonzero(np.fromiter((u == "\n" for u in units), bool, len(units)))
            at = np.concatenate([[0], stops - np.arange(len(stops)), [len(units) - len(stops)]])
            parts.append(_joined(self._units(pa.array([u for u in units if u != "\n"], pa.string())), at))
        whole = words.filter(odd).to_pylist()
        if whole:
            parts.append(pa.array([np.asarray(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(whole, add_special_tokens=False)], pa.binary()))
        kind = mixed.to_numpy(zero_copy_only=False) + 2 * odd.to_numpy(zero_copy_only=False)
        if len(parts) == 1:
            return parts[0]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.argsort(kind, kind="stable"))))

    def encode(self, texts: pa.Array) -> pa.BinaryArray:
        """The ids of each text, null counting as empty."""
        words, at = _split(pc.fill_null(texts, "").cast(pa.string()))
        if len(words) == 0:
            return pa.array([b""] * len(texts), pa.binary())
        numbered = words.dictionary_encode()
        return _joined(self._words(numbered.dictionary).take(numbered.indices), at)


def word_ends(path: str) -> WordEnds:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEnds(path)
    return _encoders[path]
