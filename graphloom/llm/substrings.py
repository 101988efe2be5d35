"""Substring deduplication with repeated-phrase automata.

1. Candidates.  Every document names anchors: the smallest-hashed ``GRAM``-word phrase in each window (equal windows
   name equal anchors).  Shards find the anchors that recur over all blocks; every window that recurs names one, so
   only windows that do are candidates.
2. Confirmation.  Candidate windows go to shards by a 96-bit hash of their words; a shard tells each block which of its
   windows recur and which start earlier elsewhere.  Whole texts that repeat an earlier text are confirmed by a 128-bit
   hash of all their words instead.
3. Automata.  A block writes down each of its windows at one place only, the first.  Runs of confirmed windows there
   that follow each other wherever they occur in the block are its passages.  They are compiled into Aho-Corasick automata
   over words, sharded so that each holds at most ``PATTERN_WORDS`` words.
4. Streaming.  All documents of the block, copies included, run through the automata.  Where else a window occurs is
   known from these matches alone; of each passage's windows the first occurrence stays and the others' words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import materialise, trimmed

GRAM = 8
RUN = 64  # windows of one pattern: longer passages are several, so a place ends at most as many matches
PATTERN_WORDS = 200_000  # words of one automaton's patterns
DIGITS = 3  # characters of a coded word
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _rolling(h: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of ``width`` word hashes, at its start; runs double, so a few passes suffice."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, total = 0, np.zeros(n, np.uint64)
    part, size = h, 1  # hashes of runs of ``size`` words
    with np.errstate(over="ignore"):
        todo = width
        while todo:
            if todo & 1:
                total = total * np.uint64(pow(int(odd), size, 1 << 64)) + part[done : done + n]
                done += size
            todo >>= 1
            if todo:
                part = part[: len(part) - size] * np.uint64(pow(int(odd), size, 1 << 64)) + part[size:]
                size *= 2
    return B.mix64(total)


def _slide(x: np.ndarray, span: int, pick) -> np.ndarray:
    """Least or greatest of each ``span`` neighbours, at the first of them."""
    size = 1
    while 2 * size <= span:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return pick(x[: len(x) - (span - size)], x[span - size :]) if span > size else x


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words in each text (joined by one space), all words in turn as numbers, and the words by number."""
    some = np.array([len(t) > 0 for t in texts], bool)
    split = pc.split_pattern(pa.array([t for t in texts if t], pa.binary()), b" ")
    sizes = np.zeros(len(texts), np.int64)
    sizes[some] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    words = split.flatten().dictionary_encode()
    return sizes, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


class Texts:
    """The documents of a block as one run of words, distinct texts only once.

    docs: bytes of the words of each document joined by one space; keep: which of them to look into."""

    def __init__(self, docs: list[bytes], keep: np.ndarray, width: int) -> None:
        self.places = np.flatnonzero(keep)
        self.sizes, self.ids, words = numbered([docs[i] for i in self.places])
        self.known = words.to_pylist()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.h1 = self.hashes(1)
        room = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.ids))
        self.window_ok = room >= width

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word."""
        import xxhash

        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w, seed) for w in self.known), np.uint64, len(self.known))[self.ids]

    def anchors(self, width: int) -> np.ndarray:
        """Word places of the anchors: in each window, the phrases of smallest hash."""
        g = self.grams = _rolling(self.h1, GRAM, _ODD[0])
        span = width - GRAM + 1
        n = len(self.h1) - width + 1
        if n <= 0 or not self.window_ok.any():
            return np.empty(0, np.int64)
        self.least = _slide(g, span, np.minimum)  # the anchor that each window names
        low = np.where(self.window_ok[:n], self.least, np.uint64(0))
        pad = np.zeros(span - 1, np.uint64)
        return np.flatnonzero(_slide(np.concatenate([pad, low, pad]), span, np.maximum) == g)


def bound(cand: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """Of each window number below ``n``, whether it follows one and the same window wherever it occurs, and that one is
    followed by it wherever it occurs: the two are in one passage.  cand: places of windows, rising; number: of each."""
    nxt, prv = np.full(len(cand), -1, np.int64), np.full(len(cand), -1, np.int64)
    beside = np.flatnonzero(np.diff(cand) == 1)  # neighbours are of one document: its last words start no window
    nxt[beside], prv[beside + 1] = number[beside + 1], number[beside]
    order = np.argsort(number, kind="stable")
    begin = np.flatnonzero(np.diff(number[order], prepend=-1))
    only = lambda x: np.where(np.minimum.reduceat(x[order], begin) == np.maximum.reduceat(x[order], begin), x[order][begin], -1)
    after, before = only(nxt), only(prv)
    return (before >= 0) & (after[before] == np.arange(n))


def passages(confirmed: np.ndarray, width: int, tight: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(word place, words) of the runs of confirmed windows, long ones in pieces of ``RUN`` windows.

    ``confirmed``: at each word place, the number of the confirmed window that starts there, or -1.  ``tight``: of each
    number, whether its window goes on the passage of the one before it; None: all do."""
    at = np.flatnonzero(confirmed >= 0)
    if not len(at):
        return []
    parts = np.diff(at) > 1
    if tight is not None:
        parts |= ~tight[confirmed[at[1:]]]
    cuts = np.flatnonzero(parts)
    out = []
    for s, e in zip(at[np.r_[0, cuts + 1]].tolist(), at[np.r_[cuts, len(at) - 1]].tolist()):
        out += [(p, min(RUN, e - p + 1) + width - 1) for p in range(s, e + 1, RUN)]
    return out


def compile_automaton(patterns: dict[str, int]):
    """An Aho-Corasick automaton of coded passages; None without patterns."""
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for text, number in patterns.items():
        a.add_word(text, number)
    if not len(a):
        return None
    a.make_automaton()
    return a


def occurrences(ids: np.ndarray, found: list[tuple[int, int]], stream: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``stream``, place in ``ids``, words) of every occurrence of the passages ``found`` in ``ids``.

    ids, stream: words as numbers below ``known``; -1 in ``stream`` stands between documents.  To an automaton a word is
    ``DIGITS`` characters, each from an alphabet of its own, so its nodes have few children and characters suffice for
    any number of words; words that no pattern holds are one and the same."""
    hits: list[tuple[int, int]] = []
    lengths = np.array([n for _, n in found], np.int64)
    starts = np.array([p for p, _ in found], np.int64)
    shard = np.cumsum(lengths) // PATTERN_WORDS
    for k in np.unique(shard).tolist() if found else []:
        mine = np.flatnonzero(shard == k)
        used = np.unique(np.concatenate([ids[starts[i] : starts[i] + lengths[i]] for i in mine.tolist()]))
        base = max(2, int(np.ceil(len(used) ** (1 / DIGITS))))
        code = np.zeros((known + 1, DIGITS), "<u2")  # the last one stands for -1
        rest = np.arange(len(used))
        for digit in range(DIGITS):
            code[used, digit] = 1 + digit * base + rest % base
            rest //= base
        text = lambda x: code[x].tobytes().decode("utf-16-le")
        a = compile_automaton({text(ids[starts[i] : starts[i] + lengths[i]]): i for i in mine.tolist()})
        if a is not None:
            hits += a.iter(text(stream))
    if not hits:
        return (np.empty(0, np.int64),) * 3
    ends, which = np.array(hits, np.int64).T
    return (ends + 1) // DIGITS - lengths[which], starts[which], lengths[which]


class Block:
    """A block's documents as runs of word numbers: each distinct text once (ids), and all documents in turn (stream).

    Documents are in the order of their ranks.  text_of: of each document, the place of its text among the distinct."""

    def __init__(self, docs: list[bytes], width: int) -> None:
        self.width, self.docs = width, docs
        place: dict[bytes, int] = {}
        self.text_of = np.array([place.setdefault(d, len(place)) for d in docs], np.int64)
        self.texts = list(place)
        self.copies = np.bincount(self.text_of, minlength=len(place))
        self.sizes, self.ids, words = numbered(self.texts)
        self.known = len(words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        runs = [x for t in self.text_of.tolist() for x in (self.ids[self.starts[t] : self.starts[t] + self.sizes[t]], _GAP)]
        self.stream = np.concatenate(runs) if runs else np.empty(0, np.int64)
        n = self.sizes[self.text_of]
        self.doc_starts = np.cumsum(n + 1) - n - 1

    def covered(self, windows: np.ndarray, later: np.ndarray, earlier: np.ndarray, tight: np.ndarray | None = None) -> list[np.ndarray]:
        """Per document the places of its windows that also start earlier.

        windows: at one word place of ``ids`` for each recurring window, its number, else -1.  later: of each number,
        whether it starts earlier in another block.  earlier: of each text, whether another block has an earlier copy
        of it.  tight: as in ``passages``."""
        whole, copied_here = np.full((2, len(windows)), -1, np.int64)
        fresh = len(later)
        for t in np.flatnonzero((earlier | (self.copies > 1)) & (self.sizes >= self.width)).tolist():
            s, e = int(self.starts[t]), int(self.starts[t] + self.sizes[t] - self.width + 1)
            if earlier[t]:
                whole[s:e] = 0
            else:  # copies within the block: their windows recur, whether shards were asked about them or not
                copied_here[s:e] = fresh + np.arange(e - s)
                fresh += e - s
        located = np.full(len(self.stream), -1, np.int64)
        self._locate(copied_here, located)
        self._locate(windows, located, tight)  # the numbers that shards know count before those of copies
        n = np.diff(np.append(self.doc_starts, len(self.stream)))
        copied = np.repeat(earlier[self.text_of], n) if len(n) else np.empty(0, bool)
        located[copied] = -1
        again = np.full(len(self.stream), -1, np.int64)
        self._locate(whole, again)
        gone = copied & (again >= 0)
        at = np.flatnonzero(located >= 0)
        first = np.unique(located[at], return_index=True)[1]
        stays = np.zeros(len(at), bool)
        stays[first] = True
        outside = np.zeros(fresh, bool)
        outside[: len(later)] = later
        gone[at[~stays | outside[located[at]]]] = True
        return [np.flatnonzero(x) for x in np.split(gone, self.doc_starts[1:])] if len(self.docs) else []

    def _locate(self, windows: np.ndarray, out: np.ndarray, tight: np.ndarray | None = None) -> None:
        """Write the numbers of ``windows`` to all places of ``out`` at which the automata find them."""
        to, of, words = occurrences(self.ids, passages(windows, self.width, tight), self.stream, self.known)
        n = words - self.width + 1
        if len(n):
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to, n) + step] = windows[np.repeat(of, n) + step]


_GAP = np.array([-1], np.int64)


def _load(r: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A block's documents, ids and which ids are null."""
    meta = B.unpack(r["b"], "<i8").reshape(-1, 3)
    raw = B.unpack(r["a"], "u1").tobytes()
    ends = np.cumsum(meta[:, 2]).tolist()
    return [raw[s:e] for s, e in zip([0, *ends], ends)], meta[:, 0], meta[:, 1] == 1


def _wholes(texts: list[bytes]) -> np.ndarray:
    """128-bit hashes of texts as pairs of 64 bits."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh128_digest, texts)), "<u8").reshape(-1, 2)


ANCHORS, WHOLES, WINDOWS = B.recurring(1), B.first_holders(2, "<u8"), B.first_holders(5, "<u4")


def repeated_spans(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, fan: int = B.FAN, bundle: int = B.BUNDLE, shards: int | None = None) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the text that is left) and removed (spans of word places, end excluded).

    A word goes if a window of ``width`` words that covers it also starts earlier: in a document of smaller id, or in
    the same one.  Integer ids; ids that are no integers count as null, null ids come last.  Null text has no words.
    Of rows with equal ids, one comes first."""
    shards = shards or B.shards_for(docs, text_col)
    _, groups = B.depth_and_fan(shards, fan)
    top = (1 << 63) - 1
    rank_of = lambda i: top if i is None else i

    @trimmed
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        for got in B.gather(batches, lambda r: len(r[1] or ""), block_bytes):
            block, seq = (pid << 24) + seq, seq + 1
            got.sort(key=lambda r: rank_of(r[0]))
            texts = [b" ".join((r[1] or "").encode().split()) for r in got]
            meta = np.array([[0 if r[0] is None else r[0], r[0] is None, len(t)] for r, t in zip(got, texts)], "<i8")
            out = [(block, 0, -1, B.pack(np.frombuffer(b"".join(texts), "u1"), 4), B.pack(meta))]
            whole, first = np.unique(_wholes(texts), axis=0, return_index=True)
            fresh = np.zeros(len(texts), bool)
            fresh[first] = True
            t = Texts(texts, fresh, width)
            at = t.anchors(width)
            if len(at):
                keys, times = np.unique(t.grams[at], return_counts=True)
                out += ANCHORS.send(block, [keys, times > 1], groups)
            ranks = np.array([rank_of(got[i][0]) for i in first.tolist()], "<i8")
            yield B.rows(out + WHOLES.send(block, [whole[:, 0], whole[:, 1], ranks], groups))

    held = materialise(docs.select(F.expr(f"try_cast(`{id_col}` as bigint)").alias(id_col), text_col).mapInArrow(send, B.ROW), "anchors")

    @trimmed
    def candidates(t: pa.Table) -> pa.Table:
        got = B.cells(t)
        own = next(r for r in got if r["kind"] == 0)
        docs_, ids, none = _load(own)
        hot = {r["shard"]: r for r in got if r["kind"] == -ANCHORS.kind}
        known = {r["shard"]: r for r in got if r["kind"] == -WHOLES.kind}
        whole, first = np.unique(_wholes(docs_), axis=0, return_index=True)
        fresh = np.zeros(len(docs_), bool)
        fresh[first] = True
        t_ = Texts(docs_, fresh, width)
        at = t_.anchors(width)
        known_hot = np.empty(0, np.uint64)
        if len(at):
            keys = np.unique(t_.grams[at])
            known_hot = np.concatenate([keys[p][ANCHORS.given(hot[s])[0] > 0] for s, p in ANCHORS.order(keys, groups)])
        earlier = np.zeros(len(docs_), bool)
        for s, p in WHOLES.order(whole[:, 0], groups):
            earlier[first[p]] = WHOLES.given(known[s])[1] > 0
        texts_earlier = earlier[t_.places]
        out = [(own["block"], 6, -1, B.pack(texts_earlier.astype("u1")))]
        n = len(t_.h1) - width + 1
        cand = np.empty(0, np.int64)
        if len(known_hot):
            doc = np.repeat(np.arange(len(t_.sizes)), t_.sizes)
            cand = np.flatnonzero(t_.window_ok[:n] & ~texts_earlier[doc[:n]])
            cand = cand[np.isin(t_.least[cand], known_hot)]
        if len(cand):
            k1, k2 = _rolling(t_.h1, width, _ODD[1])[cand], (_rolling(t_.hashes(2), width, _ODD[2])[cand] >> np.uint64(32)).astype("<u4")
            order = np.lexsort((k2, k1))  # stable: the first occurrence in the block leads its number
            new = np.ones(len(cand), bool)
            new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
            number = np.empty(len(cand), np.int64)
            number[order] = np.cumsum(new) - 1
            lead = order[new]
            ranks = np.where(none, top, ids)[t_.places[doc[cand[lead]]]]
            out += WINDOWS.send(own["block"], [k1[lead], k2[lead], ranks], groups)
            groups_of = [p for _, p in WINDOWS.order(k1[lead], groups)]
            back = np.empty(len(lead), np.int64)
            back[np.concatenate(groups_of)] = np.arange(len(lead))  # windows are numbered in the order of the answers
            ends = np.cumsum([len(p) for p in groups_of])
            which = [s for s, _ in WINDOWS.order(k1[lead], groups)]
            place = np.sort(lead)
            local = np.stack([np.diff(cand[place], prepend=0), back[number[place]]]).astype("<i4")
            told = np.stack([np.bincount(back[number]) > 1, bound(cand, back[number], len(lead))])
            out[0] = (*out[0], B.pack(local), B.pack(np.stack([which, ends]).astype("<i8")), B.pack(np.packbits(told, axis=1)))
        return B.table(out)

    replies = ANCHORS.ask(held, shards, fan, bundle).unionAll(WHOLES.ask(held, shards, fan, bundle))
    sent = materialise(held.where("kind = 0").unionAll(replies).groupBy("block").applyInArrow(candidates, B.ROW), "windows")

    @trimmed
    def cut(t: pa.Table) -> pa.Table:
        got = B.cells(t)
        docs_, ids, none = _load(next(r for r in got if r["kind"] == 0))
        mine = next(r for r in got if r["kind"] == 6)
        block = Block(docs_, width)
        windows, later, tight = np.full(len(block.ids), -1, np.int64), np.empty(0, bool), None
        if mine["b"] is not None:
            cand, number = B.unpack(mine["b"], "<i4").reshape(2, -1)
            which, ends = B.unpack(mine["c"], "<i8").reshape(2, -1)
            recurs, tight = np.unpackbits(B.unpack(mine["d"], "u1").reshape(2, -1), axis=1)[:, : ends[-1]] > 0  # recurs: within the block
            later = np.zeros(ends[-1], bool)
            answers = {r["shard"]: WINDOWS.given(r) for r in got if r["kind"] == -WINDOWS.kind}
            for s, a, b in zip(which.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                recurs[a:b] |= answers[s][0] > 0
                later[a:b] = answers[s][1] > 0
            windows[np.cumsum(cand)] = np.where(recurs[number], number, -1)
        gone = block.covered(windows, later, B.unpack(mine["a"], "u1") > 0, tight)
        n_words, n_removed, kept, spans = [], [], [], []
        for d, n, p in zip(docs_, block.sizes[block.text_of].tolist(), gone):
            s = []
            if len(p):
                breaks = np.flatnonzero(np.diff(p) > width)
                s = list(zip(p[np.r_[0, breaks + 1]].tolist(), (p[np.r_[breaks, len(p) - 1]] + width).tolist()))
                w, left, last = d.split(), [], 0
                for a, b in s:
                    left += w[last:a]
                    last = b
                d = b" ".join(left + w[last:])
            n_words.append(n)
            n_removed.append(sum(b - a for a, b in s))
            kept.append(d.decode())
            spans.append([{"start": a, "end": b} for a, b in s])
        return pa.table({
            id_col: pa.array(ids, mask=none), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        })

    parts = held.where("kind = 0").unionAll(sent.where("kind = 6")).unionAll(WINDOWS.ask(sent, shards, fan, bundle))
    return parts.groupBy("block").applyInArrow(cut, f"`{id_col}` long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")
