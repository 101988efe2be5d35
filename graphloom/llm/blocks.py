"""Blocks and shards: how operators look corpus-wide keys up without a row per key and document.

Documents are handled in blocks of bounded text, each with a number that is written down with it.  A block sends the
distinct keys it holds (n-grams, anchors, windows) to shards by hash, one row of packed arrays per block and shard; a
shard joins what all blocks sent and answers each block about its own keys, element by element.  Shards are as many as
the text asks for, so a shard stays bounded.

A block sends at most ``FAN`` rows.  Where more shards are needed, what blocks sent to one of ``FAN`` groups is put
together into bundles of bounded size, in which equal keys merge, and bundles ask on like blocks do, one digit of the
hash a level, as deep as the number of shards asks for; answers come back the same way.  So rows grow in proportion to
the text (times its logarithm), and a key that is frequent, even in a third of all documents, is one entry per bundle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20  # of text for one shard
FAN = 256  # rows that a block or bundle sends at most
BUNDLE = 2_000_000  # keys that are put together at once, or a little more
ROW = "block long, kind int, shard long, a binary, b binary, c binary, d binary"
_NAMES = ["block", "kind", "shard", "a", "b", "c", "d"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]


def shards_for(docs: DataFrame, text_col: str = "text") -> int:
    """Number of shards by the bytes of text: one aggregate over the text column's lengths."""
    n = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(4, -(-n // SHARD_BYTES))


def depth_and_fan(shards: int, fan: int = FAN) -> tuple[int, int]:
    """Levels of the tree of groups, and groups a level, for at least ``shards`` leaves."""
    depth = 1
    while fan**depth < shards:
        depth += 1
    return depth, min(fan, math.ceil(shards ** (1 / depth) - 1e-9))


def rows(items: list[tuple]) -> pa.RecordBatch:
    """A batch of ROW from tuples of its columns; missing last columns are null."""
    full = [tuple(x) + (None,) * (7 - len(x)) for x in items]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in full], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def table(items: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows(items)])


def cells(t: pa.Table) -> list[dict]:
    return t.to_pylist()


def pack(x: np.ndarray, level: int = 1) -> bytes:
    """Compressed bytes, those of equal weight together."""
    import zstandard

    x = np.ascontiguousarray(x)
    if x.itemsize > 1:
        x = np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T)
    return zstandard.ZstdCompressor(level=level).compress(x.tobytes())


def unpack(b: bytes, dtype: str) -> np.ndarray:
    import zstandard

    raw, size = zstandard.ZstdDecompressor().decompress(b), np.dtype(dtype).itemsize
    if size > 1:
        raw = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).tobytes()
    return np.frombuffer(raw, dtype=dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def by_shard(hashes: np.ndarray, shards: int, level: int = 0) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its hashes) for every shard that gets any; deeper levels go by further digits of the hash."""
    s = (hashes // np.uint64(shards**level) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(s, kind="stable")
    cuts = np.flatnonzero(np.diff(s[order])) + 1
    return [(int(s[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def gather(batches, size_of, limit: int = BLOCK_BYTES):
    """Lists of rows (as tuples) from record batches, each list up to about ``limit`` bytes of text."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 128):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 128).columns)):
                held.append(row)
                n += size_of(row) + 64
                if n >= limit:
                    yield held
                    held, n = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class Question:
    """What blocks ask about their keys, which are distinct within a block.

    takes: types of the arrays sent, up to three, the keys first.  gives: types of the arrays that come back.
    answer: from arrays and the block of each element to arrays.  merge: from the same to (arrays, blocks, place of each
    element among them), equal keys made one.  back: from the merged ones' answers, that place, and whether an element
    leads its key and is its key's only one, to the elements' answers.  spread: evenly spread hashes of the keys."""

    kind: int
    takes: tuple[str, ...]
    gives: tuple[str, ...]
    answer: Callable
    merge: Callable
    back: Callable
    spread: Callable = lambda keys: keys

    def send(self, block: int, arrays: list[np.ndarray], fan: int) -> list[tuple]:
        """The rows that carry a block's keys, in ``order`` of the groups."""
        return [(block, self.kind, s, *self._packed([x[p] for x in arrays], self.takes)) for s, p in self.order(arrays[0], fan)]

    def order(self, keys: np.ndarray, fan: int) -> list[tuple[int, np.ndarray]]:
        """(group, places of its keys): answers to a group's row are in the order of these places."""
        return by_shard(self.spread(keys), fan)

    def given(self, row: dict) -> list[np.ndarray]:
        """The arrays of an answer."""
        return [unpack(row[c], t) for c, t in zip("abc", self.gives)]

    def _packed(self, arrays: list[np.ndarray], types: tuple[str, ...]) -> list[bytes | None]:
        out = [pack(np.asarray(x, t)) for x, t in zip(arrays, types)]
        return out + [None] * (3 - len(out))

    def ask(self, held: DataFrame, shards: int, fan: int = FAN, bundle: int = BUNDLE) -> DataFrame:
        """Answers to the rows of ``held`` that bear this kind, as ROW: the block, the kind negated, the group."""
        depth, fan = depth_and_fan(shards, fan)
        return self._ask(held.where(F.col("kind") == self.kind), depth, fan, 0, bundle)

    def _ask(self, sent: DataFrame, depth: int, fan: int, level: int, bundle: int) -> DataFrame:
        if level == depth - 1:
            return sent.groupBy("shard").applyInArrow(trimmed(lambda t: self._answer(t)), ROW)

        @trimmed
        def put_together(batches):
            pid, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

            def emit():
                nonlocal seq, held, n
                name, seq = (pid << 24) + seq, seq + 1
                out = self._bundle(name, held, fan, level)
                held, n = [], 0
                return rows(out)

            for b in batches:
                for r in cells(pa.Table.from_batches([b])):
                    if held and (r["shard"] != held[0]["shard"] or n >= bundle):
                        yield emit()
                    held.append(r)
                    n += len(unpack(r["a"], self.takes[0]))
            if held:
                yield emit()

        # Dealt by group and some of the block's number, so groups are not the bound of how many tasks share the work.
        dealt = sent.repartition(F.col("shard"), F.pmod(F.xxhash64("block"), F.lit(64))).sortWithinPartitions("shard")
        bundles = materialise(dealt.mapInArrow(put_together, ROW), "bundles")
        answers = self._ask(bundles.where(F.col("kind") == self.kind), depth, fan, level + 1, bundle)
        return bundles.where("kind = 0").unionAll(answers).groupBy("block").applyInArrow(self._unbundle(fan, level), ROW)

    def _read(self, sent: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Arrays put together, the block of each element, and the elements in each row."""
        parts = [[unpack(r[c], t) for r in sent] for c, t in zip("abc", self.takes)]
        sizes = np.array([len(x) for x in parts[0]], np.int64)
        owners = [unpack(r["d"], "<i8") if r["d"] is not None else np.full(n, r["block"], np.int64) for r, n in zip(sent, sizes)]
        return [np.concatenate(x) for x in parts], np.concatenate(owners), sizes

    def _answer(self, t: pa.Table) -> pa.Table:
        sent = cells(t)
        arrays, owners, sizes = self._read(sent)
        cuts = np.cumsum(sizes)[:-1]
        parts = zip(*(np.split(np.asarray(x, g), cuts) for x, g in zip(self.answer(arrays, owners), self.gives)))
        return table([(r["block"], -self.kind, r["shard"], *self._packed(list(p), self.gives)) for r, p in zip(sent, parts)])

    def _bundle(self, name: int, sent: list[dict], fan: int, level: int) -> list[tuple]:
        arrays, owners, sizes = self._read(sent)
        merged, merged_owners, place = self.merge(arrays, owners)
        leads = np.zeros(len(place), bool)
        lead = np.lexsort((owners != merged_owners[place], place))  # of a key's elements, the one whose block it bears
        leads[lead[np.r_[True, np.diff(place[lead]) > 0]]] = True
        head = np.array([[r["block"], r["shard"], n] for r, n in zip(sent, sizes)], "<i8")
        out = [(name, 0, -1, pack(head), pack(place.astype("<i4")), pack(np.packbits(leads)), pack(merged[0]))]
        group = sent[0]["shard"]
        for s, p in by_shard(self.spread(merged[0]), fan, level + 1):
            out.append((name, self.kind, group * fan + s, *self._packed([x[p] for x in merged], self.takes), pack(merged_owners[p].astype("<i8"))))
        return out

    def _unbundle(self, fan: int, level: int):
        @trimmed
        def run(t: pa.Table) -> pa.Table:
            got = cells(t)
            own = next(r for r in got if r["kind"] == 0)
            head, place = unpack(own["a"], "<i8").reshape(-1, 3), unpack(own["b"], "<i4")
            keys = unpack(own["d"], self.takes[0])
            leads = np.unpackbits(unpack(own["c"], "u1"))[: len(place)] > 0
            answers = [np.zeros(len(keys), g) for g in self.gives]
            by_group = {r["shard"] % fan: self.given(r) for r in got if r["kind"] == -self.kind}
            for s, p in by_shard(self.spread(keys), fan, level + 1):
                for whole, part in zip(answers, by_group[s]):
                    whole[p] = part
            outs = self.back(answers, place, leads, np.bincount(place, minlength=len(keys))[place] == 1)
            cuts = np.cumsum(head[:, 2])[:-1]
            parts = zip(*(np.split(np.asarray(x, g), cuts) for x, g in zip(outs, self.gives)))
            return table([(b, -self.kind, s, *self._packed(list(p), self.gives)) for (b, s, _), p in zip(head.tolist(), parts)])

        return run


def sums(kind: int, key: str, spread: Callable) -> Question:
    """The sums over all blocks of two counts that each block sends with a key."""

    def added(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        known, place = np.unique(arrays[0], return_inverse=True)
        return known, place, [np.bincount(place, x, minlength=len(known)).astype("<i8") for x in arrays[1:]]

    def answer(arrays: list[np.ndarray], blocks: np.ndarray) -> list[np.ndarray]:
        _, place, n = added(arrays)
        return [x[place] for x in n]

    def merge(arrays: list[np.ndarray], blocks: np.ndarray):
        known, place, n = added(arrays)
        return [known, *n], np.zeros(len(known), np.int64), place

    return Question(kind, (key, "<i8", "<i8"), ("<i8", "<i8"), answer, merge, lambda got, place, leads, alone: [x[place] for x in got], spread)


def recurring(kind: int) -> Question:
    """Whether a 64-bit key was sent by two blocks, or by one that says that it holds it twice."""

    def twice(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, place, n = np.unique(arrays[0], return_inverse=True, return_counts=True)
        return known, place, (n > 1) | (np.bincount(place, arrays[1], minlength=len(known)) > 0)

    def answer(arrays: list[np.ndarray], blocks: np.ndarray) -> list[np.ndarray]:
        _, place, more = twice(arrays)
        return [more[place]]

    def merge(arrays: list[np.ndarray], blocks: np.ndarray):
        known, place, more = twice(arrays)
        return [known, more.astype("u1")], np.zeros(len(known), np.int64), place

    return Question(kind, ("<u8", "u1"), ("u1",), answer, merge, lambda got, place, leads, alone: [got[0][place]])


def first_holders(kind: int, second: str) -> Question:
    """For keys of two parts sent with a rank: whether another block holds the key, and whether one of smaller rank
    does (among equals: of smaller number)."""

    def grouped(arrays: list[np.ndarray], blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements by key, rank and block, and whether each begins a key."""
        order = np.lexsort((blocks, arrays[2], arrays[1], arrays[0]))
        new = np.ones(len(order), bool)
        new[1:] = (arrays[0][order][1:] != arrays[0][order][:-1]) | (arrays[1][order][1:] != arrays[1][order][:-1])
        return order, new

    def answer(arrays: list[np.ndarray], blocks: np.ndarray) -> list[np.ndarray]:
        order, new = grouped(arrays, blocks)
        later, others = np.zeros(len(order), bool), np.zeros(len(order), bool)
        later[order] = ~new
        others[order] = ~new | ~np.append(new[1:], True)
        return [others, later]

    def merge(arrays: list[np.ndarray], blocks: np.ndarray):
        order, new = grouped(arrays, blocks)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        lead = order[new]
        return [x[lead] for x in arrays], blocks[lead], place

    def back(got: list[np.ndarray], place: np.ndarray, leads: np.ndarray, alone: np.ndarray) -> list[np.ndarray]:
        return [(got[0][place] > 0) | ~alone, (got[1][place] > 0) | ~leads]

    return Question(kind, ("<u8", second, "<i8"), ("u1", "u1"), answer, merge, back)
