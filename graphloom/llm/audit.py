"""What filters remove alone and together: every order of five filters, per part of a corpus.

Duplicates are found by sorting: rows are range-sorted by a fingerprint of their text and their id, sorted inside a
partition by fingerprint, whole text and id, and compared with their predecessor.  A run of equal texts may begin in an
earlier partition; so the rows of a partition's first fingerprint stay open, every partition tells the texts of its first
and last fingerprints with their least id, and that small table decides the open rows.  Which filters a row fails is then a mask
of five bits.  Counts by mask add up, and the counts of every order and step come from them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed

# The filters' letters; a document fails A below MIN_WORDS words, B below a share of distinct words, C above a
# share of capital letters, D with any of the symbols, E as a copy of an earlier document.
LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BIT = {c: 1 << i for i, c in enumerate(LETTERS)}


def own_failures(text: bytes, chars: int) -> int:
    """The mask of A to D for a text in UTF-8 with ``chars`` code points.  bytes.split() parts at the words' six spaces."""
    words = text.split()
    n = len(words)
    mask = BIT["A"] if n < MIN_WORDS else 0
    if 100 * len(set(words)) < MIN_DISTINCT * n:
        mask |= BIT["B"]
    if 100 * (len(text) - len(text.translate(None, CAPITALS))) > MAX_CAPITALS * chars:
        mask |= BIT["C"]
    if len(text.translate(None, SYMBOLS)) < len(text):
        mask |= BIT["D"]
    return mask


SCHEMA = "id long, part string, mask int, state string, fp long, digest binary"


@trimmed
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with their masks.  state: done, or open where E awaits earlier partitions; edge rows
    tell a text of the partition's first or last fingerprint and its least id."""
    import pyarrow.compute as pc

    first = fp = text = least = None
    mask = 0
    runs: list[tuple[int, bytes, int | None]] = []  # the texts of the present fingerprint and their least ids

    def edges() -> pa.RecordBatch:
        kept = [(f, hashlib.sha256(t).digest(), i) for f, t, i in runs if i is not None]
        n = len(kept)
        cols = [[i for _, _, i in kept], [None] * n, [0] * n, ["edge"] * n, [f for f, _, _ in kept], [d for _, d, _ in kept]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            b = batch.slice(at, 1024)
            chars = pc.utf8_length(b.column(3)).to_pylist()
            raw = b.column(3).cast(pa.binary()).to_pylist()
            ids, fps, parts = (b.column(k).to_pylist() for k in (0, 2, 1))
            masks, states, digests = [], [], []
            for i, f, t, c in zip(ids, fps, raw, chars):
                if f != fp:
                    if fp is not None and fp == first:
                        yield edges()
                    first = f if fp is None else first
                    runs, text, fp = [], None, f
                if t != text:
                    text, least, mask = t, None, own_failures(t, c)
                    runs.append((f, t, None))
                if least is None and i is not None:
                    least = i
                    runs[-1] = (f, t, i)
                copy = i is not None and least < i
                masks.append(mask | BIT["E"] if copy else mask)
                is_open = f == first and not copy and i is not None
                states.append("open" if is_open else "done")
                digests.append(hashlib.sha256(t).digest() if is_open else None)
            cols = [pa.array(ids, TYPES[0]), pa.array(parts, TYPES[1]), pa.array(masks, TYPES[2]), pa.array(states, TYPES[3])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps, TYPES[4]), pa.array(digests, TYPES[5])], names=NAMES)
    if fp is not None:
        yield edges()


NAMES = ["id", "part", "mask", "state", "fp", "digest"]
TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]


def failure_masks(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """Columns id, part, mask (one bit per filter failed, A the lowest), one row for each row of ``docs``.

    A null text is an empty one, a null part the empty string.  Repeated rows are rows of their own; equal ids are not
    smaller than each other, so they are no copies of each other.  A null id is smaller than none and none is smaller than it.
    Other columns are left aside, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.alias("text"))
    ranged = rows.repartitionByRange(F.col("fp"), F.col("id")).sortWithinPartitions("fp", "text", "id")
    seen = materialise(ranged.mapInArrow(_compare, SCHEMA), "audit", "zstd")
    least = seen.where("state = 'edge'").groupBy("fp", "digest").agg(F.min("id").alias("least"))
    late = seen.where("state = 'open'").join(least, ["fp", "digest"], "left")
    late = late.select("id", "part", F.when(F.col("least") < F.col("id"), F.col("mask").bitwiseOR(BIT["E"])).otherwise(F.col("mask")).alias("mask"))
    return seen.where("state = 'done'").select("id", "part", "mask").unionAll(late)


def mask_counts(masks: DataFrame, good: DataFrame, toxic: DataFrame) -> DataFrame:
    """Additive counters: part, mask, n, good, toxic.  ``good`` and ``toxic`` are ids (one column ``id``, repeats and nulls
    allowed).  Rows of one id, part and mask are counted before they meet the labels: no id is hot."""
    marks = good.select("id", F.lit(1).alias("g"), F.lit(0).alias("t")).unionAll(toxic.select("id", F.lit(0).alias("g"), F.lit(1).alias("t")))
    marks = marks.where("id is not null").groupBy("id").agg(F.max("g").alias("g"), F.max("t").alias("t"))
    met = masks.groupBy("id", "part", "mask").count().join(marks, "id", "left")
    by = lambda c: F.coalesce(F.sum(F.col("count") * F.col(c)), F.lit(0)).alias({"g": "good", "t": "toxic"}[c])
    return met.groupBy("part", "mask").agg(F.sum("count").alias("n"), by("g"), by("t"))


def _passing(of: str) -> Column:
    """By every set of filters, as a mask: how many rows pass all of it."""
    return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(of)).otherwise(0)) for s in range(1 << len(LETTERS))])


def interactions(counts: DataFrame) -> DataFrame:
    """All orders and steps from ``mask_counts``: columns part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.  A part has a row for each of the 600, zeros included; no parts, no rows."""
    n_all = len(LETTERS)
    orders = ["".join(p) for p in itertools.permutations(LETTERS)]
    parts = counts.groupBy("part").agg(
        _passing("n").alias("n"), _passing("good").alias("g"), _passing("toxic").alias("t"),
        F.array(*[F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)) for b in BIT.values()]).alias("alone"),
    )
    # A filter's removals over all orders: each set of filters before it stands first in (size)! (rest)! orders.
    fact = [1, 1, 2, 6, 24, 120]
    shapley = []
    for b in BIT.values():
        terms = [(s, fact[s.bit_count()] * fact[n_all - 1 - s.bit_count()]) for s in range(1 << n_all) if not s & b]
        shapley.append(sum(((F.col("n")[s] - F.col("n")[s | b]) * w for s, w in terms[1:]), (F.col("n")[0] - F.col("n")[b]) * terms[0][1]))
    parts = parts.withColumn("shapley_of", F.array(*shapley))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, n_all + 1)])))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), b).otherwise(0) for c, b in BIT.items()), F.lit(0))
    rows = rows.withColumns({"f": F.instr(F.lit(LETTERS), letter) - 1, "before": before})
    rows = rows.withColumn("after", F.col("before") + F.array(*[F.lit(b) for b in BIT.values()])[F.col("f")])
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")]
    fails = F.col("n")[0] - F.col("n")[F.col("after") - F.col("before")]
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), F.col("n")[F.col("after")].alias("kept"), lost("n").alias("removed"),
        (fails - lost("n")).alias("redundant"), F.col("alone")[F.col("f")].alias("unique_fails"), lost("g").alias("good_lost"), lost("t").alias("toxic_lost"),
        F.col("shapley_of")[F.col("f")].alias("shapley"),
    )


def audit(docs: DataFrame, good: DataFrame, toxic: DataFrame, **cols) -> DataFrame:
    """The whole audit of ``docs``: see ``failure_masks``, ``mask_counts`` and ``interactions``."""
    return interactions(mask_counts(failure_masks(docs, **cols), good, toxic))
