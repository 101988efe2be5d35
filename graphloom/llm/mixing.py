"""Mixing sources to target weights by subset-sum budget fitting.

Sources get targets by weight, held to ``most`` times what they have.  A source's target is a budget fitted from its
histogram of exact document lengths, each document counting up to ``most`` times: an even share of every length first,
then a bounded-knapsack dynamic program over what is left, so the sum lands on the budget or next to it.  A length's
takes are spread evenly over its documents; who gets one more than others is selected by a seeded hash.  Histograms
have a row per distinct length, whatever the number of documents; a hot length is ranked in ``BUCKETS`` parts, of which
only one needs its rows in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, fresh, materialise

BUCKETS = 1024
DP_BUDGET = 16_384  # words the dynamic program fits; a larger remainder is first brought down by whole documents
WEIGHTS = (1.0, 2.0, 3.0)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each length to take so that their sizes sum as near to ``budget`` as can be."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    take = np.minimum(counts, (counts * min(1.0, budget / total)).astype(np.int64))
    rest = budget - int((lengths * take).sum())
    order = np.argsort(-lengths)
    for i in order:  # down to what the program fits
        if rest <= dp_budget:
            break
        n = min(int(counts[i] - take[i]), (rest - dp_budget // 2) // int(lengths[i])) if lengths[i] else 0
        if n > 0:
            take[i] += n
            rest -= n * int(lengths[i])
    if rest <= 0:
        return take
    unit = -(-rest // dp_budget)  # above 1 only where every length left is too long for the program: then in such units
    rest = round(rest / unit)
    limit = (1 << (2 * rest + 1)) - 1
    reach, steps = 1, []
    for i in order[::-1]:
        size, left = round(int(lengths[i]) / unit), int(counts[i] - take[i])
        left = min(left, 2 * rest // size if size else 0)
        part = 1
        while left > 0 and not reach >> rest & 1:
            n = min(part, left)
            steps.append((i, n, n * size, reach))
            reach = (reach | reach << n * size) & limit
            left -= n
            part *= 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    best = below if not above or rest - below <= (above & -above).bit_length() else rest + (above & -above).bit_length()
    for i, n, size, before in reversed(steps):
        if not before >> best & 1:
            take[i] += n
            best -= size
    return take


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) with ``target``: weights by code point order of the source, null last, share all words;
    a target stops at ``most`` times its source's size and the excess is shared again by weight until none is above.

    The order is a distributed sort; the shares are found in rounds of one aggregate each."""
    s = materialise(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    ends = {r[0]: r[1] for r in s.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*")).collect()}  # a row per partition
    starts, seen = [], 0
    for p in sorted(ends):
        starts.append((p, seen))
        seen += ends[p]
    start = F.lit(0)
    for p, n in starts:
        start = F.when(F.shiftright("at", 33) == p, n).otherwise(start)
    place = start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    s = s.withColumn("weight", weight)
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > most * F.col("source_size")
        r = s.agg(F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not r[1]:
            break
        new = (total - (r[0] or 0.0)) / r[1]
        if level is not None and new <= level:
            break
        level = new
    target = F.col("weight") * F.lit(float(level or 0.0))
    return s.select("source", "source_size", F.least(target, most * F.col("source_size")).cast("double").alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7, row_col: str | None = None) -> DataFrame:
    """Per row: row (``row_col``, else null), id, source, text_hash, size, source_size, target, copies (how often the mix takes it).

    Null or empty text has size 0 and is never taken.  Null sources are one source.  Repeated rows are rows of their
    own.  Reruns agree: the order within a length is a hash of seed, id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.size(F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))).cast("long")
    number = F.col(row_col) if row_col else F.lit(None).cast("long")
    rows = docs.select(number.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("text_hash"), size.alias("size"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("text_hash")))
    rows = materialise(rows.withColumn("bucket", F.pmod(F.col("draw"), F.lit(BUCKETS)).cast("int")), "sizes")
    held = materialise(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "lengths")
    lengths = held.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = materialise(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "targets")
    goals = goals.select(F.col("source").alias("goal_source"), "source_size", "target")
    hist = lengths.where("size > 0").join(goals, _same("source", "goal_source")).select("source", "size", "n", F.round("target").cast("long").alias("budget"))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("size")
        n = p["n"].to_numpy()
        take = fit(p["size"].to_numpy(), n * int(most), int(p["budget"].iloc[0]))
        return p[["source", "size"]].assign(base=take // n, extra=take % n)

    takes = materialise(hist.groupBy("source").applyInPandas(solve, "source string, size long, base long, extra long").select(F.col("source").alias("t_source"), F.col("size").alias("t_size"), "base", "extra"), "takes")
    # One more for the first few of a length: buckets in turn get it whole, not at all, or, one of them, in part.
    seen = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quota = held.join(takes, _same("source", "t_source") & (F.col("size") == F.col("t_size"))).withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - seen)))
    quota = materialise(quota.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("bucket").alias("q_bucket"), "base", "quota", ((F.col("quota") > 0) & (F.col("quota") < F.col("n"))).alias("part")), "quota")
    j = rows.join(quota, _same("source", "q_source") & (F.col("size") == F.col("q_size")) & (F.col("bucket") == F.col("q_bucket")), "left")
    j = j.select("row", "id", "source", "text_hash", "size", "bucket", "draw", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("quota", F.lit(0)).alias("quota"), F.coalesce("part", F.lit(False)).alias("part"))
    ranked = j.where("part").withColumn("rn", F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("draw", "id", "row")))
    both = j.where("not part").withColumn("rn", F.lit(1)).unionAll(ranked)
    more = (F.col("quota") > 0) & (~F.col("part") | (F.col("rn") <= F.col("quota")))
    out = both.join(goals, _same("source", "goal_source"))
    return out.select("row", "id", "source", "text_hash", "size", "source_size", "target", (F.col("base") + more.cast("int")).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as the mix takes it."""
    row, copies, turn = fresh(docs, "row_", "copies_", "turn_")
    # Written down with a number for every row, so that each finds its own copies again, however often rows repeat.
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows", "zstd")
    m = mix(rows, id_col, source_col, text_col, row_col=row, **how).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    return rows.join(m, row).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
