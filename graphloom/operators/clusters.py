"""Greedy clusters that depend on the order of their items, in rounds of joins.

Items are walked in order; each one that is still free opens a cluster, which takes free items after it.  Neither walk is
sequential in what it decides: an item's cluster depends on similar items before it only, so all items whose
predecessors are decided go in one round.  ``pairs`` (a, b) are similar items with a before b; null ends, repeated pairs
and pairs of an item with itself count for nothing.  An item without pairs is a cluster of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise, materialise_telling, release


def _pairs(pairs: DataFrame) -> DataFrame:
    return materialise(pairs.select("a", "b").where("a < b").distinct(), "pairs")


def chain_clusters(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, seed) for items (id): an item joins the first cluster that holds an item similar to it and before it.

    That cluster's seed is the least item that steps to earlier similar items can reach.  A round passes seeds one step
    on and follows each item's seed to the seed of that; rounds end when none moves (the longest chain bounds them)."""
    p = _pairs(pairs)
    label = materialise(p.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("seed", F.col("id")), "seeds")
    while True:
        near = p.join(label.select(F.col("id").alias("a"), "seed"), "a").groupBy(F.col("b").alias("id")).agg(F.min("seed").alias("near"))
        far = label.select(F.col("id").alias("seed"), F.col("seed").alias("far"))
        moved = label.join(near, "id", "left").join(far, "seed")
        moved = moved.select("id", F.least("near", "far", "seed").alias("new"), "seed")
        done, told = materialise_telling(moved.select("id", F.col("new").alias("seed"), (F.col("new") < F.col("seed")).alias("moves")), "seeds", moves=F.sum(F.col("moves").cast("long")))
        release(label)
        label = done.drop("moves")
        label._written_at = done._written_at
        if not told["moves"]:
            break
    release(p)
    return items.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


def star_clusters(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, seed) for items (id): a free item opens a cluster of the free items similar to it itself.

    The seeds are the first maximal set of items of which no two are similar.  A round makes seeds of the open items that
    no open item before them is similar to, closes the items that these take, and keeps the pairs of open items.  An item
    belongs to the first seed before it that is similar."""
    p = _pairs(pairs)
    rest, released = p, False
    open_, told = materialise_telling(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "open", n=F.count("*"))
    rounds = []
    while told["n"]:
        seeds = materialise(open_.join(rest.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "seeds")
        rounds.append(seeds)
        taken = rest.join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        before, had = open_, rest
        open_, told = materialise_telling(before.join(seeds.unionAll(taken), "id", "left_anti"), "open", n=F.count("*"))
        rest = materialise(had.join(open_.select(F.col("id").alias("a")), "a", "left_semi").join(open_.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"), "pairs")
        release(before)
        if released:
            release(had)
        released = True
    known = items.select("id").distinct()
    if not rounds:
        return known.withColumn("seed", F.col("id"))
    seeds = reduce(DataFrame.unionAll, rounds)
    first = p.join(seeds.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("seed"))
    return known.join(first, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


def named(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """(name, canonical) of clusters (id, seed) over names (id, name, n): every name becomes the most frequent of its
    cluster, of equally frequent ones the first by name."""
    c = clusters.join(names, "id")
    best = c.groupBy("seed").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("canonical"))
    return c.join(best, "seed").select("name", "canonical")
