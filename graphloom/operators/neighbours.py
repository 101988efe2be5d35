"""A nearest-neighbour graph as an index: built by descent rounds, searched by hops, for many queries at once.

Building.  Rows are ordered along a few random directions and each block of neighbours in such an order is compared with
itself; that gives every row a first list.  In a descent round the rows of each list, and those whose lists name it, meet:
neighbours of a row are likely neighbours of each other.  A list keeps the best ``k``.  Every row is indexed, and the lists are a
table (id, near, score).

Searching.  A query begins at a fixed set of rows and goes on from the best rows it has met to the rows of their lists,
until the best ``breadth`` have all been left.  A hop is a join of all queries' fronts with the lists and the vectors; what a query has
met is a table of its own, so the rows touched can be counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..plans.lineage import materialise, materialise_telling, release
from .graph import places
from .search import _matrix


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _meet(id_type: str, most: int):
    """Each row's best ``most`` others in one bounded group of (id, v); with (id, v, least) those at ``least`` or nearer only,
    as no others can enter the row's list."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").combine_chunks()
        widths = pc.fill_null(pc.list_value_length(t.column("v").combine_chunks()), 0).to_numpy(zero_copy_only=False)
        u = _unit(_matrix(t.column("v"), int(widths.max(initial=0))))
        c = u @ u.T
        np.fill_diagonal(c, -2)
        m = min(most, len(ids) - 1)
        at = np.argpartition(-c, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(ids), 0), np.int64)
        rows, at = np.repeat(np.arange(len(ids)), m), at.ravel()
        if "least" in t.column_names:
            enters = c[rows, at] >= t.column("least").to_numpy()[rows] - 1e-9  # a score's last digits depend on its group
            rows, at = rows[enters], at[enters]
        return pa.table({"id": ids.take(pa.array(rows)), "near": ids.take(pa.array(at)), "score": pa.array(c[rows, at])})

    return run, f"id {id_type}, near {id_type}, score double"


def _kept(vectors: DataFrame) -> str:
    """Floats stay floats, which halves what is shuffled; scores are computed from them as doubles."""
    return "array<float>" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"


def _best(lists: DataFrame, key: str, k: int) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc("score"), "near" if key == "id" else "id")
    return lists.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= k).drop("n_")


def neighbour_graph(vectors: DataFrame, k: int = 24, rounds: int = 8, directions: int = 6, block: int = 256, seed: int = 1) -> DataFrame:
    """(id, near, score): the best ``k`` found of every row of ``vectors`` (id, v), by cosine.

    Groups that meet in a task hold ``block`` rows, or ``k`` neighbours and ``k`` that name the row: no group grows with the
    table.  Null vectors and those with nulls are at no angle to anything; ids are taken as distinct."""
    v = materialise(vectors.select("id", F.col("v").cast(_kept(vectors)).alias("v")), "vectors")
    run, schema = _meet(v.schema["id"].dataType.simpleString(), k)
    dims = v.agg(F.max(F.size("v"))).first()[0] or 0
    first = None
    for d in range(directions):
        axis = np.random.default_rng(seed + d).normal(size=max(dims, 1))
        along = F.aggregate(F.zip_with("v", F.array(*map(F.lit, axis.tolist())), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        placed = places(v.select("id", along.alias("x")), [F.col("x"), F.col("id")])
        groups = placed.select("id", F.expr(f"place div {block}").alias("g")).join(v, "id")
        found = groups.groupBy("g").applyInArrow(run, schema)
        first = found if first is None else first.unionAll(found)
    lists = materialise(_best(first.dropDuplicates(["id", "near"]), "id", k), "lists")
    for _ in range(rounds):
        full = F.when(F.count("*") == k, F.min("score"))
        least = lists.groupBy("id").agg(full.alias("least"))
        named = _best(lists, "near", k).select(F.col("near").alias("g"), "id")
        groups = lists.select(F.col("id").alias("g"), F.col("near").alias("id")).unionAll(named).unionAll(v.select(F.col("id").alias("g"), "id")).distinct().join(v.join(least, "id", "left").fillna(-3.0, ["least"]), "id")
        found = groups.groupBy("g").applyInArrow(_meet(v.schema["id"].dataType.simpleString(), 8)[0], schema)
        new = lists.select("id", "near", "score", F.lit(1).alias("old")).unionAll(found.withColumn("old", F.lit(0))).groupBy("id", "near").agg(F.max("score").alias("score"), F.max("old").alias("old"))
        new, told = materialise_telling(_best(new, "id", k), "lists", fresh=F.count_if(F.col("old") == 0), n=F.count("*"))
        release(lists)
        lists = new.select("id", "near", "score")
        lists._written_at = new._written_at
        if told["fresh"] <= told["n"] / 500:
            break
    return lists


def graph_search(lists: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, breadth: int = 48, step: int = 8, starts: int = 128, degree: int = 16) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest found for each query (q_id, q), with rank, and all that the search met: (q_id, id, score, left).

    ``starts`` rows, the same for all queries, are met first (their number is the bound of what is broadcast); then each hop
    leaves the best ``step`` rows not yet left among a query's best ``breadth``, and meets the first ``degree`` of their lists and
    the rows that name them so."""
    v = vectors.select("id", F.col("v").cast(_kept(vectors)).alias("v"))
    links = _best(lists, "id", degree).select("id", "near")
    links = materialise(links.unionAll(links.select("near", "id")).distinct(), "links")
    q = materialise(queries.select("q_id", F.col("q").cast("array<double>").alias("q")), "queries")
    begin = F.broadcast(v.orderBy(F.xxhash64("id")).limit(starts))
    met = q.join(begin).select("q_id", "id", s.cosine(F.col("v").cast("array<double>"), F.col("q")).alias("score"), F.lit(False).alias("left"))
    met = materialise(met, "met")
    order = W.partitionBy("q_id").orderBy(F.desc("score"), "id")
    while True:
        ranked = met.withColumn("n_", F.row_number().over(order))
        open_ = ranked.where((F.col("n_") <= breadth) & ~F.col("left")).withColumn("o_", F.row_number().over(order)).where(F.col("o_") <= step)
        front, told = materialise_telling(open_.select("q_id", "id"), "front", n=F.count("*"))
        if not told["n"]:
            break
        seen = met.select("q_id", "id")
        new = front.join(links, "id").select("q_id", F.col("near").alias("id")).distinct().join(seen, ["q_id", "id"], "left_anti")
        new = new.join(v, "id").join(q, "q_id").select("q_id", "id", s.cosine(F.col("v").cast("array<double>"), F.col("q")).alias("score"), F.lit(False).alias("left"))
        gone = front.withColumn("now_", F.lit(True))
        kept = met.join(gone, ["q_id", "id"], "left").select("q_id", "id", "score", (F.col("left") | F.coalesce("now_", F.lit(False))).alias("left"))
        after = materialise(kept.unionAll(new), "met")
        release(met, front)
        met = after
    top = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "id", "score", "rank")
    return top, met
