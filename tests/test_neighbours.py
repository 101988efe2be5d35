"""The nearest-neighbour graph against exact search: recall, and the share of rows that a search meets."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.operators import neighbours as nb
from graphloom.operators import search as se


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")


def test_recall_and_rows_met(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    rows = centres[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    v = vectors(spark, rows).repartition(4)
    q = v.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    lists = nb.neighbour_graph(v)
    sizes = {r["count"] for r in lists.groupBy("id").count().collect()}
    assert lists.select("id").distinct().count() == 3000 and sizes == {24}  # every row is indexed
    top, met = nb.graph_search(lists, v, q, 10)
    got, want = ({(r.q_id, r.id) for r in x.collect()} for x in (top, se.cosine_top(v, q, 10)))
    assert len(got & want) >= 0.9 * len(want)
    assert met.count() < 0.15 * 3000 * 30 and met.select("q_id", "id").distinct().count() == met.count()


def test_few_and_awkward_rows(spark):
    rows = [[1.0, 0.0], [1.0, 0.0], [0.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]
    v = vectors(spark, rows).unionAll(spark.createDataFrame([(9, None), (10, [1.0])], "id long, v array<double>"))
    q = spark.createDataFrame([(0, [1.0, 0.1])], "q_id long, q array<double>")
    top, _ = nb.graph_search(nb.neighbour_graph(v), v, q, 3)
    assert [(r.rank, r.id) for r in top.orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 3)]
    assert nb.neighbour_graph(v.limit(0)).collect() == []
    assert {(r.id, r.near) for r in nb.neighbour_graph(v.where("id < 1")).collect()} == set()


def test_a_group_tells_what_can_enter_a_list_only():
    """Few rows leave the rounds' groups once lists are full; with no bound all of them do."""
    rng = np.random.default_rng(4)
    run, _ = nb._meet("bigint", 8)
    rows = {"id": pa.array(range(40)), "v": pa.array(rng.standard_normal((40, 6)).astype(np.float32).tolist(), pa.list_(pa.float32()))}
    every = run(pa.table(rows)).to_pylist()
    least = [0.5 if k % 2 else -3.0 for k in range(40)]
    some = run(pa.table(rows | {"least": pa.array(least)})).to_pylist()
    assert some == [r for r in every if r["score"] >= least[r["id"]]] and len(some) < len(every) == 320
