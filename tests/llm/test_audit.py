import itertools

import pytest

from graphloom.llm import audit, queries, sql
from tests.llm import data
from tests.oracle import difference


def mask_of(rows):
    out = []
    for r in rows:
        t = r[1] or ""
        w = data.words_of(t)
        m = 1 * (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * sum("A" <= x <= "Z" for x in t) > 5 * len(t)) + 8 * any(x in "#$%&*|" for x in t)
        copy = any((o[1] or "") == t and o[0] is not None and r[0] is not None and o[0] < r[0] for o in rows)
        out.append((r[0], r[3] or "", m + 16 * copy))
    return out


def brute(rows, good, toxic):
    out = []
    masks = mask_of(rows)
    for part in {p for _, p, _ in masks}:
        mine = [(i, m) for i, p, m in masks if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for o in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(o, 1):
                b = 1 << "ABCDE".index(c)
                gone = [x for x in left if x[1] & b]
                left = [x for x in left if not x[1] & b]
                shapley[c] += len(gone)
                lines.append(("".join(o), k, len(left), len(gone), sum(1 for x in mine if x[1] & b) - len(gone), sum(1 for x in mine if x[1] == b), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), c))
        out += [(part, *x[:-1], shapley[x[-1]]) for x in lines]
    return out


def rows():
    out = data.rows(n=30) + data.rows(n=30)[:25]
    out += [(500 + i, "SAME Text & more", None, "hot", 1, 1, "", 1, "", "", 1) for i in range(150)]
    out += [(500, "SAME Text & more", None, "cold", 1, 1, "", 1, "", "", 1), (3, "SAME Text & more", None, "cold", 1, 1, "", 1, "", "", 1)]
    out += [(None, "SAME Text & more", None, "hot", 1, 1, "", 1, "", "", 1)] * 3 + [(900, "", None, "", 1, 1, "", 1, "", "", 1), (901, None, None, None, 1, 1, "", 1, "", "", 1)]
    return out


@pytest.mark.parametrize("parts,aqe", [(1, "true"), (7, "false"), (40, "false")])
def test_masks_across_boundaries(spark, parts, aqe):
    old = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    try:
        df = spark.createDataFrame(rows(), data.SCHEMA).repartition(5)
        got = [tuple(r) for r in audit.failure_masks(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert sorted(got, key=str) == sorted(mask_of(rows()), key=str)


def test_equal_fingerprints_of_unlike_texts(spark):
    """One fingerprint for all texts: comparison and edges go by the whole text."""
    from pyspark.sql import functions as F

    rs = [(i, t, "en", "a", 0, 0, "", 0, "", "", 0) for i, t in enumerate(["x", "y", "x", "z", "y", "x"] * 20)]
    df = spark.createDataFrame(rs, data.SCHEMA).select(F.col("doc_id").alias("id"), F.lit("a").alias("part"), F.lit(5).cast("long").alias("fp"), "text")
    seen = df.repartitionByRange(9, "fp", "id").sortWithinPartitions("fp", "text", "id").mapInArrow(audit._compare, audit.SCHEMA)
    edges = [tuple(r) for r in seen.where("state = 'edge'").select("digest", "id").collect()]
    least = {}
    for d, i in edges:
        least[d] = min(i, least.get(d, i))
    done = {r.id: bool(r["mask"] & 16) for r in seen.where("state = 'done'").collect()}
    done |= {r.id: least[r.digest] < r.id for r in seen.where("state = 'open'").collect()}
    assert done == {i: i > 3 or i == 2 for i in range(120)}


def test_orders(spark):
    df = spark.createDataFrame(rows(), data.SCHEMA).repartition(3)
    good, toxic = [1, 5, 5, 501, 502, None, 77777], [2, 503, 500]
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    got = [tuple(r) for r in audit.audit(df, ids(good), ids(toxic)).collect()]
    want = brute(rows(), {1, 5, 501, 502, 77777}, set(toxic))
    assert sorted(got) == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "id long")
    assert audit.audit(data.empty(spark), none, none).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(queries.op12_filter_interactions(spark, sf), sql.SQL["op12_filter_interactions"], sf) is None
