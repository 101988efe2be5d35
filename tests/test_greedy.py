"""Greedy clusters against walks over lists; substring postings against scans."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clusters
from graphloom.operators import postings
from graphloom.operators.postings import Postings


def walk(n, near, whole):
    """The walk as it is told: ``whole`` holds candidates against all members, else against the seed."""
    seed = {}
    for a in range(n):
        if a in seed:
            continue
        seed[a], members = a, [a]
        for b in range(n):
            if b not in seed and any(frozenset((m, b)) in near for m in (members if whole else [a])):
                seed[b] = a
                members.append(b)
    return seed


@pytest.mark.parametrize("k", range(3))
def test_random_graphs(spark, k):
    rnd = random.Random(k)
    n = 60
    near = {frozenset(rnd.sample(range(n), 2)) for _ in range((20, 60, 300)[k])}
    items = spark.range(n)
    pairs = spark.createDataFrame([(min(x), max(x)) for x in near] * 2 + [(None, 1), (3, 3)], "a long, b long")
    for f, whole in ((clusters.chain_clusters, True), (clusters.star_clusters, False)):
        assert {r["id"]: r["seed"] for r in f(items, pairs).collect()} == walk(n, near, whole)


def test_chain_and_no_pairs(spark):
    none = spark.createDataFrame([], "a long, b long")
    line = spark.range(11).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for f in (clusters.chain_clusters, clusters.star_clusters):
        assert sorted(map(tuple, f(spark.range(3), none).collect())) == [(0, 0), (1, 1), (2, 2)]
        assert f(spark.range(0), none).count() == 0
    assert {r["seed"] for r in clusters.chain_clusters(spark.range(12), line).collect()} == {0}
    assert {r["seed"] for r in clusters.star_clusters(spark.range(12), line).collect()} == set(range(0, 12, 2))


def test_names_by_frequency(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, seed long")
    names = spark.createDataFrame([(1, "c", 1), (2, "b", 2), (3, "a", 2), (4, "d", 9)], "id long, name string, n long")
    assert dict(map(tuple, clusters.named(c, names).collect())) == {"c": "a", "b": "a", "a": "a", "d": "d"}


def test_postings_against_a_scan(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abC d") for _ in range(rnd.randrange(12))) for _ in range(300)] + ["", None, "Straße", "x" * 5000]
    rows = spark.createDataFrame([(k, t, rnd.choice(texts)) for k, t in enumerate(texts)], "id long, name string, sig string")
    asked = ["abc", "ABC", "a", " d", "", "bc d", "zzz", "xxxx", None, "raß", "aaaaaaaaaaa"] + [t[1:5] for t in texts[:20]]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    p = Postings(rows, "id", ["name", "sig"])
    got = sorted(map(tuple, p.search(q).collect()))
    data = rows.collect()
    want = sorted((i, r["id"]) for i, s in enumerate(asked) if s is not None for r in data if any(v is not None and s.lower() in v.lower() for v in (r["name"], r["sig"])))
    assert got == want
    for s in asked[:8]:
        assert sorted(r["id"] for r in p.find(s).collect()) == [b for a, b in want if a == asked.index(s)]
    assert "PushedFilters: [In(gram" in p.find("abcab")._jdf.queryExecution().toString() or "PushedFilters: [In(" in p.find("abcab")._jdf.queryExecution().toString()


def test_postings_of_copies_in_parts(spark, monkeypatch):
    """Equal texts and equal queries are met once, and their pairs in parts; counts and grams do not depend on that."""
    monkeypatch.setattr(postings, "PAIRS", 50)
    rows = spark.createDataFrame([(k, ["abcd", "xabcy", None, "zz", "\U0001f600bc"][k % 5], [None, "abc"][k % 2]) for k in range(200)], "id long, name string, sig string")
    q = spark.createDataFrame([(k, ["abc", "BCD", "zz", "", None, "\U0001f600b"][k % 6]) for k in range(60)], "query_id long, query string")
    data, asked = rows.collect(), q.collect()
    want = sorted((a.query_id, r.id) for a in asked if a.query is not None for r in data if any(v is not None and a.query.lower() in v for v in (r.name, r.sig)))
    for copies in (False, True):
        p = Postings(rows, "id", ["name", "sig"], copies)
        assert sorted(map(tuple, p.search(q).collect())) == want
        assert sorted(r.id for r in p.find("bcd").collect()) == [r.id for r in data if r.name == "abcd"]
    assert p.texts.count() == 10 and p.copies.count() == 200


def test_index_is_built_without_a_shuffle_in_one_pass(spark, monkeypatch):
    plans = []
    whole = postings.materialise
    monkeypatch.setattr(postings, "materialise", lambda df, tag, *a: (plans.append((tag, df._jdf.queryExecution().toString())), whole(df, tag, *a))[1])
    p = Postings(spark.createDataFrame([(1, "abc")], "id long, t string"), "id", ["t"])
    assert [r.id for r in p.find("abc").collect()] == [1]
    assert [tag for tag, _ in plans] == ["postings"] and "Exchange" not in plans[0][1]
