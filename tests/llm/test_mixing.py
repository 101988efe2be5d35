from itertools import combinations

import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import mixing
from tests.llm import data


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.floats(0, 1))
def test_fit_is_nearest(sizes, share):
    lengths, counts = np.unique(sizes, return_counts=True)
    budget = int(sum(sizes) * share)
    take = mixing.fit(lengths, counts, budget)
    assert (take <= counts).all() and (take >= 0).all()
    best = min(abs(sum(c) - budget) for k in range(len(sizes) + 1) for c in combinations(sizes, k))
    got = abs(int((take * lengths).sum()) - budget)
    # An even share of every length goes first; what it leaves the program fits as well as the rest allows.
    assert got <= max(best, max(sizes) // 2 + 1)


def test_fit_exact_with_many():
    lengths, counts = np.arange(1, 3000, 7), np.full(429, 40)
    total = int((lengths * counts).sum())
    for share in (0.01, 0.37, 0.999):
        take = mixing.fit(lengths, counts, int(total * share))
        assert int((take * lengths).sum()) == int(total * share)


def brute_targets(sizes, most=3.0):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {k: float(i % 3 + 1) for i, k in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [k for k in names if k not in full]
        if not rest:
            break
        level = (total - sum(most * sizes[k] for k in full)) / sum(w[k] for k in rest)
        more = {k for k in rest if level * w[k] > most * sizes[k]}
        if not more:
            break
        full |= more
    return {k: most * sizes[k] if k in full else w[k] * level for k in names}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, None: 7}, {"é": 5, "z": 500, "a": 0}, {None: 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def nearest(sizes, target, most=3):
    """Least distance of any mix of up to ``most`` copies each."""
    reach = 1
    for s in sizes:
        for _ in range(most):
            reach |= reach << s
    return min(abs(k - target) for k in range(int(3 * sum(sizes)) + 1) if reach >> k & 1)


def test_mix(spark):
    df = data.frame(spark)
    got = mixing.mix(df).collect()
    rows = data.rows()
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(data.words_of(r[1]))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.copies <= 3 and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    for k in want:
        assert abs(taken[k] - want[k]) <= nearest([len(data.words_of(r[1])) for r in rows if r[3] == k], want[k]) + 1
    again = mixing.mix(df.repartition(9)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    n = {}
    for r in mixed.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    per = {}
    for r in got:
        per[r.id] = per.get(r.id, 0) + r.copies
    assert n == {k: v for k, v in per.items() if v}


def test_rows_alike_and_extra_columns(spark):
    rows = [(1, "one two three", "a", 5, 6)] * 7 + [(None, "x y", None, 1, 2)] * 3 + [(2, None, "a", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row_ int, Copies_ int")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter(tuple(r) for r in out.collect())
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.id, r.source] += r.copies
    assert {(k[0], k[2]): n for k, n in got.items()} == {k: n for k, n in want.items() if n}
    assert all(k in rows for k in got)


def test_fit_of_lengths_beyond_the_program():
    lengths, counts = np.array([1_000_003, 2_000_001, 3_500_017]), np.array([3, 3, 3])
    take = mixing.fit(lengths, counts, 5_600_000)
    best = min(abs(5_600_000 - int((lengths * np.array(t)).sum())) for t in itertools.product(range(4), repeat=3))
    assert abs(5_600_000 - int((lengths * take).sum())) <= best + 2000 and (take <= counts).all()


def test_empty(spark):
    assert mixing.mix(data.empty(spark)).collect() == []
    assert mixing.mixed_documents(data.empty(spark)).collect() == []
