import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import clustering as c
from graphloom.llm import queries, sql
from tests.oracle import difference

SCHEMA = "vec_id long, embedding array<float>, cluster string, id string, vector int, distance int"


def brute(rows, k, rounds, dims, scale, seed):
    """The contract's words in plain Python."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, x)) for x in cents]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        cents = [[sum(v[p] for v in groups[j]) // len(groups[j]) for p in range(dims)] if j in groups else x for j, x in enumerate(cents)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    return [(i, j, d, inertia[j], sum(inertia.values()), c.digest(cents[j])) for i, j, d in found]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], SCHEMA)
    return [tuple(r) for r in c.clustered(df.repartition(3), **how).collect()]


order = lambda rows: sorted(rows, key=str)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([3, 300, 1 << 20, c.NARROW]), st.integers(1, 9), st.sampled_from([1, 3, 64]))
def test_screening_equals_exact(seed, size, k, dims):
    rng = np.random.default_rng(seed)
    cents = rng.integers(-size, size + 1, (k, dims))
    x = np.concatenate([rng.integers(-size, size + 1, (20, dims)), cents, (cents[:1] + cents[-1:]) // 2, cents // 2])
    x = np.concatenate([x, x + rng.integers(-1, 2, x.shape)]).clip(-size, size)
    best, dist, _ = c.assigned(x, cents.tolist())
    for row, b, d in zip(x.tolist(), best, dist):
        of = [sum((p - q) ** 2 for p, q in zip(row, y)) for y in cents.tolist()]
        assert d == min(of) and b == of.index(d)


def test_ties_take_the_lowest_and_are_computed_exactly():
    cents = np.array([[0, 4], [4, 0], [0, 4]])
    best, exact = c.screened(np.array([[2, 2], [0, 4], [9, 0]]), cents)
    assert best.tolist() == [0, 0, 1] and exact == 2


def test_screening_spares_exact_work():
    rng = np.random.default_rng(1)
    _, exact = c.screened(rng.integers(-300, 300, (5000, 64)), rng.integers(-300, 300, (8, 64)))
    assert exact < 50


@pytest.mark.parametrize("dims", [2, 64])
def test_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    vec = lambda: [float(np.float32(x)) for x in rng.normal(0, 0.2, dims)]
    rows = [(i, vec()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [rows[5], rows[5], (None, vec()), (None, rows[3][1]), (7, vec())]
    rows += [(300, None), (301, []), (302, [1.0] * (dims + 1)), (303, [None] + [1.0] * (dims - 1)), (304, [float("nan")] * dims), (305, [float("inf")] + [0.0] * (dims - 1))]
    how = dict(k=8, rounds=10, dims=dims, scale=1024, seed="3")
    assert order(run(spark, rows, **how)) == order(brute(rows, **how))


def test_huge_components_are_exact(spark):
    rows = [(i, [float(np.float32(s * 10.0**e)), 1.0]) for i, (s, e) in enumerate([(1, 30), (-1, 38), (3, 8), (1, 3), (1, 0), (2, 0), (-3, 38)])]
    how = dict(k=3, rounds=4, dims=2, scale=1024, seed="3")
    want = []
    for i, j, d, a, b, h in brute(rows, **how):
        fit = lambda x: x if x < 1 << 63 else None
        want.append((i, j, fit(d), fit(a), fit(b), h))
    got = run(spark, rows, **how)
    assert order(r[:3] + r[5:] for r in got) == order(r[:3] + r[5:] for r in want)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 4])
def test_few_rows(spark, rows):
    how = dict(k=8, rounds=3, dims=2, scale=1024, seed="3")
    assert order(run(spark, rows, **how)) == order(brute(rows, **how))


def test_limbs():
    for s in (0, 1, -1, 1 << 60, -(1 << 60), (1 << 60) - 1, 12345 << 200, -(98765 << 190) - 3):
        assert sum(v << (c.LIMB * i) for i, v in enumerate(c._limbs(s))) == s and all(-(1 << 63) <= v < 1 << 63 for v in c._limbs(s))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(queries.op11_centroid_clustering(spark, sf), sql.SQL["op11_centroid_clustering"], sf) is None
