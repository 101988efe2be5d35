"""Strong components, cycles, levels and communities against brute force."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.operators import hierarchy as h
from graphloom.operators import structure as st
from graphloom.plans import graphs, lineage
from graphloom.sources import projections as p

SF = "/root/testdata/sf0.001"


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src long, dst long, kind string")


def vertices(spark, ids):
    return spark.createDataFrame([(x, "function") for x in ids], "id long, kind string")


def counted(monkeypatch):
    """The tables written from now on, by tag: a round or two each."""
    calls, real = [], lineage.materialise
    for module in (st, lineage):
        monkeypatch.setattr(module, "materialise", lambda *a: calls.append(a[1]) or real(*a))
    return calls


def reach(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    far = {}
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        far[a] = seen
    return far


def brute_components(pairs):
    pairs = [(a, b) for a, b in pairs if a != b]
    far = reach(pairs)
    out = {}
    for v in far:
        mates = {u for u in far[v] if v in far.get(u, ())}
        if len(mates) > 1:
            out[v] = min(mates)
    return out


def ring(n, start=0):
    return [(start + i, start + (i + 1) % n) for i in range(n)]


def shifted(pairs, by):
    return [(a + by, b + by) for a, b in pairs]


# One graph of several: two rings and a bridge, loops alone, a figure of eight, a short way back, sparse and dense random ones.
PARTS = [
    ring(5) + ring(3, 10) + [(2, 10)], [(1, 1), (2, 2), (1, 2)], ring(4) + [(0, 10), (10, 11), (11, 0)], ring(6) + [(2, 0), (0, 3)],
    [(random.Random(i).randrange(60), random.Random(i + 999).randrange(60)) for i in range(90)], [(random.Random(i).randrange(20), random.Random(i + 99).randrange(20)) for i in range(80)],
]
GRAPH = sorted({e for k, g_ in enumerate(PARTS) for e in shifted(g_, 100 * k)})


def test_components_and_cycles(spark):
    want = brute_components(GRAPH)
    ids = list(range(500))
    random.Random(3).shuffle(ids)
    long = shifted(zip(ids, ids[1:] + ids[:1]), 1000) + [(3000 + i, 1000 + i) for i in range(50)] + [(1000 + i, 4000 + i) for i in range(50)]
    rows = g.cycles(edges(spark, GRAPH + long).repartition(3)).collect()
    assert {r.component for r in rows} == {*want.values(), 1000}  # every component has one
    want |= dict.fromkeys(range(1000, 1500), 1000)
    steps = {*GRAPH, *long}
    for r in rows:
        c = list(r.cycle)
        assert len(set(c)) == len(c) >= 2 and c[0] == min(c) and all(x in steps for x in zip(c, c[1:] + c[:1])) and {want[x] for x in c} == {r.component}
    assert len({tuple(r.cycle) for r in rows}) == len(rows)
    assert [300, 301, 302] in [list(r.cycle) for r in rows] and max(len(r.cycle) for r in rows) == 500  # the shortest way back where near; any length


def test_strong_components(spark):
    assert {r.id: r.component for r in st.strong_components(edges(spark, GRAPH)).collect()} == brute_components(GRAPH)
    assert st.strong_components(edges(spark, [(1, 2), (2, 3), (1, 1)])).collect() == []


def test_ten_cycles_are_reported(spark):
    pairs = [x for k in range(12) for x in ring(3 + k % 2, 100 * k)]
    assert [len(r.cycle) for r in g.cycles(edges(spark, pairs), 10).collect()] == [3] * 6 + [4] * 4


def brute_levels(pairs, ids):
    pairs = [(a, b) for a, b in pairs if a != b and a in ids and b in ids]
    part = brute_components(pairs)
    unit = {v: part.get(v, v) for v in ids}
    up = {}
    for a, b in pairs:
        if unit[a] != unit[b]:
            up.setdefault(unit[a], set()).add(unit[b])
    memo = {}

    def level(u):
        if u not in memo:
            memo[u] = 1 + max((level(x) for x in up.get(u, ())), default=-1)
        return memo[u]

    inner = {v: len({b for a, b in pairs if a == v and unit[b] == unit[v]}) for v in ids}
    out = {}
    for v in ids:
        mates = sorted((u for u in ids if unit[u] == unit[v]), key=lambda u: (inner[u], u))
        out[v] = (level(unit[v]), mates.index(v) if v in part else 0)
    return out


def test_levels(spark):
    ids = sorted({x for e in GRAPH for x in e} - {3, 205}) + [5000]
    got = {r.id: (r.level, r.turn) for r in g.levels(edges(spark, GRAPH), vertices(spark, ids)).collect()}
    assert got == brute_levels(GRAPH, ids)


def test_levels_count_calls_and_references_only(spark):
    got = {r.id: r.level for r in g.levels(edges(spark, [(1, 2)], "imports"), vertices(spark, [1, 2])).collect()}
    assert got == {1: 0, 2: 0} and g.levels(edges(spark, []), vertices(spark, [])).collect() == []


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    n = 5000
    ids = list(range(n))
    random.Random(9).shuffle(ids)
    calls = counted(monkeypatch)
    got = {r.id: r.level for r in g.levels(edges(spark, list(zip(ids[1:], ids))), vertices(spark, ids)).collect()}
    assert got == {v: i for i, v in enumerate(ids)} and len(calls) < 90


def test_communities_of_cliques(spark):
    """Pairs of cliques with one bridge, at other places and with other ids: two communities each."""
    cl = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    pairs, sides = [], []
    for k, bridge in enumerate([[], [(4, 11)], [(1, 14)], [(2, 12)], [(4, 14)], [(3, 13)]]):
        one, two = [100 * k + i for i in (1, 2, 3, 4)], [100 * k + i for i in (11, 12, 13, 14)]
        pairs += cl(one) + cl(two) + shifted(bridge, 100 * k)
        sides.append((one, two))
    got = {x.id: x.community for x in g.communities(edges(spark, pairs), vertices(spark, [v for x, y in sides for v in x + y] + [999])).collect()}
    for one, two in sides:
        assert len({got[i] for i in one}) == 1 == len({got[i] for i in two}) and got[one[0]] != got[two[0]]
    assert got[999] == 999


def test_labels_settle_on_the_most_frequent(spark):
    rng = random.Random(5)
    groups = [range(k * 20, k * 20 + 20) for k in range(5)]
    pairs = sorted({tuple(rng.sample(list(c), 2)) for c in groups for _ in range(120)} | {(rng.randrange(100), rng.randrange(100)) for _ in range(15)})
    got = {x.id: x.community for x in g.communities(edges(spark, pairs), vertices(spark, range(100))).collect()}
    near = {}
    for a, b in {x for a, b in pairs if a != b for x in ((a, b), (b, a))}:
        near.setdefault(a, []).append(got[b])
    top = lambda v: max(map(near[v].count, near[v]))
    assert sum(near[v].count(got[v]) == top(v) for v in near) >= 98  # all but what the last rounds left
    assert len(set(got.values())) == 5
    assert got == {x.id: x.community for x in g.communities(edges(spark, pairs).repartition(7), vertices(spark, range(100))).collect()}


def modularity(com, pairs):
    pairs = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    m, degree = len(pairs), {}
    for a, b in pairs:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    tot = {}
    for v, k in degree.items():
        tot[com[v]] = tot.get(com[v], 0) + k
    return sum(com[a] == com[b] for a, b in pairs) / m - sum((t / (2 * m)) ** 2 for t in tot.values())


def greedy(pairs):
    """Louvain one vertex at a time, in memory."""
    pairs = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    m2 = 2 * len(pairs)
    graph, loops = {}, {}
    for a, b in pairs:
        graph.setdefault(a, {})[b] = 1
        graph.setdefault(b, {})[a] = 1
    home = {v: v for v in graph}
    while True:
        com = {v: v for v in graph}
        degree = {v: sum(w.values()) + loops.get(v, 0) for v, w in graph.items()}
        tot, moved, any_moved = dict(degree), True, False
        while moved:
            moved = False
            for v in sorted(graph):
                w = {}
                for u, x in graph[v].items():
                    w[com[u]] = w.get(com[u], 0) + x
                tot[com[v]] -= degree[v]
                best = max(w, key=lambda c: (w[c] - tot[c] * degree[v] / m2, -c), default=com[v])
                if w.get(best, 0) - tot[best] * degree[v] / m2 <= w.get(com[v], 0) - tot[com[v]] * degree[v] / m2 + 1e-12:
                    best = com[v]
                tot[best] += degree[v]
                if best != com[v]:
                    com[v], moved, any_moved = best, True, True
        home = {v: com[c] for v, c in home.items()}
        if not any_moved:
            return home
        merged, inner = {}, {}
        for v, w in graph.items():
            inner[com[v]] = inner.get(com[v], 0) + loops.get(v, 0)
            merged.setdefault(com[v], {})
            for u, x in w.items():
                if com[u] == com[v]:
                    inner[com[v]] += x
                else:
                    merged[com[v]][com[u]] = merged[com[v]].get(com[u], 0) + x
        graph, loops = merged, inner


def test_louvain_is_near_the_greedy_one(spark):
    rng = random.Random(1)
    pairs = sorted({tuple(rng.sample(range(k * 30, k * 30 + 30), 2)) for k in range(6) for _ in range(100)} | {(rng.randrange(180), rng.randrange(180)) for _ in range(60)})
    ids = sorted({x for e in pairs for x in e})
    v = spark.createDataFrame([("r", i, "function") for i in ids] + [("r", 999, "function"), ("r", 1000, "file")], "repo_id string, id long, kind string")
    e = edges(spark, pairs).withColumn("repo_id", F.lit("r"))
    got = {r.id: r.community for r in h.louvain(e, v, ["repo_id"]).collect()}
    assert set(got) == {*ids, 999} and all(c in got for c in got.values()) and got[999] == 999
    assert modularity(got, pairs) >= 0.98 * modularity(greedy(pairs), pairs)


def test_louvain_keeps_repositories_apart(spark):
    cl = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    rows = [(r, a, b) for r in "xy" for a, b in cl("abcde") + cl("vwxyz") + [("e", "v")]] + [("z", "a", "b")]
    e = spark.createDataFrame(rows, "repo_id string, src string, dst string")
    v = spark.createDataFrame([(r, i, "function") for r in "xyz" for i in "abcdevwxyz"], "repo_id string, id string, kind string")
    got = {(r.repo_id, r.id): r.community for r in h.louvain(e, v, ["repo_id"]).collect()}
    for r in "xy":
        assert {got[r, i] for i in "abcde"} == {"a"} and {got[r, i] for i in "vwxyz"} == {"v"}
    assert got["z", "a"] == got["z", "b"] == "a" and got["z", "v"] == "v"


def test_queries_take_the_whole_graph(spark):
    got = {r.id: (r.level, r.turn) for r in graphs.levels(spark, SF).collect()}
    depends = [tuple(x) for x in p.edges(spark, SF).where("kind in ('calls', 'references')").select("src", "dst").distinct().collect()]
    assert got == brute_levels(depends, [r.id for r in p.entities(spark, SF).select("id").collect()])


def brute_nearest(parents, marked, ids):
    up = {}
    for i, x in parents:
        up.setdefault(i, []).append(x)
    out = {}
    for v in ids:
        front, seen, d = {v}, {v}, 0
        while front:
            if hit := front & marked:
                out[v] = (min(hit), d)
                break
            front = {x for y in front for x in up.get(y, ())} - seen
            seen |= front
            d += 1
    return out


def test_nearest_marked_over_merges(spark, monkeypatch):
    """A diamond, random merges and a long chain: fewest edges over all parents, ties to the smallest, in few rounds."""
    rng = random.Random(7)
    diamond = [(4, 2), (4, 3), (2, 1), (3, 0), (5, 4), (6, 5), (6, 3)]
    merges = [(100 + i, 100 + x) for i in range(1, 120) for x in {i - 1, rng.randrange(max(0, i - 9), i)}]
    order = list(range(1000, 5000))
    rng.shuffle(order)
    chain = list(zip(order[1:], order))
    parents = diamond + merges + chain + [(900, 901)]
    marked = {0, 1, 104, 150, 183, order[0], order[2500], 8000}
    calls = counted(monkeypatch)
    df = spark.createDataFrame(parents, "id long, parent long").repartition(3)
    m = spark.createDataFrame([(x,) for x in marked], "id long")
    ids = {x for e in parents for x in e} | marked
    want = brute_nearest(parents, marked, ids)
    got = {r.id: (r.near, r.distance) for r in st.nearest_marked(df, m, 10_000).collect()}
    assert got == want and 900 not in got and got[8000] == (8000, 0) and len(calls) < 40
    assert {r.id for r in st.nearest_marked(df, m, 3).collect()} == {v for v, (_, d) in want.items() if d <= 3}


def test_louvain_rounds_run_on_numbers(spark, monkeypatch):
    from graphloom.operators import structure

    e = spark.createDataFrame([("r", f"n{a}", f"n{b}") for a in range(8) for b in range(a) if a // 4 == b // 4 or (a, b) == (4, 3)], "repo_id string, src string, dst string")
    v = spark.createDataFrame([("r", f"n{k}", "function") for k in range(8)], "repo_id string, id string, kind string")
    types, better = set(), structure._better

    def seen(v_, e_, mine):
        types.update(dict(e_.dtypes)[c] for c in ("src", "dst"))
        return better(v_, e_, mine)

    monkeypatch.setattr(structure, "_better", seen)
    got = {r.id: r.community for r in h.louvain(e, v, ["repo_id"]).collect()}
    assert got == {f"n{k}": f"n{k // 4 * 4}" for k in range(8)}
    assert types == {"bigint"}


def test_few_edges_to_a_marked_one_take_as_many_rounds(spark, monkeypatch):
    chain = spark.range(1, 3000).select("id", (F.col("id") - 1).alias("parent"))
    rows, told = [], st.materialise_telling

    def counted_rows(df, tag, **k):
        out = told(df, tag, **k)
        rows.append(out[0].count())
        return out

    monkeypatch.setattr(st, "materialise_telling", counted_rows)
    got = {r.id: (r.near, r.distance) for r in st.nearest_marked(chain, spark.range(0, 3000, 100), 5).collect()}
    assert got == {i: (i - i % 100, i % 100) for i in range(3000) if i % 100 <= 5}
    assert sum(rows) == 5 * 30  # a vertex is written when it is found, not in every round


def test_tables_of_rounds_are_not_sent_through_the_driver(spark):
    for out in (st.materialise(spark.range(50), "t"), st.materialise_telling(spark.range(50), "t", n=F.count("*"))[0]):
        for side in (out.join(spark.range(9), "id"), spark.range(9).join(out.groupBy("id").count(), "id", "left_anti")):
            plan = side._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
        st.release(out)
        assert out._written_at not in lineage._written


def test_turns_are_not_sent_through_the_driver(spark):
    members = spark.createDataFrame([(i, i % 3, 9 - i) for i in range(9)], "id long, unit long, inner long")
    out = st._turns(members)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.id: r.turn for r in out.collect()} == {i: 2 - i // 3 for i in range(9)}


def test_label_rounds_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, write = [], lineage.materialise_telling

    def seen(df, tag, **told):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag, **told)

    monkeypatch.setattr(lineage, "materialise_telling", seen)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src long, dst long")
    got = {r.id: r.community for r in st.propagated_labels(e, spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "id long")).collect()}
    assert got[1] == got[2] == got[3] and got[7] == got[8] != got[1] and got[9] == 9
    assert len(plans) > 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_shuffles_go_once_a_table_stands(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {f for d in env.blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    was, before = spark.conf.get(lineage.CLEANUP), files()
    out = lineage.materialise(spark.range(5000).repartition(5, "id").groupBy((F.col("id") % 50).alias("k")).count(), "table")
    for _ in range(50):  # Spark deletes them in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 50
    assert spark.conf.get(lineage.CLEANUP) == was
