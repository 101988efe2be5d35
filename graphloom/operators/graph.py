"""Graph operators over (src, dst, kind) edges and entities with an id.  All are set-oriented and take many seeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import materialise, materialise_telling, release
from . import structure

# Which edge kinds have a collection of their own; all others are stored with the calls.
OWN_COLLECTIONS = ("contains", "imports", "extends", "implements", "rule_exceptions", "language_implementations", "logically_coupled")
# Edge weights of the page rank.
RANK_WEIGHTS = {"calls": 0.5, "references": 0.3, "mutates_state": 0.9, "implements": 0.7, "emits": 0.6, "listens_to": 0.6, "extends": 0.3, "imports": 0.1, "member_of": 0.05, "contains": 0.0}


def connected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the undirected ``pairs``: the smallest node that is connected with it.

    Rounds of smallest labels over the pairs, each label then followed to its own label, so distances fall by halves."""
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialise(both.unionAll(both.select("y", "x")).distinct(), "pairs")
    last = labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "roots")
    while True:
        seen = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("near"))
        new = labels.join(seen, F.col("node") == F.col("x")).select("node", F.least("root", "near").alias("low"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = materialise(new.join(jump, "low").select("node", F.least("low", "far").alias("root"), "old"), "roots")
        release(last)
        last, labels = new, new.select("node", "root")
        if not new.where("root <> old").head(1):
            return labels


def collection(kind: Column) -> Column:
    return F.when(kind.isin(*OWN_COLLECTIONS), kind).otherwise("calls")


NAMED = 1_000_000  # seeds whose names are sent to every task


def _met(edges: DataFrame, seeds: DataFrame, hops: int, inbound: bool, both: bool = False) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(id, depth, ...) of the vertices that seeds meet, and what makes rows of each seed out of such rows, columns joined to
    them included.

    Beyond two hops 64 seeds share a row: each has a bit of its block's number, in order of their ids.  A hop joins the new bits with
    the edges, unites them by vertex and block, and drops those known, so what is shuffled and written are vertices and blocks,
    not vertices and seeds."""
    e = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")) if inbound else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if both:
        e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select("dst", "src"))
    e = e.distinct()
    if hops <= 2:
        front = seeds.select(F.col("id").alias("seed"), "id")
        seen = None
        for depth in range(1, hops + 1):
            step = front.join(e, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id")).distinct()
            if seen is not None:
                step = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
            step = step.withColumn("depth", F.lit(depth))
            seen = step if seen is None else seen.unionAll(step)
            front = step.select("seed", "id")
        return seen, lambda rows: rows
    e = materialise(e, "ways")
    named = places(seeds.select(F.col("id").alias("seed")).distinct(), [F.col("seed")])
    block, bit = F.shiftright("place", 6), F.expr("shiftleft(1L, cast(place & 63 as int))")
    front = named.select(F.col("seed").alias("id"), block.alias("block"), bit.alias("new"))
    found, state = None, None
    for depth in range(1, hops + 1):
        step = front.join(e, F.col("id") == F.col("a")).select(F.col("b").alias("id"), "block", "new", F.lit(0).cast("long").alias("old"))
        if state is not None:
            step = step.unionAll(state.select("id", "block", F.lit(0).cast("long"), F.col("old").bitwiseOR(F.col("new"))))
        step = step.groupBy("id", "block").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        step = step.select("id", "block", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("new"), "old")
        state, told = materialise_telling(step, "hop", moved=F.count_if(F.col("new") != 0))
        front = state.where("new <> 0").select("id", "block", "new")
        found = front.withColumn("depth", F.lit(depth)) if found is None else found.unionAll(front.withColumn("depth", F.lit(depth)))
        if not told["moved"]:
            break
    names = named.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "seed")))["seed"].alias("seeds_"))
    names = F.broadcast(names) if named.count() <= NAMED else names

    def by_seed(rows: DataFrame) -> DataFrame:
        out = rows.join(names, "block").withColumn("seed", F.explode(F.expr("filter(seeds_, (s, i) -> (shiftright(new, i) & 1) = 1)")))
        return out.select("seed", *[c for c in rows.columns if c not in ("block", "new")])

    return found, by_seed


def traverse(edges: DataFrame, seeds: DataFrame, hops: int, inbound: bool = True, both: bool = False) -> DataFrame:
    """(seed, id, depth): every vertex on a path of 1..``hops`` edges, at its least depth.  The seed itself appears
    only if a cycle leads back to it.  Each hop expands only vertices that are new, so cycles and hubs cost one visit."""
    met, by_seed = _met(edges, seeds, hops, inbound, both)
    return by_seed(met).select("seed", "id", "depth")


def _reached(edges: DataFrame, entities: DataFrame, seeds: DataFrame, hops: int, inbound: bool = True) -> DataFrame:
    """``traverse`` along calls, with the entities, which are joined before rows are made of each seed."""
    met, by_seed = _met(edges.where(collection(F.col("kind")) == "calls"), seeds, hops, inbound)
    return by_seed(met.join(entities.where("kind <> 'tombstone'"), "id"))


def callers(edges: DataFrame, entities: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Callers up to ``hops`` (held to 1..5), with their entities; dangling ends and tombstones drop out."""
    return _reached(edges, entities, seeds, max(1, min(5, hops)))


def callees(edges: DataFrame, entities: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    return _reached(edges, entities, seeds, max(1, min(5, hops)), inbound=False)


def impact(edges: DataFrame, entities: DataFrame, seeds: DataFrame, hops: int = 5) -> DataFrame:
    """Everything that reaches a seed within ``hops`` (held to 1..10)."""
    return _reached(edges, entities, seeds, max(1, min(10, hops)))


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (seed, id, depth; the seed at 0) within ``hops`` in any direction, and the edges among them."""
    use = edges.where(collection(F.col("kind")).isin("calls", "imports", "extends", "implements"))
    found = traverse(use, seeds, hops, both=True).where("id <> seed")
    found = found.unionAll(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")))
    v = found.select("seed", "id")
    inner = use.join(v.select("seed", F.col("id").alias("src")), "src").join(v.select("seed", F.col("id").alias("dst")), ["seed", "dst"])
    return found, inner.select("seed", "src", "dst", "kind")


def depth_from(edges: DataFrame, entities: DataFrame, entry: DataFrame, hops: int, unreached: int = 99) -> DataFrame:
    """(id, depth): least number of outgoing edges from any entry point; ``unreached`` for the rest."""
    e = edges.where(F.col("kind").isin("calls", "references", "imports")).select("src", "dst").distinct()
    seen = front = materialise(entry.select("id", F.lit(0).alias("depth")).distinct(), "entry")
    for depth in range(1, hops + 1):
        step = front.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = materialise(step.withColumn("depth", F.lit(depth)), "depth")
        if not front.head(1):
            break
        seen = seen.unionAll(front)
    return entities.select("id").join(seen, "id", "left").select("id", F.coalesce("depth", F.lit(unreached)).alias("depth"))


def fan(edges: DataFrame, entities: DataFrame, high: int = 10, medium: int = 5) -> DataFrame:
    """Fan-in, fan-out and risk of callables by call edges."""
    calls = edges.where("kind = 'calls'")
    i = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    o = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    j = entities.where(F.col("kind").isin("function", "method")).select("id", "name").join(i, "id", "left").join(o, "id", "left").fillna(0, ["fan_in", "fan_out"])
    top = F.greatest("fan_in", "fan_out")
    return j.withColumn("risk_level", F.when(top >= high, "high").when(top >= medium, "medium").otherwise("normal"))


def _weight() -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in RANK_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(0.0))


def page_rank(edges: DataFrame, entities: DataFrame, damping: float = 0.85, tol: float = 1e-4, rounds: int = 100) -> DataFrame:
    """(id, pagerank, percentile): weighted page rank, and the place in ascending order (ties by id) in percent.

    Vertices without weight out spread their rank evenly; it stops when no rank moves by ``tol``.  A round is one join of the
    weight shares with the ranks and one table, whose aggregate gives the next round's even share."""
    w = edges.select("src", "dst", _weight().alias("w")).where("w > 0")
    known = materialise(entities.select("id").distinct(), "known")
    w = materialise(w.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi"), "weights")
    n = known.count()
    if n == 0:
        return known.select("id", F.lit(0.0).alias("pagerank"), F.lit(0.0).alias("percentile"))
    out = w.groupBy("src").agg(F.sum("w").alias("total"))
    share = materialise(w.join(out, "src").groupBy("src", "dst").agg((F.sum("w") / F.max("total")).alias("share")), "shares")
    ranks = materialise(known.join(out.select(F.col("src").alias("id"), F.lit(True).alias("sends")), "id", "left").withColumn("pagerank", F.lit(1.0 / n)), "rank")
    idle = F.sum(F.when(F.col("sends").isNull(), F.col("pagerank"))).alias("idle")
    dangling = ranks.agg(idle).first()["idle"] or 0.0
    for _ in range(rounds):
        got = share.join(ranks.select(F.col("id").alias("src"), "pagerank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("pagerank")).alias("got"))
        new = ranks.join(got, "id", "left").select("id", "sends", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + dangling / n)).alias("pagerank"), F.col("pagerank").alias("old"))
        new = materialise(new, "rank")
        state = new.agg(F.max(F.abs(F.col("pagerank") - F.col("old"))).alias("moved"), idle).first()
        release(ranks)
        ranks, dangling = new, state["idle"] or 0.0
        if state["moved"] < tol:
            break
    release(w, share)
    return percentile(ranks.select("id", "pagerank"), "pagerank", n)


def percentile(rows: DataFrame, col: str, n: int) -> DataFrame:
    """``percentile`` = place / (n - 1) * 100 in ascending order of (col, id); one row: 100.

    Places come from a distributed sort: counts of the ranges before, then numbers within the range."""
    place = places(rows, [F.col(col), F.col("id")])
    return place.withColumn("percentile", F.when(F.lit(n) <= 1, 100.0).otherwise(F.col("place") / F.lit(max(n - 1, 1)) * 100.0)).drop("place")


def places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, 0-based, in a total order, without a single-task window."""
    at = materialise(rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "places")
    part = F.shiftright("at_", 33).cast("int")
    counts = {r[0]: r[1] for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row per partition
    pairs, seen = [], 0
    for p in sorted(counts):
        pairs += [F.lit(p), F.lit(seen)]
        seen += counts[p]
    start = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return at.withColumn("place", (start + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("at_")


def communities(edges: DataFrame, entities: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, community) by label propagation: see ``structure.propagated_labels``."""
    return structure.propagated_labels(edges, entities.select("id"), rounds)


def levels(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, level, turn) by what calls and references depend on: see ``structure.levels``."""
    return structure.levels(edges, entities)


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(component, cycle) over calls and imports, of any length and at least one of every strong component: see
    ``structure.witness_cycles``.  With ``most`` the shortest ones (ties: the smallest ids)."""
    found = structure.witness_cycles(edges.where(F.col("kind").isin("calls", "imports")))
    return found if most is None else found.orderBy(F.size("cycle"), "cycle").limit(most)


def centrality(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Approximate degree centrality: min(degree / (2 (n - 1)), 1)."""
    n = entities.count()
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst"))
    d = ends.groupBy("id").agg(F.count("*").alias("degree"))
    score = F.least(F.col("degree") / F.lit(max(2 * (n - 1), 1)), F.lit(1.0))
    return entities.select("id").join(d, "id", "left").fillna(0, ["degree"]).select("id", "degree", score.alias("centrality"))


def cascade(edges: DataFrame, seeds: DataFrame, hops: int = 2, most: int = 50, hub: int = 50) -> DataFrame:
    """Callers to look at again after a change: up to ``hops`` away, never through or to hubs, the ``most`` nearest."""
    calls = edges.where("kind = 'calls'")
    hubs = calls.groupBy(F.col("dst").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") >= hub).select("h")
    use = calls.join(hubs, F.col("src") == F.col("h"), "left_anti").join(hubs, F.col("dst") == F.col("h"), "left_anti")
    found = traverse(use, seeds, hops).groupBy("id").agg(F.min("depth").alias("hop"))
    return found.join(seeds.select("id"), "id", "left_anti").orderBy("hop", "id").limit(most)


def nearest_indexed(commits: DataFrame) -> DataFrame:
    """As-of over a first-parent chain: (branch, ordinal, sha, indexed) gain the last indexed sha and its distance."""
    w = W.partitionBy("branch").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    at = F.last(F.when(F.col("indexed"), F.struct("sha", "ordinal")), ignorenulls=True).over(w)
    return commits.withColumn("near", at).select("branch", "ordinal", "sha", F.col("near.sha").alias("nearest_sha"), (F.col("ordinal") - F.col("near.ordinal")).alias("distance"))
