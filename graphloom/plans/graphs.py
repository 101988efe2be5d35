"""Graph queries over the projected code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as x
from ..operators import graph as g
from ..operators import structure
from ..sources import projections as p
from .base import query

G = (p.ENTITIES, p.EDGES)
CALLS = "calls as (select distinct src, dst from edges where kind in ('calls', 'references'))"


def _seeds(spark: SparkSession, d: str, step: int = 50) -> DataFrame:
    """The queried vertices: a fixed set of question, as a tool call would name them."""
    return p.entities(spark, d).where(F.col("id") % step == 0).select("id")


def reach(inbound: bool, hops: int, step: int, rel: str = "calls") -> str:
    a, b = ("dst", "src") if inbound else ("src", "dst")
    return f"""reach(seed, id, depth) as (select id, id, 0 from entities where id % {step} = 0
  union select r.seed, e.{b}, r.depth + 1 from reach r join {rel} e on e.{a} = r.id where r.depth < {hops}),
reached as (select seed, id, min(depth) as depth from reach where depth > 0 group by 1, 2)"""


@query("G1_callers", "select seed, r.id, depth, name, kind from reached r join entities e on e.id = r.id", *G, CALLS, reach(True, 2, 50))
def callers(spark, d):
    return g.callers(p.edges(spark, d), p.entities(spark, d), _seeds(spark, d), 2).select("seed", "id", "depth", "name", "kind")


@query("G2_callees", "select seed, r.id, depth, name, kind from reached r join entities e on e.id = r.id", *G, CALLS, reach(False, 2, 50))
def callees(spark, d):
    return g.callees(p.edges(spark, d), p.entities(spark, d), _seeds(spark, d), 2).select("seed", "id", "depth", "name", "kind")


@query("G3_impact_analysis", "select seed, r.id, depth, file_path from reached r join entities e on e.id = r.id", *G, CALLS, reach(True, 10, 100))
def impact(spark, d):
    return g.impact(p.edges(spark, d), p.entities(spark, d), _seeds(spark, d, 100), 10).select("seed", "id", "depth", "file_path")


ANY = """anyway as (select distinct src, dst from edges union select dst, src from edges)"""
SUB = """sub(seed, id, depth) as (select id, id, 0 from entities where id % 100 = 0
  union select s.seed, e.dst, s.depth + 1 from sub s join anyway e on e.src = s.id where s.depth < 2),
subs as (select seed, id, min(depth) as depth from sub group by 1, 2)"""


@query("G4_subgraph_vertices", "select seed, id, depth from subs", *G, ANY, SUB)
def subgraph_vertices(spark, d):
    return g.subgraph(p.edges(spark, d), _seeds(spark, d, 100), 2)[0]


@query("G5_subgraph_edges", "select a.seed, e.src, e.dst, e.kind from edges e join subs a on a.id = e.src join subs b on b.id = e.dst and a.seed = b.seed", *G, ANY, SUB)
def subgraph_edges(spark, d):
    return g.subgraph(p.edges(spark, d), _seeds(spark, d, 100), 2)[1]


@query("G6_import_chain", "select seed, r.id, depth as distance, file_path from reached r join entities e on e.id = r.id", *G, "imp as (select distinct src, dst from edges where kind = 'imports')", reach(False, 10, 50, "imp"))
def imports(spark, d):
    found = g.traverse(p.edges(spark, d).where("kind = 'imports'"), _seeds(spark, d), 10, inbound=False)
    return found.join(p.entities(spark, d), "id").select("seed", "id", F.col("depth").alias("distance"), "file_path")


@query("G7_pagerank")
def pagerank(spark, d):
    return g.page_rank(p.edges(spark, d), p.entities(spark, d)).select("id", F.round("pagerank", 9).alias("pagerank"), F.round("percentile", 6).alias("percentile"))


BFS = """dep as (select distinct src, dst from edges where kind in ('calls', 'references', 'imports')),
bfs(id, depth) as (select id, 0 from entities where id % 100 = 0 union select e.dst, b.depth + 1 from bfs b join dep e on e.src = b.id where b.depth < 20)"""


@query("G8_entry_depth", "select e.id, coalesce(min(b.depth), 99) as depth from entities e left join bfs b on b.id = e.id group by e.id", *G, BFS)
def entry_depth(spark, d):
    return g.depth_from(p.edges(spark, d), p.entities(spark, d), _seeds(spark, d, 100), 20)


@query("G9_label_propagation")
def label_propagation(spark, d):
    return g.communities(p.edges(spark, d), p.entities(spark, d))


def _components(name: str, of: str) -> str:
    """CTEs: ``name`` (id, component) of the strong components of two vertices or more of the edges ``of``."""
    return f"""{name}_reach(src, dst) as (select src, dst from {of} union select r.src, e.dst from {name}_reach r join {of} e on e.src = r.dst),
{name} as (select a.src as id, min(a.dst) as component from {name}_reach a join {name}_reach b on b.src = a.dst and b.dst = a.src group by a.src having count(distinct a.dst) > 1)"""


LEVELS = (
    "dep as (select distinct src, dst from edges where kind in ('calls', 'references') and src in (select id from entities) and dst in (select id from entities))",
    _components("parts", "dep"),
    "units as (select e.id, coalesce(component, e.id) as unit, component is not null as cyclic from entities e left join parts p on p.id = e.id)",
    "between as (select distinct a.unit as src, b.unit as dst from dep join units a on a.id = dep.src join units b on b.id = dep.dst where a.unit <> b.unit)",
    "walks(unit, level) as (select distinct unit, 0 from units union select src, level + 1 from walks join between on dst = unit)",
    "inner_edges as (select dep.src as id, count(*) as n from dep join units a on a.id = dep.src join units b on b.id = dep.dst where a.unit = b.unit group by 1)",
)


@query("G11_topological_levels", """select u.id, w.level::int as level, case when cyclic then row_number() over (partition by u.unit order by n, u.id) - 1 else 0 end as turn
  from units u join (select unit, max(level) as level from walks group by 1) w on w.unit = u.unit left join inner_edges i on i.id = u.id""", *G, *LEVELS)
def levels(spark, d):
    return g.levels(p.edges(spark, d), p.entities(spark, d))


# Every vertex of a component points to the successor nearest to the component's least vertex (up to 4 edges off), else the smallest one.
CYCLES = (
    "ce as (select distinct src, dst from edges where kind in ('calls', 'imports'))",
    _components("rings", "ce"),
    "inside as (select src, dst, a.component as part from ce join rings a on a.id = src join rings b on b.id = dst and b.component = a.component)",
    "off(id, away) as (select id, 0 from rings where id = component union select i.src, away + 1 from off join inside i on i.dst = off.id where away < 4)",
    "nearest as (select id, min(away) as away from off group by id)",
    "pointers as (select src as id, part, arg_min(dst, (coalesce(away, 5), dst)) as next from inside left join nearest n on n.id = dst group by src, part)",
    "follow(begin_id, spot) as (select id, next from pointers union select begin_id, next from follow join pointers on id = spot)",
    "on_ring as (select begin_id as id, min(spot) as low from follow group by begin_id having bool_or(spot = begin_id))",
    "ring_walk(component, low, spot, path) as (select part, low, next, [low] from on_ring join pointers using (id) where low = id union all select component, low, next, list_append(path, spot) from ring_walk join pointers on id = spot where spot <> low)",
    "ring as (select component, path as cycle from ring_walk where spot = low)",
)


@query("G12_cycles", "select component, array_to_string(cycle, ',') as cycle from ring", *G, *CYCLES)
def cycles(spark, d):
    return g.cycles(p.edges(spark, d)).select("component", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query("G12_strong_components", "select id, component from rings", *G, *CYCLES[:2])
def components(spark, d):
    return structure.strong_components(p.edges(spark, d).where("kind in ('calls', 'imports')"))


@query("G13_degree_centrality", """select e.id, count(x.id) as degree, round(least(count(x.id) / (2.0 * ((select count(*) from entities) - 1)), 1.0), 9) as centrality
  from entities e left join (select src as id from edges union all select dst from edges) x on x.id = e.id group by e.id""", *G)
def centrality(spark, d):
    return g.centrality(p.edges(spark, d), p.entities(spark, d)).select("id", "degree", F.round("centrality", 9).alias("centrality"))


@query("G14_hubs", "select dst as id, count(*) as callers from edges where kind = 'calls' group by dst having count(*) >= 10", *G)
def hubs(spark, d):
    return x.hubs(p.edges(spark, d), 10)


CASCADE = """hubs as (select dst as h from edges where kind = 'calls' group by dst having count(*) >= 12),
use as (select src, dst from edges where kind = 'calls' and src not in (select h from hubs) and dst not in (select h from hubs)),
walk(id, hop) as (select id, 0 from entities where id % 50 = 0 union select e.src, w.hop + 1 from walk w join use e on e.dst = w.id where w.hop < 2)"""


@query("G15_cascade_queue", "select id, min(hop) as hop from walk where id % 50 <> 0 group by id order by hop, id limit 50", *G, CASCADE)
def cascade(spark, d):
    return g.cascade(p.edges(spark, d), _seeds(spark, d), 2, 50, 12)


@query("G16_blast_radius", """select seed, id, depth from (select seed, r.id, depth, row_number() over (partition by seed order by depth, r.id) as rn
  from reached r join entities e on e.id = r.id where e.kind = 'interface') where rn <= 5""", *G, CALLS, reach(True, 3, 100))
def blast_radius(spark, d):
    from ..operators.windows import first_per_group

    found = g.impact(p.edges(spark, d), p.entities(spark, d), _seeds(spark, d, 100), 3).where("kind = 'interface'")
    return first_per_group(found, ["seed"], ["depth", "id"], 5).select("seed", "id", "depth")


@query("G18_graph_context", """select id, count(*) filter (dir = 'in') as inbound, count(*) filter (dir = 'out') as outbound,
  string_agg(distinct kind, ',' order by kind) as kinds from (select dst as id, 'in' as dir, kind from edges union all select src, 'out', kind from edges) group by id""", *G)
def context(spark, d):
    return x.neighbourhood(p.edges(spark, d)).withColumn("kinds", F.array_join("kinds", ","))


@query("G21_broken_edges", "select src, dst, kind from edges where src % 37 = 0 or dst % 37 = 0", *G)
def broken_edges(spark, d):
    from ..operators.joins import touching

    gone = p.entities(spark, d).where("id % 37 = 0").select("id")
    return touching(p.edges(spark, d), gone)


@query("G22_nearest_indexed", """select branch, ordinal, sha, max(case when indexed then ordinal end) over w as at,
  ordinal - max(case when indexed then ordinal end) over w as distance from
  (select o_custkey % 50 as branch, o_orderkey as sha, row_number() over (partition by o_custkey % 50 order by o_orderdate, o_orderkey)::int as ordinal, o_orderkey % 7 = 0 as indexed from orders)
  window w as (partition by branch order by ordinal)""")
def nearest_indexed(spark, d):
    from pyspark.sql import Window as W

    o = p.table(spark, d, "orders").withColumn("branch", F.col("o_custkey") % 50)
    c = o.select("branch", F.col("o_orderkey").alias("sha"), F.row_number().over(W.partitionBy("branch").orderBy("o_orderdate", "o_orderkey")).alias("ordinal"), (F.col("o_orderkey") % 7 == 0).alias("indexed"))
    n = g.nearest_indexed(c)
    return n.select("branch", "ordinal", "sha", (F.col("ordinal") - F.col("distance")).alias("at"), "distance")


# Orders as commits: each follows the one before it of its branch and, as a merge, the one before it of its priority.
HISTORY = (
    "placed as (select o_orderkey as id, o_orderkey % 40 = 0 as indexed, lag(o_orderkey) over (partition by o_custkey % 50 order by o_orderdate, o_orderkey) as a, case when o_orderkey % 3 = 0 then lag(o_orderkey) over (partition by o_orderpriority order by o_orderdate, o_orderkey) end as b from orders)",
    "parents as (select id, a as parent from placed where a is not null union select id, b from placed where b is not null)",
    "ways(id, near, distance) as (select id, id, 0 from placed where indexed union select p.id, w.near, w.distance + 1 from ways w join parents p on p.parent = w.id where w.distance < 12)",
)


@query("G22_merge_histories", "select id, distance, min(near) as near from (select id, near, distance, min(distance) over (partition by id) as least from ways) where distance = least group by id, distance", *HISTORY)
def merge_histories(spark, d):
    from pyspark.sql import Window as W

    order = ("o_orderdate", "o_orderkey")
    o = p.table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_orderpriority")
    before = lambda *by: F.lag("o_orderkey").over(W.partitionBy(*by).orderBy(*order))
    placed = o.select(F.col("o_orderkey").alias("id"), before(F.col("o_custkey") % 50).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, before("o_orderpriority")).alias("b"))
    parents = placed.select("id", F.explode(F.array("a", "b")).alias("parent"))
    return structure.nearest_marked(parents, o.where("o_orderkey % 40 = 0").select(F.col("o_orderkey").alias("id")), 12)
