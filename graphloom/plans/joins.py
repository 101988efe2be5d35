"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import context as x
from ..operators import joins as j
from ..operators.health import unjustified as unjustified_of
from ..operators import windows as w
from ..sources import projections as p
from .base import query

G = (p.ENTITIES, p.EDGES)


@query("J1_edge_vertex_lookup", "select src, dst, e.kind, v.name, v.kind as dst_kind from edges e join entities v on v.id = e.dst where e.kind = 'calls'", *G)
def edge_vertex(spark, d):
    return x.edge_ends(p.edges(spark, d).where("kind = 'calls'"), p.entities(spark, d))


@query("J2_entity_left_justification", "select e.id, e.name, j.taxonomy, j.confidence from entities e left join justifications j on j.entity_id = e.id", p.ENTITIES, p.JUSTIFICATIONS)
def entity_justification(spark, d):
    return x.justified(p.entities(spark, d), p.justifications(spark, d)).select("id", "name", "taxonomy", "confidence")


@query("J3_entity_by_taxonomy", "select e.id, e.name, j.feature_tag, count(*) over () as total from entities e join justifications j on j.entity_id = e.id where taxonomy = 'VERTICAL'", p.ENTITIES, p.JUSTIFICATIONS)
def by_taxonomy(spark, d):
    return x.with_total(x.justified(p.entities(spark, d), p.justifications(spark, d).where("taxonomy = 'VERTICAL'"), "inner").select("id", "name", "feature_tag"))


@query("J4_cross_feature_calls", """select e.src, e.dst, a.feature_tag as from_feature, b.feature_tag as to_feature, v.name from edges e
  join justifications a on a.entity_id = e.src join justifications b on b.entity_id = e.dst join entities v on v.id = e.dst
  where e.kind = 'calls' and a.feature_tag <> b.feature_tag and regexp_matches(v.name, '(?i)(1|3|5|7|9)$')""", *G, p.JUSTIFICATIONS)
def cross_feature(spark, d):
    return x.cross_feature_calls(p.edges(spark, d), p.justifications(spark, d), p.entities(spark, d), "(?i)(1|3|5|7|9)$")


@query("J5_imported_file_entities", "select e.src, string_agg(v.id::varchar, ',' order by v.id) as members, count(*) as n from edges e join entities v on v.id = e.dst where e.kind = 'imports' group by e.src", *G)
def imported(spark, d):
    return x.imported_entities(p.edges(spark, d), p.entities(spark, d)).withColumn("members", F.array_join(F.transform("members", lambda v: v.cast("string")), ","))


HUNKS = "hunks as (select 'src/' || p_brand || '/' || p_type as file_path, l_orderkey as hunk, (l_orderkey % 90)::int as start, (l_orderkey % 90 + l_linenumber)::int as \"end\" from lineitem join part on p_partkey = l_partkey)"


@query("J8_hunks_overlap", """select hunk, h.file_path, start, "end", e.id from hunks h join (select 'src/' || p_brand || '/' || p_type as file_path, p_partkey as id, p_partkey % 97 + 1 as s, p_partkey % 97 + 1 + p_size as t from part) e
  on e.file_path = h.file_path and h.start <= e.t and h."end" >= e.s""", HUNKS)
def hunks(spark, d):
    part = p.table(spark, d, "part")
    f = F.concat_ws("/", F.lit("src"), "p_brand", "p_type")
    h = p.table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(f.alias("file_path"), F.col("l_orderkey").alias("hunk"), (F.col("l_orderkey") % 90).cast("int").alias("start"), (F.col("l_orderkey") % 90 + F.col("l_linenumber")).cast("int").alias("end"))
    e = part.select(f.alias("file_path"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97 + 1).alias("start_line"), (F.col("p_partkey") % 97 + 1 + F.col("p_size")).alias("end_line"))
    return j.overlaps(h, e).select("hunk", "file_path", "start", "end", "id")


@query("J9_containing_entity", """select r.doc, r.line, (select max_by(p_partkey, (p_partkey % 97 + 1) * 10000000 + p_partkey) from part where p_brand = r.brand and p_partkey % 97 + 1 <= r.line) as entity_id
  from (select o_orderkey as doc, 'Brand#' || (o_orderkey % 5 + 1) || (o_orderkey // 5 % 5 + 1) as brand, (o_custkey % 110)::bigint as line from orders) r""")
def containing(spark, d):
    k = F.col("o_orderkey")
    r = p.table(spark, d, "orders").select(k.alias("doc"), F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"), (F.floor(k / 5) % 5 + 1).cast("string")).alias("brand"), (F.col("o_custkey") % 110).alias("line"))
    e = p.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97 + 1).alias("start_line"))
    return j.containing(r, e, ["brand"]).select("doc", "line", "entity_id")


@query("J10_position_lookup", "select id, name from entities where start_line <= 42 and coalesce(end_line, 1000000) >= 42", p.ENTITIES)
def position(spark, d):
    return x.at_line(p.entities(spark, d), 42).select("id", "name")


@query("J11_band_first", """select violation, line, arg_min(id, s * 10000000 + id) as entity_id from
  (select o_orderkey as violation, o_orderkey % 5 as f, (o_custkey % 300)::bigint as line from orders) v
  join (select p_partkey as id, p_partkey % 5 as f, p_partkey * 7 % 400 as s from part) e on e.f = v.f and abs(e.s - v.line) < 10 group by violation, line""")
def band(spark, d):
    v = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("violation"), (F.col("o_orderkey") % 5).alias("f"), (F.col("o_custkey") % 300).alias("line"))
    e = p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("f"), (F.col("p_partkey") * 7 % 400).alias("s"))
    return j.band_first(v, e, ["f"], "line", "s", 10).select("violation", "line", "entity_id")


@query("J12_class_methods", "select c.id as class_id, m.id as method_id from cls c join met m on m.file_path = c.file_path and m.start_line between c.start_line and c.end_line",
       "cls as (select p_partkey as id, p_brand as file_path, p_partkey % 97 + 1 as start_line, p_partkey % 97 + 1 + p_size as end_line from part where p_size % 5 = 2)",
       "met as (select p_partkey as id, p_brand as file_path, p_partkey % 97 + 1 as start_line from part where p_size % 5 = 1)")
def class_methods(spark, d):
    part = p.table(spark, d, "part")
    line = F.col("p_partkey") % 97 + 1
    c = part.where("p_size % 5 = 2").select(F.col("p_partkey").alias("class_id"), F.col("p_brand").alias("file_path"), line.alias("start_line"), (line + F.col("p_size")).alias("end_line"))
    m = part.where("p_size % 5 = 1").select(F.col("p_partkey").alias("method_id"), F.col("p_brand").alias("file_path"), line.alias("start"), line.alias("end"))
    return j.overlaps(m, c).select("class_id", "method_id")


@query("J13_boundary_imports", "select distinct src from edges where kind = 'imports' and dst not in (select id from entities where kind <> 'variable')", *G)
def boundary(spark, d):
    return x.boundary(p.edges(spark, d), p.entities(spark, d).where("kind <> 'variable'")).withColumnRenamed("id", "src")


@query("J14_unjustified", "select id, name from entities where id not in (select entity_id from justifications)", p.ENTITIES, p.JUSTIFICATIONS)
def unjustified(spark, d):
    return unjustified_of(p.entities(spark, d), p.justifications(spark, d)).select("id", "name")


@query("J15_dead_code", """select id, name, kind from entities where kind in ('function', 'method', 'class') and not regexp_matches(file_path, '(?i)(\\.test\\.|__tests__|/index\\.ts$)')
  and id not in (select dst from edges where kind in ('calls', 'references', 'imports'))""", *G)
def dead(spark, d):
    e = p.entities(spark, d).where(F.col("kind").isin("function", "method", "class") & ~F.col("file_path").rlike(r"(?i)(\.test\.|__tests__|/index\.ts$)"))
    return j.unreferenced(e, p.edges(spark, d)).select("id", "name", "kind")


@query("J16_edges_for_entities", "select src, dst, kind from edges where src in (select id from entities where kind = 'class') or dst in (select id from entities where kind = 'class')", *G)
def for_entities(spark, d):
    return j.touching(p.edges(spark, d), p.entities(spark, d).where("kind = 'class'"))


@query("J17_entity_diff", """select coalesce(n.id, o.id) as id, case when o.id is null then 'added' when n.id is null then 'deleted' else 'updated' end as change
  from (select o_orderkey as id, o_totalprice as price, o_orderstatus as s from orders where o_orderkey % 10 <> 2) o
  full join (select o_orderkey as id, case when o_orderkey % 10 = 0 then o_totalprice + 1 else o_totalprice end as price, o_orderstatus as s from orders where o_orderkey % 10 <> 1) n on n.id = o.id
  where o.id is null or n.id is null or o.price is distinct from n.price or o.s is distinct from n.s""")
def diff(spark, d):
    o = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("s"))
    new = o.where("id % 10 <> 1").withColumn("price", F.when(F.col("id") % 10 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return j.diff_sets(o.where("id % 10 <> 2"), new, "id", ["price", "s"])


@query("J18_edge_delta", "select src, dst, kind, 'added' as change from (select * from edges where src % 7 <> 0 except select * from edges where src % 5 <> 0) union all select src, dst, kind, 'deleted' from (select * from edges where src % 5 <> 0 except select * from edges where src % 7 <> 0)", *G)
def edge_delta(spark, d):
    e = p.edges(spark, d)
    return x.edge_delta(e.where("src % 5 <> 0"), e.where("src % 7 <> 0"))


FP = "fp as (select p_partkey as id, p_brand as kind, left(sha256(p_type || p_size), 16) as fingerprint from part)"


@query("J19_moves", """select o.id as old_id, n.id as new_id, o.kind, o.fingerprint from (select *, row_number() over (partition by fingerprint, kind order by id) as rn from fp where id % 2 = 0) o
  join (select *, row_number() over (partition by fingerprint, kind order by id) as rn from fp where id % 2 = 1) n on n.fingerprint = o.fingerprint and n.kind = o.kind and n.rn = o.rn""", FP)
def moves(spark, d):
    fp = p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.substring(F.sha2(F.concat("p_type", F.col("p_size").cast("string")), 256), 1, 16).alias("fingerprint"))
    return j.moves(fp.where("id % 2 = 0"), fp.where("id % 2 = 1"))


@query("J20_scope_overlay", """select id, price, kind, scope from scoped where scope = 'branch:x' and kind <> 'tombstone'
  union all select id, price, kind, scope from scoped where scope = 'primary' and id not in (select id from scoped where scope = 'branch:x')""", p.SCOPED)
def overlay(spark, d):
    return j.scope_overlay(p.scoped(spark, d), "branch:x").select("id", "price", "kind", "scope")


@query("J21_overlay_lookup", """select o_orderkey as id, case when o_orderkey % 4 = 0 then o_totalprice + 2 when o_orderkey % 6 = 0 then o_totalprice + 1 else o_totalprice end as price,
  case when o_orderkey % 4 = 0 then 0 when o_orderkey % 6 = 0 then 1 else 2 end as layer from orders where o_orderkey % 3 = 0""")
def lookup(spark, d):
    o = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    up = lambda n, k: o.where(F.col("id") % n == 0).withColumn("price", F.col("price") + k)
    return j.first_of_layers(o.where("id % 3 = 0"), up(4, 2), up(6, 1), o)


@query("J22_test_files", "select e.dst as id, e.src as test_id from edges e where kind = 'calls' and src % 10 = 3 and dst % 10 <> 3", *G)
def tests(spark, d):
    return x.tests_of(p.edges(spark, d), p.entities(spark, d), F.col("id") % 10 == 3)


@query("J23_parent_siblings", """select a.p_partkey as id, string_agg(b.p_partkey::varchar, ',' order by b.p_partkey) as siblings from part a join part b on a.p_type = b.p_type and a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey group by 1""")
def siblings(spark, d):
    return x.siblings(p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand"), ["p_type", "p_brand"], joined_by=",")


@query("J24_entity_profile", """select e.id, coalesce(i.s, '') as callers, coalesce(o.s, '') as callees, j.taxonomy, (x.dst is null) as dead from entities e
  left join (select dst, string_agg(src::varchar, ',' order by src) as s from (select *, row_number() over (partition by dst order by src) as rn from edges where kind = 'calls') where rn <= 20 group by dst) i on i.dst = e.id
  left join (select src, string_agg(dst::varchar, ',' order by dst) as s from (select *, row_number() over (partition by src order by dst) as rn from edges where kind = 'calls') where rn <= 20 group by src) o on o.src = e.id
  left join justifications j on j.entity_id = e.id left join (select distinct dst from edges where kind in ('calls', 'references', 'imports')) x on x.dst = e.id""", *G, p.JUSTIFICATIONS)
def profile(spark, d):
    e, v = p.edges(spark, d), p.entities(spark, d).select("id")
    i, o = j.neighbour_sets(e.where("kind = 'calls'"))
    used = e.where(F.col("kind").isin("calls", "references", "imports")).select(F.col("dst").alias("id"), F.lit(False).alias("dead")).distinct()
    js = p.justifications(spark, d).select(F.col("entity_id").alias("id"), "taxonomy")
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    return v.join(i, "id", "left").join(o, "id", "left").join(js, "id", "left").join(used, "id", "left").select("id", text("callers").alias("callers"), text("callees").alias("callees"), "taxonomy", F.coalesce("dead", F.lit(True)).alias("dead"))


@query("J25_new_dependencies", "select distinct p_type as dep from part where p_partkey % 3 = 0 and p_type not in (select p_type from part where p_partkey % 400 = 1)")
def dependencies(spark, d):
    part = p.table(spark, d, "part").withColumnRenamed("p_type", "dep")
    return x.new_dependencies(part.where("p_partkey % 3 = 0"), part.where("p_partkey % 400 = 1"))


@query("J28_cochange_pairs", "select a.file as a, b.file as b, count(*) as support from commits a join commits b on a.sha = b.sha and a.file < b.file group by 1, 2", p.commits_sql("p_type"))
def pairs(spark, d):
    return j.co_occurrence(p.commits(spark, d, "p_type"), "sha", "file").select("a", "b", "support")


@query("J7_entity_cochange", """select a.file as fa, b.file as fb, ea.id as src, eb.id as dst from (select a, b from (select a.file as a, b.file as b, count(*) as n from commits a join commits b on a.sha = b.sha and a.file < b.file group by 1, 2) where n >= 3) x
  join (select distinct file from commits) a on a.file = x.a join (select distinct file from commits) b on b.file = x.b
  join (select p_type as file, p_partkey as id, row_number() over (partition by p_type order by p_partkey) as pos from part) ea on ea.file = a.file
  join (select p_type as file, p_partkey as id, row_number() over (partition by p_type order by p_partkey) as pos from part) eb on eb.file = b.file
  qualify row_number() over (partition by a.file, b.file order by ea.pos, eb.pos) <= 5""", p.commits_sql("p_type"))
def entity_cochange(spark, d):
    pairs_ = j.co_occurrence(p.commits(spark, d, "p_type"), "sha", "file", 3).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    # Five pairs in order of both places lie within the first five entities of either file.
    first = w.first_per_group(p.table(spark, d, "part").select(F.col("p_type").alias("file"), F.col("p_partkey").alias("id")), ["file"], ["id"], 5)
    a, b = first.select(F.col("file").alias("fa"), F.col("id").alias("src")), first.select(F.col("file").alias("fb"), F.col("id").alias("dst"))
    return w.first_per_group(pairs_.join(a, "fa").join(b, "fb"), ["fa", "fb"], ["src", "dst"], 5).select("fa", "fb", "src", "dst")
