"""The rest of the surface: parsing, imports, status changes, scalar families, tools, provider batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import providers
from ..functions import scalars as s
from ..operators import change as c
from ..operators import mutations as m
from ..operators import texts
from ..sources import code, workspace
from ..sources import projections as p
from ..streaming import operators as st
from ..streaming import steps
from ..tools import TOOLS, Repo
from . import lineage
from .base import query


@query("S1_scan_files", "select unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' as name")
def scan(spark, d):
    """The folder's own files as a workspace: their bytes are read only for the columns asked for.  A table kept as a folder of
    part files is one name; what is ignored goes by the path below the folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(d)
    return f.select(code.below(spark, d, F.col("path")).alias("path")).where(~code.ignored(F.col("path"))).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("name")).distinct()


@query("S3_text_or_binary", "select case when p_partkey % 3 = 0 then 'binary' else 'text' end as kind, count(*) as n from part group by 1")
def text_or_binary(spark, d):
    k = F.col("p_partkey") % 3
    content = F.when(k == 0, F.unhex(F.lit("FFFE00"))).otherwise(F.encode("p_name", "UTF-8"))
    return p.table(spark, d, "part").groupBy(F.when(code.text_of(content).isNull(), "binary").otherwise("text").alias("kind")).agg(F.count("*").alias("n"))


def sources(spark, d):
    k = F.col("p_partkey")
    ts = F.concat(F.lit("import { x } from 'lib/"), k.cast("string"), F.lit("'\nexport class C"), k.cast("string"), F.lit(" {}\nexport function f"), k.cast("string"), F.lit("(a) {}\n// class No {}\n"))
    py = F.concat(F.lit("import os\nclass P"), k.cast("string"), F.lit(":\n    def m"), k.cast("string"), F.lit("(self):\n        pass\n"))
    return p.table(spark, d, "part").select(F.concat(F.lit("src/f"), k.cast("string"), F.when(k % 2 == 0, ".ts").otherwise(".py")).alias("path"), F.when(k % 2 == 0, ts).otherwise(py).alias("text"))


@query("S8_parse_entities", """select 'class' as kind, case when p_partkey % 2 = 0 then 'C' else 'P' end || p_partkey as name, 2 as start_line from part
  union all select case when p_partkey % 2 = 0 then 'function' else 'method' end, case when p_partkey % 2 = 0 then 'f' else 'm' end || p_partkey, 3 from part""")
def parse(spark, d):
    return code.parse_entities(sources(spark, d)).select("kind", "name", "start_line")


@query("S8_parse_imports", "select 'src/f' || p_partkey || case when p_partkey % 2 = 0 then '.ts' else '.py' end as file_path, case when p_partkey % 2 = 0 then 'lib/' || p_partkey else 'os' end as imported from part")
def parse_imports(spark, d):
    return code.parse_imports(sources(spark, d)).select("file_path", "imported")


@query("S10_changed_files", "select distinct 'src/' || o_orderkey || '.ts' as file from orders")
def changed(spark, d):
    from .reads import hunks

    return hunks(spark, d).select("file").distinct()


@query("S17_pattern_scan", "select doc_id, count(*) as hits from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, 'token = ') group by 1")
def pattern_scan(spark, d):
    catalog = workspace.load_catalog(spark, '[{"id": "secret", "regex": "token = ", "severity": "error"}]')
    docs = p.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("language"), "text")
    return workspace.scan_patterns(docs, catalog).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("hits"))


@query("S20_buffer_overlay", "select p_partkey as id, case when p_partkey % 6 = 0 then 'edited' else p_name end as name from part")
def buffer(spark, d):
    from ..operators.joins import first_of_layers

    base = p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return first_of_layers(base, base.where("id % 6 = 0").withColumn("name", F.lit("edited")), base).select("id", "name")


@query("K3_jsonl_import", "select count(*) filter (p_partkey % 7 <> 0 and p_partkey % 4 <> 0) as created, count(*) filter (p_partkey % 7 <> 0 and p_partkey % 4 = 0) as updated, count(*) filter (p_partkey % 7 = 0) as errors from part")
def jsonl(spark, d):
    k = F.col("p_partkey")
    lines = p.table(spark, d, "part").select(F.when(k % 7 == 0, "{broken").otherwise(F.to_json(F.struct(k.alias("id"), F.col("p_name").alias("name")))).alias("value"))
    known = p.table(spark, d, "part").where("p_partkey % 4 = 0").select(k.alias("id"))
    return m.import_jsonl(lines, "id long, name string", known, "id")[1].select("created", "updated", "errors")


@query("K12_delete_repo", "select id, label from vectors where label <> 3", p.VECTORS)
def delete_repo(spark, d):
    v = p.vectors(spark, d)
    return m.delete(v, v.where("label = 3").select("label"), ["label"]).select("id", "label")


@query("K13_single_upsert", "select user_id as id, max(event_id) as last from events group by 1")
def single(spark, d):
    return m.last_wins(p.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("last")), ["id"], "last")


@query("K14_status_flip", "select o_orderkey as id, case when o_orderkey % 9 = 0 then 'archived' else o_orderstatus end as status from orders")
def flip(spark, d):
    o = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return m.upsert(o, o.where("id % 9 = 0").select("id", F.lit("archived").alias("status")), ["id"])


@query("K15_snapshot_manifest", "select (select count(*) from entities) as entities, (select count(*) from edges) as edges", p.ENTITIES, p.EDGES)
def snapshot(spark, d):
    import uuid

    from .lineage import shared_dir

    return m.export_snapshot(p.entities(spark, d), p.edges(spark, d), f"{shared_dir(spark)}/graphloom/snapshot-{uuid.uuid4().hex}").select("entities", "edges")


@query("S18_snapshot_load", "select id, kind from entities", p.ENTITIES)
def load(spark, d):
    import uuid

    from .lineage import shared_dir

    path = f"{shared_dir(spark)}/graphloom/version-{uuid.uuid4().hex}"
    m.write_version(p.entities(spark, d), path, ["kind"])
    return spark.read.parquet(path).select("id", "kind")


@query("J26_env_vars", "select distinct p_brand as variable from part where p_brand not in ('Brand#11', 'Brand#12')")
def env(spark, d):
    from .change import r8

    return r8(spark, d)


@query("J27_tag_similarity", "select a.t as a, b.t as b from (select distinct lower(p_type) as t from part) a join (select distinct lower(p_type) as t from part) b on a.t < b.t and 1 - levenshtein(a.t, b.t)::double / greatest(length(a.t), length(b.t)) >= 0.75")
def similar_tags(spark, d):
    return c.similar_pairs(p.table(spark, d, "part").select(F.lower("p_type").alias("t")), "t", 0.75)


@query("R5_dependency_check", "select distinct p_type as dep from part where p_partkey % 3 = 0 and p_type not in (select p_type from part where p_partkey % 400 = 1)")
def dependency(spark, d):
    from .joins import dependencies

    return dependencies(spark, d)


@query("C9_semantic_change", "select o_orderkey as id, o_orderkey % 4 in (1, 2) as changed from orders")
def semantic(spark, d):
    from .change import versions

    x = versions(spark, d)
    return x.select("id", (s.strip_comments(F.col("old_body")) != s.strip_comments(F.col("new_body"))).alias("changed"))


SHORT = """marked as (select *, case when ts - lag(ts) over (partition by user_id, event_type order by ts, event_id) < interval 120 minute then 0 else 1 end as new from events),
grouped as (select *, sum(new) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as s from marked)"""


@query("ST2_signal_debounce", "select user_id, event_type, min(ts) as first_at, max(ts) + interval 120 minute as fires_at, count(*) as signals, max_by(value, (ts, event_id)) as value from grouped group by user_id, event_type, s", SHORT)
def signal(spark, d):
    return st.debounce(p.table(spark, d, "events"), ["user_id", "event_type"], "ts", ["value"], "120 minutes", "event_id")


@query("ST3_prefetch_limit", "select event_id from (select event_id, count(*) over (partition by event_type order by ts range between interval 10 minute preceding and current row) as n from events) where n <= 2")
def prefetch(spark, d):
    return st.sliding_usage(p.table(spark, d, "events"), ["event_type"], "ts", "value", 600).where("requests <= 2").select("event_id")


@query("ST10_incremental", "select o_orderkey as id, case when o_custkey % 10 = 0 then o_totalprice + 1 else o_totalprice end as price from orders where o_custkey % 10 <> 0 or o_orderkey % 2 = 0")
def incremental(spark, d):
    o = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("file_path"))
    batch = o.where("file_path % 10 = 0 and id % 2 = 0").withColumn("price", F.col("price") + 1)
    return st.changed_files(o, batch, o.where("file_path % 10 = 0").select("file_path")).select("id", "price")


@query("V13_rerank", "select p_partkey as id from part order by p_size desc, p_partkey limit 10")
def rerank(spark, d):
    return providers.rerank(p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("score")), None, 10).select("id")


@query("X5_tool_get_callers", "select distinct e.src as id from edges e where e.kind in ('calls', 'references') and e.dst = (select id from entities where contains(lower(name), lower('#100')) or contains(lower(signature), lower('#100')) order by 4.0 / length(name) desc, id limit 1)", p.ENTITIES, p.EDGES)
def tool(spark, d):
    return TOOLS["get_callers"](Repo(entities=p.entities(spark, d), edges=p.edges(spark, d)), name="#100").select("id").distinct()


NAMED = "named as (select id from entities where contains(lower(name), lower('#100')) or contains(lower(signature), lower('#100')) order by 4.0 / length(name) desc, id limit 1)"


def repo(spark, d):
    return Repo(entities=p.entities(spark, d), edges=p.edges(spark, d), justifications=p.justifications(spark, d), vectors=p.vectors(spark, d))


@query("X5_tool_get_callees", "select distinct e.dst as id from edges e join named on e.src = named.id where e.kind in ('calls', 'references')", p.ENTITIES, p.EDGES, NAMED)
def tool_callees(spark, d):
    return TOOLS["get_callees"](repo(spark, d), name="#100").select("id").distinct()


@query("X5_tool_search_code", "select id from entities where contains(lower(name), 'part#1') or contains(lower(signature), 'part#1') order by 6.0 / length(name) desc, id limit 20", p.ENTITIES)
def tool_search(spark, d):
    return TOOLS["search_code"](repo(spark, d), query="Part#1").select("id")


@query("X5_tool_get_file", "select id, name from entities where file_path = (select min(file_path) from entities)", p.ENTITIES)
def tool_file(spark, d):
    path = p.entities(spark, d).agg(F.min("file_path")).first()[0]  # one value
    return TOOLS["get_file"](repo(spark, d), path=path).select("id", "name")


@query("X5_tool_project_stats", "select count(*) filter (kind in ('function', 'method')) as functions, count(*) filter (kind = 'class') as classes, count(distinct file_path) as files from entities", p.ENTITIES)
def tool_stats(spark, d):
    return TOOLS["get_project_stats"](repo(spark, d)).select("functions", "classes", "files")


@query("X5_tool_find_similar", "select id from vectors where id <> 7 order by list_cosine_similarity(v, (select v from vectors where id = 7)) desc, id limit 10", p.VECTORS)
def tool_similar(spark, d):
    return TOOLS["find_similar"](repo(spark, d), id=7).select("id")


@query("X5_tool_business_context", "select entity_id, feature_tag, taxonomy from justifications join named on entity_id = named.id", p.ENTITIES, p.JUSTIFICATIONS, NAMED)
def tool_context(spark, d):
    return TOOLS["get_business_context"](repo(spark, d), name="#100").select("entity_id", "feature_tag", "taxonomy")


@query("X5_tool_sync_local_diff", "select id, start_line + case when start_line > 10 then 4 else 0 end as start_line from entities where file_path = (select min(file_path) from entities)", p.ENTITIES)
def tool_diff(spark, d):
    path = p.entities(spark, d).agg(F.min("file_path")).first()[0]  # one value
    return TOOLS["sync_local_diff"](repo(spark, d), path=path, hunks=[(10, 4)]).select("id", "start_line")


@query("X5_tool_analyze_impact", "select coalesce(taxonomy, 'unknown') as taxonomy, count(*) as entities from (select distinct id from hit where depth > 0) h left join justifications on entity_id = h.id group by 1", p.ENTITIES, p.EDGES, p.JUSTIFICATIONS, NAMED,
  "hit(id, depth) as (select id, 0 from named union select e.src, h.depth + 1 from hit h join edges e on e.dst = h.id where e.kind in ('calls', 'references') and h.depth < 3)")
def tool_impact(spark, d):
    return TOOLS["analyze_impact"](repo(spark, d), name="#100", hops=3)


@query("X7_batch_processing", "select p_partkey as id, upper(p_name) as result from part")
def batches(spark, d):
    return providers.process_batches(p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), lambda xs: [x.upper() for x in xs], "p_name")


@query("FN_identifiers", "select p_partkey as id, array_to_string(string_split(lower(p_type), ' '), ',') as parts from part")
def identifiers(spark, d):
    camel = F.regexp_replace(F.initcap(F.lower("p_type")), " ", "")
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(s.split_identifier(camel), ",").alias("parts"))


@query("FN_levenshtein", "select p_partkey as id, round(1 - levenshtein(p_type, p_brand)::double / greatest(length(p_type), length(p_brand)), 6) as similarity from part")
def levenshtein(spark, d):
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(s.levenshtein_similarity(F.col("p_type"), F.col("p_brand")), 6).alias("similarity"))


@query("FN_hashes", "select p_partkey as id, left(sha256(p_name), 16) as h16, left(sha256(p_name), 32) as h32, left(sha256('a' || chr(0) || p_name || chr(0) || 'calls'), 16) as edge from part")
def hashes(spark, d):
    h = F.sha2("p_name", 256)
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.substring(h, 1, 16).alias("h16"), F.substring(h, 1, 32).alias("h32"), s.edge_id(F.lit("a"), F.col("p_name"), F.lit("calls")).alias("edge"))


@query("FN_math", "select o_orderkey as id, floor(o_totalprice / 7 * 100 + 0.5) / 100 as half_up, ceil(o_totalprice / 3.5)::bigint as tokens, greatest(0, least(1, o_totalprice / 100000)) as clamped, round(log2(o_totalprice + 1), 6) as lg from orders")
def math(spark, d):
    x = F.col("o_totalprice")
    return p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.round_half_up(x / 7, 2).alias("half_up"), F.ceil(x / 3.5).alias("tokens"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 100000)).alias("clamped"), F.round(F.log2(x + 1), 6).alias("lg"))


@query("FN_dates", "select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso, epoch(o_orderdate)::bigint as secs, o_orderdate >= timestamp '1998-08-02' - interval 90 day as recent from orders")
def dates(spark, d):
    t = F.col("o_orderdate")
    return p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp(t).alias("secs"), (t >= F.lit("1998-08-02").cast("timestamp_ntz") - F.expr("interval 90 days")).alias("recent"))


@query("FN_json", "select event_id, json_extract(props, '$.k')::bigint as k, '{\"k\":' || json_extract(props, '$.k') || '}' as back from events")
def json(spark, d):
    v = F.from_json("props", "k long")
    return p.table(spark, d, "events").select("event_id", v["k"].alias("k"), F.to_json(v).alias("back"))


@query("FN_arrays", "select doc_id, len(string_split(text, ' ')) as n, string_split(text, ' ')[1] as first, list_contains(string_split(text, ' '), 'the') as has_the from documents")
def arrays(spark, d):
    w = F.split("text", " ", -1)
    return p.table(spark, d, "documents").select("doc_id", F.size(w).alias("n"), F.element_at(w, 1).alias("first"), F.array_contains(w, "the").alias("has_the"))


@query("FN_maps", "select o_orderstatus as status, string_agg(o_orderpriority || '=' || n, ',' order by o_orderpriority) as breakdown from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2) group by 1")
def maps(spark, d):
    n = p.table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    mp = F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderpriority", F.col("n").cast("string").alias("n")))))
    e = F.transform(F.map_entries(F.transform_values("m", lambda k, v: F.concat(k, F.lit("="), v))), lambda x: x["value"])
    return n.groupBy(F.col("o_orderstatus").alias("status")).agg(mp.alias("m")).select("status", F.array_join(e, ",").alias("breakdown"))


@query("FN_complexity", "select p_partkey as id, 1 + p_size % 4 as complexity from part")
def complexity(spark, d):
    body = F.concat(F.lit("f() { // if (no)\n"), F.repeat(F.lit("if (a) { b() }\n"), (F.col("p_size") % 4).cast("int")), F.lit("}"))
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.cyclomatic(body).alias("complexity"))


@query("FN_cognitive", "select p_partkey as id, (p_size % 4 * (p_size % 4 + 1) / 2)::int + 2 as complexity from part")
def cognitive(spark, d):
    """Ifs nested as deep as asked for cost 1, 2, 3; then an else and an operator."""
    n = (F.col("p_size") % 4).cast("int")
    body = F.concat(F.repeat(F.lit("if (a) {\n"), n), F.repeat(F.lit("}\n"), n), F.lit("else {\n} // if (x && y)\nx = a && 'if (b)'\n"))
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.cognitive(body).alias("complexity"))


@query("R11_review_comments", """select l_orderkey as review, count(*) filter (l_returnflag = 'R') as errors, count(*) filter (l_returnflag <> 'R') as warnings from lineitem group by 1""")
def review_comments(spark, d):
    from ..operators import review

    f = p.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review"), F.lit("pattern").alias("check"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("severity"), F.col("l_partkey").cast("string").alias("file_path"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("message"))
    return review.review_comments(f, ["review"]).select("review", "errors", "warnings")


@query("FN_payload_lists", "select o_custkey as id, least(count(*), case when sum(length(o_orderkey::varchar) + 1) > 60 then 20 else count(*) end) as callers from orders group by 1")
def payload_lists(spark, d):
    from ..operators import review

    o = p.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("callers"), F.sum(F.length(F.col("o_orderkey").cast("string")) + 1).alias("n"))
    small, large = o.where("n <= 60").drop("n"), o.where("n > 60").drop("n")
    return review.cap_payload(small, 10_000).unionByName(review.cap_payload(large, 60)).select("id", F.size("callers").cast("long").alias("callers"))


@query("FN_payload_cap", "select doc_id, left(text, 200) as body, length(text) > 200 as truncated from documents")
def payload(spark, d):
    return p.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("body"), (F.length("text") > 200).alias("truncated"))


@query("FN_doc_comments", "select p_partkey as id, 'note ' || p_partkey as doc, p_partkey % 3 = 0 as todo from part")
def doc_comments(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("/** note "), k, F.lit(" */\nfunction f() {}\n"), F.when(F.col("p_partkey") % 3 == 0, "// TODO: later").otherwise("// fine"))
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.trim(F.regexp_extract(text, r"(?s)/\*\*(.*?)\*/", 1)).alias("doc"), text.rlike(r"\b(?:TODO|FIXME|HACK|XXX)\b").alias("todo"))


@query("D16_variants", "select id, v from (select id || '' as id, 'text' as v from vectors union all select id || '::code', 'code' from vectors)", p.VECTORS)
def variants(spark, d):
    k = F.col("id").cast("string")
    both = F.explode(F.array(F.struct(k.alias("id"), F.lit("text").alias("v")), F.struct(F.concat(k, F.lit("::code")).alias("id"), F.lit("code").alias("v"))))
    return p.vectors(spark, d).select(both.alias("x")).select("x.id", "x.v")


@query("C17_deprecations", "select o_orderkey as id, o_custkey % 10 < 3 as deprecate from orders")
def deprecations(spark, d):
    k = F.col("o_custkey") % 10
    score = c.decay_score(F.lit(100), F.when(k < 3, 100).otherwise(0), F.when(k < 3, 80).otherwise(0), F.lit(100), F.lit(0))
    return p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (score < 0.4).alias("deprecate"))


@query("S16_pattern_catalog", "select * from (values ('p1', 'eval\\(', 'error'), ('p2', 'TODO', 'warning')) t(id, regex, severity)")
def catalog(spark, d):
    text = "- id: p1\n  regex: 'eval\\('\n  severity: error\n- id: p2\n  regex: TODO\n  severity: warning\n"
    return workspace.load_catalog(spark, text).select("id", "regex", "severity")


@query("FN_name_phrases", "select p_partkey as id, case p_partkey % 3 when 0 then 'fetches ' when 1 then 'notifies ' else 'processes ' end || p_name as phrase from part")
def phrases(spark, d):
    verb = F.get(F.array(*map(F.lit, ["fetch", "notify", "process"])), (F.col("p_partkey") % 3).cast("int"))
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), texts.name_phrase(F.concat_ws("_", verb, F.regexp_replace("p_name", " ", "_"))).alias("phrase"))


@query("FN_body_summaries", "select p_partkey as id, 'if (x) {' || chr(10) || '[SETUP: 3 lines]' || chr(10) || 'return ' || p_size as summary from part")
def summaries(spark, d):
    body = F.concat(F.lit("if (x) {\nconst a = 1\nlet b = 2\nvar c = 3\nreturn "), F.col("p_size").cast("string"))
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), texts.summarize(body, 40).alias("summary"))


@query("ST14_resumable_steps", "select event_type, count(*) as n from events where value > 50 group by 1")
def resumable(spark, d):
    folder = f"{lineage.shared_dir(spark)}/graphloom/steps-{uuid.uuid4().hex}"
    first = ("select", lambda s, _: p.table(s, d, "events").where("value > 50").select("event_type"))
    steps.run_steps(spark, folder, "run", [first])
    return steps.run_steps(spark, folder, "run", [first, ("count", lambda s, rows: rows.groupBy("event_type").agg(F.count("*").alias("n")))])[0]
