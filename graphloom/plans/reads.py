"""Scans, filters, projections, ordering, paging, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import graph as g
from ..operators import joins as j
from ..operators import windows as w
from ..sources import code
from ..sources import projections as p
from .base import query

G = (p.ENTITIES, p.EDGES)


@query("S4_languages", """select case split_part(p_name, '#', 1) when '' then 'unknown' else case p_partkey % 4 when 0 then 'typescript' when 1 then 'python' when 2 then 'go' else 'unknown' end end as language, count(*) as files from part group by 1""")
def languages(spark, d):
    ext = F.get(F.array(*map(F.lit, [".ts", ".py", ".go", ".xyz"])), (F.col("p_partkey") % 4).cast("int"))
    paths = p.table(spark, d, "part").select(F.concat(F.lit("src/a"), ext).alias("path"))
    return paths.groupBy(code.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


@query("S2_ignore_filter", "select p_partkey as id from part where p_partkey % 5 not in (0, 1)")
def ignored(spark, d):
    where = F.get(F.array(*map(F.lit, ["node_modules/x/a.js", ".git/config", "src/a.ts", "lib/deep/b.py", "main.go"])), (F.col("p_partkey") % 5).cast("int"))
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), where.alias("path")).where(~code.ignored(F.col("path"))).select("id")


@query("S9_commit_log", "select o_orderkey::varchar as sha, o_custkey::varchar as author, epoch(o_orderdate)::bigint as ts, o_orderpriority as subject, l_partkey::varchar as file from (select distinct l_orderkey, l_partkey from lineitem) join orders on o_orderkey = l_orderkey")
def commit_log(spark, d):
    files = p.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), "\n").alias("files"))
    o = p.table(spark, d, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"))
    head = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), "o_orderpriority", F.col("o_custkey").cast("string"), F.unix_timestamp("o_orderdate").cast("string"))
    return code.parse_commit_log(o.select(F.concat(head, F.lit("\n\n"), "files", F.lit("\n")).alias("value"))).select("sha", "author", "ts", "subject", "file")


@query("S11_diff_hunks", "select 'src/' || o_orderkey || '.ts' as file, (o_custkey % 50 + 1)::int as start, (o_custkey % 7 + 1)::int as count from orders")
def hunks(spark, d):
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("diff --git a/x b/x\n+++ b/src/"), k, F.lit(".ts\n@@ -1,2 +"), (F.col("o_custkey") % 50 + 1).cast("string"), F.lit(","), (F.col("o_custkey") % 7 + 1).cast("string"), F.lit(" @@ fn\n+x\n"))
    return code.diff_hunks(p.table(spark, d, "orders").select(k.alias("id"), text.alias("diff"))).select("file", "start", "count")


@query("S12_all_entities", "select id, kind, name, file_path from entities where org_id = 'org' and repo_id = 'repo'", p.ENTITIES)
def all_entities(spark, d):
    return p.entities(spark, d).where("org_id = 'org' and repo_id = 'repo'").select("id", "kind", "name", "file_path")


@query("S13_all_edges", "select src, dst, kind from edges", *G)
def all_edges(spark, d):
    return p.edges(spark, d)


@query("S14_point_lookup", "select id, kind, name, file_path, start_line from entities where id = 77", p.ENTITIES)
def point(spark, d):
    return p.entities(spark, d).where("id = 77").select("id", "kind", "name", "file_path", "start_line")


@query("S15_row_source", "select o_orderkey as id, o_orderstatus as status, o_orderdate as created_at from orders where o_orderstatus = 'O' order by created_at desc, id limit 50")
def rows(spark, d):
    return p.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at")).orderBy(F.desc("created_at"), "id").limit(50)


@query("D8_entity_ids", "select p_partkey as id, left(sha256('repo' || chr(0) || p_brand || chr(0) || p_type || chr(0) || p_name || chr(0) || ''), 16) as entity_id from part")
def entity_ids(spark, d):
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.entity_id(F.lit("repo"), F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.lit(None).cast("string")).alias("entity_id"))


@query("F1_tenant", "select count(*) as n from entities where org_id = 'org' and repo_id = 'repo'", p.ENTITIES)
def tenant(spark, d):
    return p.entities(spark, d).where("org_id = 'org' and repo_id = 'repo'").agg(F.count("*").alias("n"))


@query("F2_entities_by_file", "select id, name, start_line from entities where file_path like 'src/Brand#11/%' order by start_line", p.ENTITIES)
def by_file(spark, d):
    return p.entities(spark, d).where(F.startswith("file_path", F.lit("src/Brand#11/"))).select("id", "name", "start_line").orderBy("start_line", "id")


@query("F3_rules", "select o_orderkey as id, o_orderpriority as scope from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH') order by o_totalprice desc, id limit 100")
def rules(spark, d):
    asked = {"o_orderstatus": "O"}
    df = p.table(spark, d, "orders")
    for c, v in asked.items():
        df = df.where(F.col(c) == v)
    return df.where(F.array_contains(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.col("o_orderpriority"))).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("scope"))


@query("F4_patterns", "select p_partkey as id, p_brand from part where p_size >= 25 and p_brand = 'Brand#11'")
def patterns(spark, d):
    return p.table(spark, d, "part").where("p_size >= 25 and p_brand = 'Brand#11'").select(F.col("p_partkey").alias("id"), "p_brand")


@query("F5_by_hash", "select p_partkey as id from part where left(sha256(p_name), 2) = 'ab'")
def by_hash(spark, d):
    return p.table(spark, d, "part").where(F.substring(F.sha2("p_name", 256), 1, 2) == "ab").select(F.col("p_partkey").alias("id"))


@query("F6_substring", "select id, name from entities where contains(lower(name), lower('T#1')) or contains(lower(signature), lower('T#1'))", p.ENTITIES)
def substring(spark, d):
    q = F.lower(F.lit("T#1"))
    return p.entities(spark, d).where(F.contains(F.lower("name"), q) | F.contains(F.lower("signature"), q)).select("id", "name")


@query("F7_not_in", "select o_orderkey as id from orders where o_orderstatus not in ('F', 'P')")
def not_in(spark, d):
    return p.table(spark, d, "orders").where(~F.col("o_orderstatus").isin("F", "P")).select(F.col("o_orderkey").alias("id"))


@query("F8_regex", "select id from entities where regexp_matches(file_path, '(?i)(steel|brass)')", p.ENTITIES)
def regex(spark, d):
    return p.entities(spark, d).where(F.col("file_path").rlike("(?i)(steel|brass)")).select("id")


@query("F9_prefix", "select id from entities where starts_with(file_path, 'src/Brand#2')", p.ENTITIES)
def prefix(spark, d):
    return p.entities(spark, d).where(F.startswith("file_path", F.lit("src/Brand#2"))).select("id")


@query("F10_path_classes", "select case p_partkey % 4 when 0 then 'test' when 1 then 'entry' when 2 then 'config' else 'other' end as class, count(*) as n from part group by 1")
def classes(spark, d):
    path = F.get(F.array(*map(F.lit, ["src/__tests__/a.ts", "app/api/x/route.ts", "vite.config.ts", "lib/a.ts"])), (F.col("p_partkey") % 4).cast("int"))
    return p.table(spark, d, "part").groupBy(code.path_class(path).alias("class")).agg(F.count("*").alias("n"))


@query("F11_glob_rules", "select id, case when file_path like 'src/Brand#11/%' then 1 else 0 end + case when regexp_matches(file_path, '^src/[^/]*/[^/]*/[^/]*\\.ts$') then 1 else 0 end as rules from entities", p.ENTITIES)
def globs(spark, d):
    return p.entities(spark, d).select("id", sum(F.rlike(F.col("file_path"), j.glob_regex(F.lit(x))).cast("int") for x in ("src/Brand#11/**", "src/*/*/*.ts")).alias("rules"))


@query("F12_line_in_hunk", "select count(*) as n from part where p_partkey % 97 + 1 between 10 and 20 or p_partkey % 97 + 1 between 50 and 55")
def in_hunk(spark, d):
    hunks_ = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ((10, 20), (50, 55))])
    line = F.col("p_partkey") % 97 + 1
    return p.table(spark, d, "part").where(F.exists(hunks_, lambda h: (line >= h["s"]) & (line <= h["e"]))).agg(F.count("*").alias("n"))


@query("F13_exemptions", "select p_partkey as id from part where p_partkey % 6 <> 0 and p_brand <> 'Brand#11'")
def exempt(spark, d):
    part = p.table(spark, d, "part")
    exceptions = part.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("x_id"), F.lit(None).cast("string").alias("x_brand"), F.lit(True).alias("active"))
    brands = part.where("p_brand = 'Brand#11'").select(F.lit(None).cast("long").alias("x_id"), F.col("p_brand").alias("x_brand"), F.lit(True).alias("active")).distinct()
    # One anti-join per kind of exception: equi-joins instead of one with OR.
    left = part.join(exceptions.where("active").select("x_id"), F.col("p_partkey") == F.col("x_id"), "left_anti")
    return left.join(brands.where("active").select("x_brand"), F.col("p_brand") == F.col("x_brand"), "left_anti").select(F.col("p_partkey").alias("id"))


@query("F14_branch_patterns", "select o_orderkey as id from orders where o_orderpriority = '1-URGENT' or o_orderpriority like '3%' or o_orderpriority like '%LOW'")
def branches(spark, d):
    c = F.col("o_orderpriority")
    pats = F.array(*map(F.lit, ["1-URGENT", "3*", "*LOW"]))
    fits = lambda x: (x == c) | (F.endswith(x, F.lit("*")) & F.startswith(c, F.replace(x, F.lit("*"), F.lit("")))) | (F.startswith(x, F.lit("*")) & F.endswith(c, F.replace(x, F.lit("*"), F.lit(""))))
    return p.table(spark, d, "orders").where(F.exists(pats, fits)).select(F.col("o_orderkey").alias("id"))


@query("F15_external_packages", "select case p_partkey % 4 when 0 then '@scope/pkg' when 1 then 'lodash' when 2 then null else 'os' end as package, count(*) as n from part group by 1")
def packages(spark, d):
    k = (F.col("p_partkey") % 4).cast("int")
    imp = F.get(F.array(*map(F.lit, ["@scope/pkg/sub", "lodash/fp", "./local", "os.path"])), k)
    lang = F.get(F.array(*map(F.lit, ["typescript", "typescript", "typescript", "python"])), k)
    return p.table(spark, d, "part").groupBy(code.external_package(imp, lang).alias("package")).agg(F.count("*").alias("n"))


@query("F16_named_only", "select count(*) as n from documents d left join labels l using (doc_id) where l.quality is not null")
def named(spark, d):
    return p.table(spark, d, "documents").select("doc_id").join(p.table(spark, d, "labels"), "doc_id", "left").dropna(subset=["quality"]).agg(F.count("*").alias("n"))


@query("F17_valid_vectors", "select id from vectors where len(v) > 0", p.VECTORS)
def valid(spark, d):
    return p.vectors(spark, d).where((F.size("v") > 0) & F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).select("id")


@query("F18_overlay_ids", "select 'branch:x:' || id as id, name from entities", p.ENTITIES)
def overlay_ids(spark, d):
    return p.entities(spark, d).select(F.concat(F.lit("branch:x:"), F.col("id").cast("string")).alias("id"), "name")


@query("F19_current_facts", "select user_id, event_type, event_id from scd where valid_to is null", p.SCD)
def current(spark, d):
    return p.scd(spark, d).where("valid_to is null").select("user_id", "event_type", "event_id")


@query("F20_capped_reads", "select event_id from events where event_type = 'error' order by ts, event_id limit 500")
def capped(spark, d):
    return p.table(spark, d, "events").where("event_type = 'error'").orderBy("ts", "event_id").limit(500).select("event_id")


@query("F21_uncommitted", "select event_id, user_id from events where event_type not in ('purchase', 'error') and user_id = 7")
def uncommitted(spark, d):
    return p.table(spark, d, "events").where(~F.col("event_type").isin("purchase", "error") & (F.col("user_id") == 7)).orderBy("ts").select("event_id", "user_id")


@query("W1_percentile_rank", "select o_orderkey as id, round((row_number() over (order by o_totalprice, o_orderkey) - 1)::double / ((select count(*) from orders) - 1) * 100, 6) as percentile from orders")
def percentile(spark, d):
    o = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return g.percentile(o, "score", o.count()).select("id", F.round("percentile", 6).alias("percentile"))


@query("W2_latest_per_key", "select user_id, max_by(event_id, ts) as event_id, max(ts) as ts from events group by user_id")
def latest(spark, d):
    return w.latest(p.table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("W3_history", "select event_id, ts from events where user_id = 5 order by ts desc, event_id limit 100")
def history(spark, d):
    return p.table(spark, d, "events").where("user_id = 5").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")


@query("W4_rank_in_source", "select event_id, event_type, row_number() over (partition by event_type order by value desc, event_id) - 1 as rank from events")
def ranks(spark, d):
    return p.table(spark, d, "events").select("event_id", "event_type", (F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")) - 1).alias("rank"))


@query("W5_first_wins", "select lower(p_type) as title, p_partkey as id from part qualify row_number() over (partition by lower(p_type) order by p_size desc, p_partkey) = 1")
def first_wins(spark, d):
    return w.first_per_group(p.table(spark, d, "part").select(F.lower("p_type").alias("title"), F.col("p_partkey").alias("id"), "p_size"), ["title"], [F.desc("p_size"), "id"]).select("title", "id")


@query("W6_capped_groups", "select p_brand, string_agg(p_partkey::varchar, ',' order by p_partkey) as ids from (select *, row_number() over (partition by p_brand order by p_partkey) as rn from part) where rn <= 5 group by p_brand")
def capped_groups(spark, d):
    x = w.first_per_group(p.table(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 5)
    return x.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda v: v.cast("string")), ",").alias("ids"))


@query("W7_retention", "select o_orderkey as id from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1 or o_orderdate >= timestamp '1998-01-01'")
def retention(spark, d):
    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return p.table(spark, d, "orders").withColumn("rn", rn).where("rn = 1 or o_orderdate >= timestamp '1998-01-01'").select(F.col("o_orderkey").alias("id"))


@query("W8_running_file", "select event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as current from events")
def running(spark, d):
    e = p.table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return w.carry_forward(e, ["user_id"], ["ts", "event_id"], "v", "current").select("event_id", "current")


@query("W9_token_batches", "select source, doc_id, tokens, batch from walk",
  "numbered as (select source, doc_id, ceil(length(text) / 3.5)::bigint as tokens, row_number() over (partition by source order by doc_id) as k from documents)",
  """walk(source, doc_id, tokens, k, batch, used, n) as (select source, doc_id, tokens, k, 0, tokens, 1 from numbered where k = 1
  union all select x.source, x.doc_id, x.tokens, x.k, case when w.used + x.tokens > 4000 or w.n >= 8 then w.batch + 1 else w.batch end,
  case when w.used + x.tokens > 4000 or w.n >= 8 then x.tokens else w.used + x.tokens end, case when w.used + x.tokens > 4000 or w.n >= 8 then 1 else w.n + 1 end
  from walk w join numbered x on x.source = w.source and x.k = w.k + 1)""")
def batches(spark, d):
    docs = p.table(spark, d, "documents").select("source", "doc_id", s.estimate_tokens(F.col("text")).alias("tokens"))
    return w.token_batches(docs, ["source"], "doc_id", "tokens", 4000)


@query("T1_top_by_distance", "select id from vectors order by list_dot_product(v, (select v from vectors where id = 3)) desc, id limit 10", p.VECTORS)
def top_distance(spark, d):
    v = p.vectors(spark, d)
    q = F.broadcast(v.where("id = 3").select(F.col("v").alias("q")))
    return v.join(q, how="inner").orderBy(F.desc(s.dot(F.col("v"), F.col("q"))), "id").limit(10).select("id")


@query("T2_top_by_score", "select p_partkey as id, p_name from part order by p_retailprice desc, p_name limit 25")
def top_score(spark, d):
    # Rows of equal price and name, which the SQL leaves open, go by their key: the first ones of a table in its order.
    return p.table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_name", "p_partkey").limit(25).select(F.col("p_partkey").alias("id"), "p_name")


@query("T3_multi_key", "select o_orderkey as id from orders order by case o_orderstatus when 'O' then 3 when 'P' then 2 else 1 end desc, o_totalprice desc, o_orderkey limit 40")
def multi_key(spark, d):
    rank = F.when(F.col("o_orderstatus") == "O", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return p.table(spark, d, "orders").orderBy(F.desc(rank), F.desc("o_totalprice"), "o_orderkey").limit(40).select(F.col("o_orderkey").alias("id"))


@query("T4_severity_order", "select o_orderkey as id from orders order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 0 when '3-MEDIUM' then 1 else 2 end, o_orderkey limit 3")
def severity_order(spark, d):
    sev = s.severity(F.col("o_orderpriority"))
    return p.table(spark, d, "orders").orderBy(F.when(sev == "high", 0).when(sev == "medium", 1).otherwise(2), "o_orderkey").limit(3).select(F.col("o_orderkey").alias("id"))


@query("T5_page", "select p_partkey as id, p_name, (select count(*) from part) as total from part order by p_name, p_partkey limit 20 offset 40")
def page(spark, d):
    return w.page(p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), ["p_name", "id"], 40, 20)


@query("T6_keyset", "select event_id, ts from events where ts < (select ts from events where event_id = 100) order by ts desc, event_id desc limit 21")
def keyset(spark, d):
    e = p.table(spark, d, "events").select("event_id", "ts")
    cursor = F.broadcast(e.where("event_id = 100").select(F.col("ts").alias("cursor")))
    return w.keyset(e.join(cursor, F.col("ts") < F.col("cursor")), "ts", "event_id", F.col("cursor"), 20).select("event_id", "ts")


@query("T7_recent", "select event_id from events order by ts desc, event_id limit 30")
def recent(spark, d):
    return p.table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(30).select("event_id")


@query("U1_union", "select id, kind from entities where kind = 'class' union all select id, kind from entities where kind = 'interface'", p.ENTITIES)
def union(spark, d):
    e = p.entities(spark, d).select("id", "kind")
    return e.where("kind = 'class'").unionByName(e.where("kind = 'interface'"), allowMissingColumns=True)


@query("U2_union_distinct", "select src as id from edges union select dst from edges", *G)
def union_distinct(spark, d):
    e = p.edges(spark, d)
    return e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct()


@query("U3_jaccard", "select a.conv_id, round(len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))), 6) as similarity from (select conv_id, list_distinct(string_split(text, ' ')) as w from conversations where turn = 0) a join (select conv_id, list_distinct(string_split(text, ' ')) as w from conversations where turn = 1) b on a.conv_id = b.conv_id")
def jaccard(spark, d):
    c = p.table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("w"))
    a, b = c.where("turn = 0").select("conv_id", F.col("w").alias("a")), c.where("turn = 1").select("conv_id", F.col("w").alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.round(s.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("U4_difference", "select src as id from edges except select dst from edges where kind = 'calls'", *G)
def difference(spark, d):
    e = p.edges(spark, d)
    return e.select(F.col("src").alias("id")).distinct().join(e.where("kind = 'calls'").select(F.col("dst").alias("id")), "id", "left_anti")
