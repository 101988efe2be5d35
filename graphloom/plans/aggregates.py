"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import change as c
from ..operators import graph as g
from ..operators import joins as j
from ..operators import reports as r
from ..sources import projections as p
from .base import query

G = (p.ENTITIES, p.EDGES)


def text_list(c):
    return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")


@query("A1_project_stats", """select count(*) filter (kind in ('function', 'method')) as functions, count(*) filter (kind = 'class') as classes, count(*) filter (kind = 'interface') as interfaces,
  count(*) filter (kind = 'variable') as variables, count(distinct file_path) as files from entities""", p.ENTITIES)
def stats(spark, d):
    return r.project_stats(p.entities(spark, d))


@query("A2_counts_by_collection", "select case kind when 'class' then 'classes' when 'interface' then 'interfaces' when 'variable' then 'variables' else 'functions' end as collection, count(*) as n from entities group by 1", p.ENTITIES)
def counts(spark, d):
    return r.collection_counts(p.entities(spark, d))


@query("A3_file_paths", "select distinct file_path from entities", p.ENTITIES)
def paths(spark, d):
    return r.file_paths(p.entities(spark, d))


@query("A4_token_usage", """select coalesce(l_returnflag, 'total') as model, sum(l_quantity) as tokens, count(*) as calls,
  round(sum(l_quantity * case l_returnflag when 'A' then 0.8 when 'N' then 3.0 else 1.0 end) / 1000000, 6) as cost from lineitem group by rollup (l_returnflag)""")
def usage(spark, d):
    return r.token_usage(p.table(spark, d, "lineitem"), {"A": 0.8, "N": 3.0}, 1.0, "l_returnflag", "l_quantity")


@query("A5_max_branch", "select coalesce(max(user_id), 0) as branch from events where event_type = 'error'")
def max_branch(spark, d):
    return r.max_branch(p.table(spark, d, "events").where("event_type = 'error'"), "user_id")


FAN = """fan as (select e.id, e.name, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out from entities e
  left join (select dst, count(*) as n from edges where kind = 'calls' group by dst) i on i.dst = e.id left join (select src, count(*) as n from edges where kind = 'calls' group by src) o on o.src = e.id
  where e.kind in ('function', 'method'))"""


@query("A6_fan_risk", "select id, name, fan_in, fan_out, case when greatest(fan_in, fan_out) >= 10 then 'high' when greatest(fan_in, fan_out) >= 5 then 'medium' else 'normal' end as risk_level from fan", *G, FAN)
def fan_risk(spark, d):
    return g.fan(p.edges(spark, d), p.entities(spark, d)).select("id", "name", "fan_in", "fan_out", "risk_level")


@query("A7_features", """select a.*, e.entry_points from (select feature_tag, count(*) as entity_count, count(*) filter (taxonomy = 'VERTICAL') as vertical, count(*) filter (taxonomy = 'HORIZONTAL') as horizontal,
  count(*) filter (taxonomy = 'UTILITY') as utility, round(avg(confidence), 6) as average_confidence from justifications group by 1) a
  left join (select feature_tag, string_agg(entity_id::varchar, ',' order by entity_id) as entry_points from (select feature_tag, entity_id, row_number() over (partition by feature_tag order by entity_id) as rn from justifications
    where entity_id in (select id from entities) and (entity_id not in (select dst from edges where kind = 'calls') or entity_id in (select dst from from_outside))) where rn <= 10 group by 1) e on e.feature_tag = a.feature_tag""",
  *G, p.JUSTIFICATIONS, "from_outside as (select e.dst from edges e join justifications t on t.entity_id = e.dst left join justifications c on c.entity_id = e.src where e.kind = 'calls' and c.feature_tag is distinct from t.feature_tag)")
def features(spark, d):
    x = r.features(p.justifications(spark, d), p.entities(spark, d), p.edges(spark, d))
    return x.withColumn("average_confidence", F.round("average_confidence", 6)).withColumn("entry_points", text_list(F.col("entry_points")))


@query("A8_feature_counts", "select feature_tag, count(*) as entity_count, round(avg(confidence), 6) as average_confidence from justifications group by feature_tag", p.JUSTIFICATIONS)
def feature_counts(spark, d):
    return r.feature_counts(p.justifications(spark, d)).withColumn("average_confidence", F.round("average_confidence", 6))


COCHANGE = """per as (select file, count(*) as n from commits group by file),
pairs as (select a.file as a, b.file as b, count(*) as support from commits a join commits b on a.sha = b.sha and a.file < b.file group by 1, 2)"""


def cochange_sql(conf: float) -> str:
    return f"""select a, b, support, round(support::double / pa.n, 9) as confidence, round(support::double / (pa.n + pb.n - support), 9) as jaccard
  from pairs join per pa on pa.file = a join per pb on pb.file = b where support >= 3 and support::double / pa.n >= {conf} and pa.n >= 2 and pb.n >= 2"""


def cochange_of(commits, conf: float):
    c = j.co_occurrence(commits, "sha", "file", 3).where("n_a >= 2 and n_b >= 2")
    c = c.withColumn("confidence", F.col("support") / F.col("n_a")).where(F.col("confidence") >= conf)
    return c.select("a", "b", "support", F.round("confidence", 9).alias("confidence"), F.round(F.col("support") / (F.col("n_a") + F.col("n_b") - F.col("support")), 9).alias("jaccard"))


@query("A9_cochange", cochange_sql(0.05), p.commits_sql(), COCHANGE)
def cochange(spark, d):
    return cochange_of(p.commits(spark, d), 0.05)


@query("A9b_cochange_by_type", cochange_sql(0.3), p.commits_sql("p_type"), COCHANGE)
def cochange_type(spark, d):
    return cochange_of(p.commits(spark, d, "p_type"), 0.3)


AS_OF = 1_700_000_000  # an instant given to the query, never the clock


@query("A10_temporal_context", """select file, sum(n)::bigint as change_frequency, sum(recent)::bigint as recent_change_frequency, count(*) as author_count,
  round(sum((n / total) * (n / total)), 6) as author_concentration, round(greatest(0, least(1, 1 - sum(recent) / sum(n))), 6) as stability_score, max(last) as last_changed_at
  from (select file, author, count(*)::double as n, count(*) filter (ts >= (select max(ts) from commits) - 90 * 86400)::double as recent, max(ts) as last, sum(count(*)) over (partition by file)::double as total from commits group by file, author) group by file""", p.commits_sql())
def temporal(spark, d):
    c = p.commits(spark, d)
    now = F.broadcast(c.agg((F.max("ts") - 90 * 86400).alias("since")))
    per = c.join(now, how="left").groupBy("file", "author").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.col("since")).alias("recent"), F.max("ts").alias("last"))
    a = per.groupBy("file").agg(F.sum("n").alias("change_frequency"), F.sum("recent").alias("recent_change_frequency"), F.count("*").alias("author_count"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.max("last").alias("last_changed_at"))
    f = F.col("change_frequency")
    return a.select("file", "change_frequency", "recent_change_frequency", "author_count", F.round(F.col("sq") / (f * f), 6).alias("author_concentration"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("recent_change_frequency") / f)), 6).alias("stability_score"), "last_changed_at")


@query("A11_commit_intents", """select case o_orderkey % 5 when 0 then 'bugfix' when 1 then 'feature' when 2 then 'documentation' when 3 then 'maintenance' end as intent, count(*) as n from orders group by 1""")
def intents(spark, d):
    subject = F.get(F.array(*map(F.lit, ["Fix: add tests", "new readme", "update README", "bump deps", "prefixing buggy"])), (F.col("o_orderkey") % 5).cast("int"))
    return p.table(spark, d, "orders").groupBy(c.intent(subject).alias("intent")).agg(F.count("*").alias("n"))


@query("A13_domain_terms", """select term, n, case when n >= 300 then 'core' when n >= 100 then 'common' else 'rare' end as tier from
  (select term, count(*) as n from (select distinct p_partkey, unnest(string_split(lower(p_type), ' ')) as term from part) group by term having count(*) >= 2)""")
def terms(spark, d):
    return r.domain_terms(p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_type"), " ").alias("words")), 300, 100)


@query("A14_new_concepts", """select concept, count(*) as n from (select unnest(domain_concepts) as concept from justifications) where concept not in ('en', 'src1') group by concept having count(*) >= 3 order by n desc, concept limit 50""", p.JUSTIFICATIONS)
def concepts(spark, d):
    return r.new_concepts(p.justifications(spark, d), spark.createDataFrame([("en",), ("src1",)], "term string"))


@query("A15_drift_summary", "select event_type as category, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def drift_summary(spark, d):
    return r.category_summary(p.table(spark, d, "events"), "event_type", "value")


SEVERITY = "case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' else 'low' end"


def issues_of(spark, d):
    return p.table(spark, d, "orders").withColumn("severity", s.severity(F.col("o_orderpriority")))


@query("A16_issue_summary", f"""select o_orderstatus as category, count(*) filter (sev = 'high') as high, count(*) filter (sev = 'medium') as medium, count(*) filter (sev = 'low') as low,
  round(max(case sev when 'high' then 3.0 when 'medium' then 2.0 else 1.0 end * 40) + least(count(*), 50) / 50.0 * 30 + 0.5 * 30, 6) as priority,
  greatest(0, 100 - 15 * count(*) filter (sev = 'high') - 8 * count(*) filter (sev = 'medium') - 3 * count(*) filter (sev = 'low')) as health
  from (select *, {SEVERITY} as sev from orders) group by 1""")
def issues(spark, d):
    return r.issue_summary(issues_of(spark, d).withColumnRenamed("o_orderstatus", "category"))


@query("A17_health_grade", f"""select o_custkey as repo, case when h >= 3 then 'F' when h >= 1 then 'D' when m > 3 then 'C' when m > 0 then 'B' else 'A' end as grade from
  (select o_custkey, count(*) filter ({SEVERITY} = 'high') as h, count(*) filter ({SEVERITY} = 'medium') as m from orders group by 1)""")
def grade(spark, d):
    return r.health_grades(issues_of(spark, d).withColumnRenamed("o_custkey", "repo"), ["repo"])


@query("A18_adherence", "select round(avg(p_retailprice), 6) as average, count(*) filter (p_size > 40) as large from part")
def adherence(spark, d):
    return r.adherence(p.table(spark, d, "part"), "p_retailprice", F.col("p_size") > 40).withColumnRenamed("dead", "large")


@query("A19_impact_report", """select l_partkey as file, count(*) as findings, count(*) filter (l_returnflag = 'R') as errors,
  case when count(*) > 40 then 'large' when count(*) > 10 then 'medium' else 'small' end as effort from lineitem group by 1 order by findings desc, file limit 50""")
def impact_report(spark, d):
    severity = F.when(F.col("l_returnflag") == "R", "error").otherwise("warning")
    return r.impact_report(p.table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), severity.alias("severity")))


def members(spark, d, n: int):
    return p.entities(spark, d).select("id", "kind", (F.col("id") % n).alias("community"))


@query("A20_community_patterns", """select c as community, count(distinct id) as size, left(sha256(string_agg(id::varchar, ',' order by id::varchar)), 16) as motif, round(least(count(*) / 20.0, 1), 6) as confidence,
  (select count(*) from edges where src % 40 = c and dst % 40 = c) as internal_edges from (select id, id % 40 as c from entities) group by c having count(*) >= 3""", *G)
def patterns(spark, d):
    return r.community_patterns(members(spark, d, 40), p.edges(spark, d))


@query("A21_call_motifs", """select community, motif, n, round(least(n / total::double, 1), 6) as adherence from
  (select community, sk || '->' || dk as motif, count(*) as n from mine group by 1, 2 union all
   select a.community, a.sk || '->' || a.dk || '->' || b.dk, count(*) from mine a join mine b on b.src = a.dst and b.community = a.community group by 1, 2)
  join (select id % 2 as c, count(*) as total from entities where kind in ('function', 'method') group by 1 having count(*) >= 5) on c = community where n >= 3 and n >= 0.1 * total""",
  *G, "mine as (select e.src, e.dst, s.id % 2 as community, s.kind as sk, t.kind as dk from edges e join entities s on s.id = e.src join entities t on t.id = e.dst where e.kind = 'calls' and s.id % 2 = t.id % 2 and s.kind in ('function', 'method') and t.kind in ('function', 'method'))")
def motifs(spark, d):
    return r.call_motifs(members(spark, d, 2), p.edges(spark, d), 0.1)


@query("A22_pattern_stats", """select l_returnflag || l_linestatus as pattern, count(*) as matches, count(distinct l_partkey) as files, round(least(count(*) / count(distinct l_partkey)::double, 1), 6) as adherence,
  round(least(count(*) / 20.0, 0.95), 6) as confidence from lineitem group by 1""")
def pattern_stats(spark, d):
    return r.pattern_stats(p.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("pattern"), F.col("l_partkey").alias("file")))


@query("A23_top_concepts", """select feature_tag, concept, n from (select feature_tag, concept, count(*) as n, row_number() over (partition by feature_tag order by count(*) desc, concept) as rn
  from (select feature_tag, unnest(domain_concepts) as concept from justifications) group by 1, 2) where rn <= 3""", p.JUSTIFICATIONS)
def top_concepts(spark, d):
    return r.top_concepts(p.justifications(spark, d), ["feature_tag"], 3)


@query("A24_impact_by_taxonomy", "select j.taxonomy, count(*) as n from edges e join justifications j on j.entity_id = e.src where e.kind = 'calls' group by 1", *G, p.JUSTIFICATIONS)
def by_taxonomy(spark, d):
    return r.calls_by_taxonomy(p.edges(spark, d), p.justifications(spark, d))


@query("A25_ledger_summary", "select user_id as branch, count(*) as entries, count(distinct event_type) as files, sum(json_extract(props, '$.k')::bigint)::bigint as lines from events group by 1")
def ledger(spark, d):
    return r.ledger_summary(p.table(spark, d, "events").select(F.col("user_id").alias("branch"), F.col("event_type").alias("file"), F.get_json_object("props", "$.k").cast("long").alias("lines")))


@query("A26_rewind_radius", """select l_partkey as file, count(*) filter (l_orderkey > 100) as reverted, case when bool_or(l_orderkey <= 100) and bool_or(l_orderkey > 100) then 'conflicted' when bool_or(l_orderkey > 100) then 'at_risk' else 'safe' end as state from lineitem group by 1""")
def rewind(spark, d):
    return r.rewind_radius(p.table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), "l_orderkey"), F.col("l_orderkey") > 100)


@query("A27_hotspots", "select dst as id, name, count(*) as callers from edges e join entities v on v.id = e.dst where e.kind = 'calls' group by 1, 2 order by callers desc, id limit 20", *G)
def hotspots(spark, d):
    return r.hotspots(p.entities(spark, d), p.edges(spark, d))


@query("A28_staleness_histogram", "select case when quality is null then 'no_label' when confidence < 0.4 then 'low_quality' when quality = 0 then 'fallback' else 'none' end as reason, count(*) as n from justifications group by 1", p.JUSTIFICATIONS)
def staleness(spark, d):
    reason = F.when(F.col("quality").isNull(), "no_label").when(F.col("confidence") < 0.4, "low_quality").when(F.col("quality") == 0, "fallback").otherwise("none")
    return r.histogram(p.justifications(spark, d), reason=reason)


@query("A29_triples", "select distinct source as subject, 'written_in' as predicate, lang as object from documents")
def triples(spark, d):
    return r.distinct_triples(p.table(spark, d, "documents").select(F.col("source").alias("subject"), F.lit("written_in").alias("predicate"), F.col("lang").alias("object")))


@query("A30_file_tree", """select path, max(is_dir) as is_dir, count(*) as files from (select array_to_string(string_split(file_path, '/')[1:k], '/') as path, (k < len(string_split(file_path, '/')))::int as is_dir
  from entities, unnest([1, 2, 3, 4]) as t(k)) group by path""", p.ENTITIES)
def tree(spark, d):
    return r.file_tree(p.entities(spark, d))


@query("A31_distributions", "select kind, complexity // 10 as band, count(*) as n from entities group by 1, 2", p.ENTITIES)
def distributions(spark, d):
    return r.histogram(p.entities(spark, d), kind=F.col("kind"), band=F.floor(F.col("complexity") / 10))


@query("A32_signal_quality", "select count(*) as entities, count(j.entity_id) as justified, round(count(j.entity_id) * 100.0 / count(*), 6) as coverage from entities e left join justifications j on j.entity_id = e.id", p.ENTITIES, p.JUSTIFICATIONS)
def quality(spark, d):
    return r.signal_quality(p.entities(spark, d), p.justifications(spark, d))


@query("A33_import_resolution", "select (v.id is not null) as resolved, count(*) as n from edges e left join (select id from entities where kind <> 'variable') v on v.id = e.dst where e.kind = 'imports' group by 1", *G)
def resolution(spark, d):
    return r.import_resolution(p.edges(spark, d), p.entities(spark, d).where("kind <> 'variable'"))
