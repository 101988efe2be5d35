"""Change, quality, health and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import change as c
from ..operators import graph as g
from ..operators import health, reports
from ..operators import joins as j
from ..operators import windows as w
from ..sources import projections as p
from .base import query
from .graphs import CYCLES

G = (p.ENTITIES, p.EDGES)
VERSIONS = """versions as (select o_orderkey as id, 'f(a)' as old_sig, case when o_orderkey % 5 = 0 then 'f(a, b)' else 'f(a)' end as new_sig,
  'if (a) { return b }' as old_body, case o_orderkey % 4 when 0 then 'if (a) { return b } // note' when 1 then case when o_orderkey % 7 = 0 then 'if (a) { return b } expect(a)' else 'if (a) { return c }' end when 2 then 'if (a) { throw x; return b }' else 'if (a)  { return b }' end as new_body from orders)"""


def versions(spark, d):
    k = F.col("o_orderkey")
    body = F.get(F.array(*map(F.lit, ["if (a) { return b } // note", "if (a) { return c }", "if (a) { throw x; return b }", "if (a)  { return b }"])), (k % 4).cast("int"))
    body = F.when((k % 4 == 1) & (k % 7 == 0), "if (a) { return b } expect(a)").otherwise(body)
    return p.table(spark, d, "orders").select(k.alias("id"), F.lit("f(a)").alias("old_sig"), F.when(k % 5 == 0, "f(a, b)").otherwise("f(a)").alias("new_sig"), F.lit("if (a) { return b }").alias("old_body"), body.alias("new_body"), F.when(k % 7 == 0, "src/a.test.ts").otherwise("src/a.ts").alias("path"))


KIND = "case when old_sig <> new_sig then 'signature_changed' when id % 4 in (0, 3) then 'comments_only' when id % 7 = 0 and id % 4 = 1 then 'test_assertions' when id % 4 = 2 then 'anchors_changed' else 'body_refactor' end"


@query("C1_change_class", f"select id, {KIND} as change from versions", VERSIONS)
def change_class(spark, d):
    return versions(spark, d).select("id", c.classify_change(F.col("old_sig"), F.col("new_sig"), F.col("old_body"), F.col("new_body"), F.col("path")).alias("change"))


@query("C2_cascade_decision", f"select id, ({KIND}) in ('signature_changed', 'test_assertions', 'anchors_changed') or ({KIND}) = 'body_refactor' and id % 3 <> 0 as cascade from versions", VERSIONS)
def cascade(spark, d):
    v = versions(spark, d).withColumn("change", c.classify_change(F.col("old_sig"), F.col("new_sig"), F.col("old_body"), F.col("new_body"), F.col("path")))
    return v.select("id", c.cascades(F.col("change"), F.when(F.col("id") % 3 == 0, 0.99).otherwise(0.5)).alias("cascade"))


@query("C3_strip_comments", "select id, trim(regexp_replace(regexp_replace(new_body, '//.*$', '', 'gm'), '\\s+', ' ', 'g')) as code from versions", VERSIONS)
def strip(spark, d):
    return versions(spark, d).select("id", s.strip_comments(F.col("new_body")).alias("code"))


@query("C4_anchors", "select id, case when id % 4 = 2 then 'if (,return,throw' else 'if (,return' end as anchors from versions", VERSIONS)
def anchors(spark, d):
    return versions(spark, d).select("id", F.array_join(c.found(F.col("new_body"), c.ANCHORS), ",").alias("anchors"))


@query("C5_staleness", """select entity_id, case when quality is null then 'no_justification' when n_chars % 7 = 0 then 'body_changed' when confidence < 0.4 then 'low_quality' when quality = 0 then 'fallback'
  when n_chars % 90 > 30 then 'aged' when toxic = 1 then 'callee_changed' end as reason from justifications""", p.JUSTIFICATIONS)
def staleness(spark, d):
    x = p.justifications(spark, d)
    n = F.col("n_chars")
    return x.select("entity_id", c.staleness(F.col("quality").isNotNull(), F.lit("a"), F.when(n % 7 == 0, "b").otherwise("a"), F.col("confidence"), F.col("quality") == 0, n % 90, F.col("toxic") == 1).alias("reason"))


@query("C6_body_hash", "select id, left(sha256(new_sig || chr(10) || new_body), 16) as hash from versions", VERSIONS)
def body_hash(spark, d):
    return versions(spark, d).select("id", s.body_hash(F.col("new_sig"), F.col("new_body")).alias("hash"))


@query("C7_keywords", "select entity_id, len(list_distinct(list_filter([lower(taxonomy), case when feature_tag <> 'unclassified' then feature_tag end, architectural_pattern, domain_concepts[1], domain_concepts[2]], lambda x: x is not null))) as n from justifications", p.JUSTIFICATIONS)
def keywords(spark, d):
    x = p.justifications(spark, d)
    return x.select("entity_id", F.size(c.keywords(F.col("taxonomy"), F.col("feature_tag"), F.col("domain_concepts"), F.lit("is of the"), F.col("architectural_pattern"))).alias("n"))


@query("C8_semantic_fingerprint", "select doc_id, left(sha256(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))), 32) as fingerprint from documents")
def fingerprint(spark, d):
    return p.table(spark, d, "documents").select("doc_id", c.fingerprint(F.col("text")).alias("fingerprint"))


@query("C10_quarantine", "select case when n_chars > 3000 then 'quarantined' else 'ok' end as state, count(*) as n from documents group by 1")
def quarantine(spark, d):
    return reports.histogram(c.quarantine(p.table(spark, d, "documents"), "n_chars", 3000), state=F.when(F.col("reason").isNull(), "ok").otherwise("quarantined"))


NONE = "array<struct<subject:string,predicate:string,object:string>>"
SCORE = """scored as (select entity_id, greatest(0, least(1, floor((0.5 - 0.1 - 0.08 - case when confidence < 0.5 and taxonomy = 'VERTICAL' then 0.08 else 0 end + 0.05 + 0.05 + 0.05) * 100 + 0.5) / 100)) as score from justifications)"""


def scored(spark, d):
    x = p.justifications(spark, d)
    score, flags = c.quality(F.lit("Handles orders"), F.lit(None).cast("string"), F.col("confidence"), F.col("taxonomy"), F.col("domain_concepts"), F.col("feature_tag"), F.col("architectural_pattern"), F.array().cast(NONE), F.array().cast("array<string>"))
    return x.select("entity_id", score.alias("score"), flags.alias("flags"))


@query("C11_quality_score", "select entity_id, score from scored", p.JUSTIFICATIONS, SCORE)
def quality(spark, d):
    return scored(spark, d).select("entity_id", "score")


@query("C12_calibrated_confidence", """select f.id, round(least(case when fan_in > 0 then 0.25 else 0 end + case when fan_out > 0 then 0.15 else 0 end + 0.15 * (f.id % 2) + 0.05 + 0.18 * 0.5, 1), 6) as confidence from
  (select e.id, (select count(*) from edges where kind = 'calls' and dst = e.id) as fan_in, (select count(*) from edges where kind = 'calls' and src = e.id) as fan_out from entities e where e.kind in ('function', 'method')) f""", *G)
def confidence(spark, d):
    f = g.fan(p.edges(spark, d), p.entities(spark, d))
    x = c.calibrated_confidence(F.col("fan_in") > 0, F.col("fan_out") > 0, F.lit(0), F.col("id") % 2 == 1, F.lit(False), F.lit(True), F.lit(0.5), F.lit("standard"))
    return f.select("id", F.round(x, 6).alias("confidence"))


@query("C13_descriptive_names", "select p_partkey as id, length(p_name) > 3 as descriptive from part")
def descriptive(spark, d):
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), c.descriptive_name(F.col("p_name")).alias("descriptive"))


@query("C14_fingerprint_tokens", """select p_partkey as id, 'Centrality: ' || case when p_partkey % 100 >= 95 then 'critical' when p_partkey % 100 >= 75 then 'high' when p_partkey % 100 >= 25 then 'medium' else 'low' end || ' (P' || p_partkey % 100 || ') | Depth: '
  || case when p_size > 40 then 'disconnected' else p_size || ' hops from entry' end || ' | Role: connector | Boundary: ' || case when p_partkey % 2 = 0 then 'yes' else 'no' end || ' | Community: ' || p_partkey % 7 as tokens from part""")
def fingerprint_tokens(spark, d):
    k = F.col("p_partkey")
    t = c.fingerprint_tokens(k % 100, F.when(F.col("p_size") > 40, 99).otherwise(F.col("p_size")), F.lit(1.0), k % 2 == 0, k % 7)
    return p.table(spark, d, "part").select(k.alias("id"), t.alias("tokens"))


@query("C15_heuristic_class", "select case p_partkey % 3 when 0 then 'UTILITY' when 1 then 'HORIZONTAL' else 'none' end as taxonomy, count(*) as n from part group by 1")
def heuristic(spark, d):
    from ..sources import code

    path = F.get(F.array(*map(F.lit, ["src/a.test.ts", "vite.config.ts", "src/orders.ts"])), (F.col("p_partkey") % 3).cast("int"))
    k = code.path_class(path)
    return p.table(spark, d, "part").groupBy(F.when(k == "test", "UTILITY").when(k == "config", "HORIZONTAL").otherwise("none").alias("taxonomy")).agg(F.count("*").alias("n"))


@query("C16_model_tier", "select id, case when complexity >= 10 then 'premium' when kind = 'variable' then 'fast' else 'standard' end as tier from entities", p.ENTITIES)
def tier(spark, d):
    return p.entities(spark, d).select("id", c.model_tier(F.col("name"), F.lit("src/a.ts"), F.col("kind"), F.lit(0.0), F.col("complexity"), F.lit(0)).alias("tier"))


HEALTH = """health as (select user_id as rule_id, count(*) filter (event_type = 'view') as triggered_count, count(*) filter (event_type = 'error') as overridden_count, count(*) filter (event_type = 'click') as false_positive_count,
  count(*) filter (event_type = 'purchase') as auto_fixed_count, max(ts) filter (event_type = 'view') as last_triggered_at from events group by 1)"""


def rule_events(spark, d):
    e = F.col("event_type")
    name = F.when(e == "view", "triggered").when(e == "error", "overridden").when(e == "click", "false_positive").when(e == "purchase", "auto_fixed").otherwise("other")
    return p.table(spark, d, "events").select(F.col("user_id").alias("rule_id"), name.alias("event"), "ts")


@query("C17_rule_decay", """select rule_id, round(greatest(0, least(1, 1 - (0.4 * overridden_count / t + 0.3 * false_positive_count / t + 0.2 * least(30 / 90.0, 1) + 0.1 * (1 - auto_fixed_count / t)))), 6) as score
  from (select *, case when triggered_count = 0 then 1 else triggered_count end::double as t from health)""", HEALTH)
def decay(spark, d):
    h = c.rule_health(rule_events(spark, d))
    return h.select("rule_id", F.round(c.decay_score(F.col("triggered_count"), F.col("overridden_count"), F.col("false_positive_count"), F.col("auto_fixed_count"), F.lit(30)), 6).alias("score"))


@query("C18_rule_health", "select * from health", HEALTH)
def rule_health(spark, d):
    return c.rule_health(rule_events(spark, d))


@query("C19_tag_merge", """select x as tag, arg_min(t.tag, (-t.n, t.tag)) as canonical from closure join tags t on t.tag = y group by x""",
  "tags as (select lower(p_type) as tag, count(*) as n from part group by 1)",
  "near as (select a.tag as x, b.tag as y from tags a, tags b where 1 - levenshtein(a.tag, b.tag)::double / greatest(length(a.tag), length(b.tag)) >= 0.75)",
  "closure(x, y) as (select x, y from near union select c.x, n.y from closure c join near n on n.x = c.y)")
def tag_merge(spark, d):
    t = p.table(spark, d, "part").groupBy(F.lower("p_type").alias("tag")).agg(F.count("*").alias("n"))
    return c.merge_tags(t)


@query("C20_issue_priority", "select o_orderkey as id, round(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 3.0 when o_orderpriority = '3-MEDIUM' then 2.0 else 1.0 end * 40 + least(o_custkey % 80, 50) / 50.0 * 30 + 15, 6) as priority from orders")
def priority(spark, d):
    sev = s.severity(F.col("o_orderpriority"))
    return p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(s.severity_weight(sev) * 40 + F.least(F.col("o_custkey") % 80, F.lit(50)) / 50 * 30 + 15, 6).alias("priority"))


DRIFT = """toks as (select conv_id, turn, list_distinct([x for x in string_split(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ') if length(x) > 2]) as t from conversations where role = 'user'),
lasts as (select conv_id, max(turn) as m, count(*) as n from toks group by 1),
sims as (select a.conv_id, case when len(list_distinct(list_concat(a.t, b.t))) = 0 then 0 else len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t))) end as s from toks a join lasts l on l.conv_id = a.conv_id and l.m = a.turn join toks b on b.conv_id = a.conv_id and b.turn < a.turn)"""


@query("C21_prompt_drift", "select l.conv_id, case when n >= 3 then round(max(s), 6) else 0 end as similarity, n >= 3 and count(*) filter (s > 0.7) >= 2 as drifting from lasts l left join sims x on x.conv_id = l.conv_id group by l.conv_id, n", DRIFT)
def prompt_drift(spark, d):
    x = c.prompt_drift(p.table(spark, d, "conversations").where("role = 'user'"), ["conv_id"], "turn", "text")
    return x.select("conv_id", F.round("similarity", 6).alias("similarity"), "drifting")


@query("C22_boundary_category", "select case p_partkey % 4 when 0 then 'database' when 1 then 'http' when 2 then 'testing' else 'other' end as category, count(*) as n from part group by 1")
def category(spark, d):
    from ..operators.review import boundary_category

    imp = F.get(F.array(*map(F.lit, ["@prisma/client", "axios", "vitest", "left-pad"])), (F.col("p_partkey") % 4).cast("int"))
    return boundary_category(p.table(spark, d, "part").select(imp.alias("package"))).groupBy("category").agg(F.count("*").alias("n"))


@query("C23_merge_significance", "select user_id, count(*) filter (event_type = 'error') >= 10 or max(value) > 95 as significant from events group by 1")
def significance(spark, d):
    e = p.table(spark, d, "events").withColumn("added", (F.col("event_type") == "error").cast("int"))
    return c.merge_significance(e, ["user_id"], F.col("value") > 95)


@query("C24_drift_alerts", "select event_id from (select *, lag(value) over (partition by user_id, event_type order by valid_from, event_id) as before from scd) where before is not null and abs(value - before) > 50", p.SCD)
def drift_alerts(spark, d):
    from pyspark.sql import Window as W

    x = p.scd(spark, d).withColumn("before", F.lag("value").over(W.partitionBy("user_id", "event_type").orderBy("valid_from", "event_id")))
    return x.where("before is not null and abs(value - before) > 50").select("event_id")


@query("C25_polyglot_rules", "select p_type as title, min(p_partkey) as id from part group by 1")
def polyglot(spark, d):
    part = p.table(spark, d, "part").select(F.col("p_type").alias("title"), F.col("p_partkey").alias("id"))
    both = part.where("id % 3 = 0").unionByName(part.where("id % 3 <> 0"))
    return w.first_per_group(both, ["title"], ["id"])


J = p.JUSTIFICATIONS


@query("H1_llm_failure", "select count(*) filter (confidence <= 0.3 and feature_tag = 'unclassified' and taxonomy = 'UTILITY') = count(*) as hit from justifications", J)
def h1(spark, d):
    return health.fallbacks(p.justifications(spark, d)).select(F.col("all_fallback").alias("hit"))


@query("H2_llm_partial_failure", "select count(*) filter (confidence <= 0.3 and feature_tag = 'unclassified' and taxonomy = 'UTILITY') > 0.8 * count(*) as hit from justifications", J)
def h2(spark, d):
    return health.fallbacks(p.justifications(spark, d)).select(F.col("mostly_fallback").alias("hit"))


@query("H3_low_confidence", "select count(*) filter (confidence < 0.5) as n, case when count(*) filter (confidence < 0.5) > 0.3 * count(*) then 'high' else 'medium' end as severity from justifications", J)
def h3(spark, d):
    return health.low_confidence(p.justifications(spark, d))


@query("H4_untested_vertical", "select entity_id, case when count(*) over () > 5 then 'high' else 'medium' end as severity from justifications where taxonomy = 'VERTICAL' and confidence < 0.6", J)
def h4(spark, d):
    return health.untested_vertical(p.justifications(spark, d))


@query("H5_single_entity_feature", "select lang || source || (doc_id % 40) as feature, count(*) as n from documents group by 1 having count(*) = 1 order by feature limit 5")
def h5(spark, d):
    feature = F.concat("lang", "source", (F.col("doc_id") % 40).cast("string"))
    features = p.table(spark, d, "documents").groupBy(feature.alias("feature_tag")).agg(F.count("*").alias("entity_count"))
    return health.single_entity_features(features).select(F.col("feature_tag").alias("feature"), F.col("entity_count").alias("n"))


@query("H6_high_utility_ratio", "select count(*) filter (taxonomy = 'UTILITY') > 0.7 * count(*) as hit, count(*) filter (taxonomy = 'UTILITY') as n from justifications", J)
def h6(spark, d):
    return health.utility_ratio(p.justifications(spark, d))


@query("H7_dead_code", "select id, name, case when (select count(*) from entities where id not in (select dst from edges where kind in ('calls', 'references', 'imports'))) > 0.05 * (select count(*) from entities) then 'high' else 'medium' end as severity from entities where id not in (select dst from edges where kind in ('calls', 'references', 'imports')) order by id limit 20", *G)
def h7(spark, d):
    return health.dead_code(p.entities(spark, d), p.edges(spark, d)).orderBy("id").limit(health.SAMPLES)


@query("H8_architectural_violation", "select entity_id, taxonomy, case when bool_or(taxonomy = 'VERTICAL') over () then 'high' else 'medium' end as severity from justifications where architectural_pattern = 'mixed'", J)
def h8(spark, d):
    return health.mixed_architecture(p.justifications(spark, d))


@query("H9_low_quality", "select count(*) filter (score < 0.5) as n, case when count(*) filter (score < 0.5) > 0.1 * count(*) then 'high' else 'medium' end as severity from scored", J, SCORE)
def h9(spark, d):
    return health.share_at_risk(scored(spark, d), F.col("score") < 0.5, 0.1)


def _degree(end: str, high: int):
    return lambda spark, d: health.crowded(p.edges(spark, d), end, high)


query("H10_high_fan_in", "select dst as id, count(*) as n, case when max(count(*)) over () >= 20 then 'high' else 'medium' end as severity from edges where kind = 'calls' group by dst having count(*) >= 10", *G)(_degree("dst", 20))
query("H11_high_fan_out", "select src as id, count(*) as n, case when max(count(*)) over () >= 15 then 'high' else 'medium' end as severity from edges where kind = 'calls' group by src having count(*) >= 10", *G)(_degree("src", 15))


@query("H12_circular_dependency", "select count(*) as n from (select * from ring limit 10)", *G, *CYCLES)
def h12(spark, d):
    return g.cycles(p.edges(spark, d), 10).agg(F.count("*").alias("n"))


@query("H13_taxonomy_anomaly", """select j.entity_id, taxonomy, coalesce(n, 0) as callers from justifications j left join (select dst, count(*) as n from edges where kind = 'calls' group by dst) x on x.dst = j.entity_id
  where (taxonomy = 'VERTICAL' and coalesce(n, 0) = 0) or (taxonomy = 'HORIZONTAL' and n = 1)""", *G, J)
def h13(spark, d):
    return health.taxonomy_anomalies(p.justifications(spark, d), p.edges(spark, d))


@query("H14_confidence_gap", "select feature_tag, round(avg(confidence), 6) as average, case when min(avg(confidence)) over () < 0.4 then 'high' else 'medium' end as severity from justifications group by feature_tag having avg(confidence) < 0.6", J)
def h14(spark, d):
    found = health.confidence_gaps(reports.feature_counts(p.justifications(spark, d)))
    return found.select("feature_tag", F.round("average_confidence", 6).alias("average"), "severity")


@query("H15_missing_justification", "select count(*) filter (j.entity_id is null) as n, case when count(*) filter (j.entity_id is null) > 0.2 * count(*) then 'high' else 'medium' end as severity from entities e left join justifications j on j.entity_id = e.id where e.kind <> 'variable'", p.ENTITIES, J)
def h15(spark, d):
    return health.missing_justifications(p.entities(spark, d), p.justifications(spark, d), exempt=("variable",)).select("n", "severity")


def _listed(risk: str, category: str, severity: str, found: str) -> str:
    return f"""select '{risk}' as risk, '{category}' as category, {severity} as severity, count(*) as affected, array_to_string(list(id order by id)[1:20], ',') as samples from ({found}) having count(*) > 0"""


def _counted(risk: str, category: str, severity: str, n: str, hit: str, of: str = "justifications") -> str:
    return f"select '{risk}', '{category}', {severity}, {n}, '' from {of} having {hit}"


def _over(share: float, of: str) -> str:
    return f"case when count(*) > {share} * (select count(*) from {of}) then 'high' else 'medium' end"


STUB = "count(*) filter (confidence <= 0.3 and feature_tag = 'unclassified' and taxonomy = 'UTILITY')"
LOW, UTIL = "count(*) filter (confidence < 0.5)", "count(*) filter (taxonomy = 'UTILITY')"
REPORT = " union all ".join([
    _listed("untested_vertical", "quality", "case when count(*) > 5 then 'high' else 'medium' end", "select entity_id as id from justifications where taxonomy = 'VERTICAL' and confidence < 0.6"),
    _counted("llm_partial_failure", "quality", "'high'", STUB, f"{STUB} > 0.8 * count(*)"),
    _counted("low_confidence", "quality", f"case when {LOW} > 0.3 * count(*) then 'high' else 'medium' end", LOW, f"{LOW} > 0"),
    _listed("single_entity_feature", "taxonomy", "'low'", "select feature_tag as id from justifications group by 1 having count(*) = 1 order by 1 limit 5"),
    _counted("high_utility_ratio", "taxonomy", "'medium'", UTIL, f"{UTIL} > 0.7 * count(*)"),
    _listed("dead_code", "dead_code", _over(0.05, "entities"), "select id from entities where id not in (select dst from edges where kind in ('calls', 'references', 'imports'))"),
    _listed("architectural_violation", "architecture", "case when bool_or(taxonomy = 'VERTICAL') then 'high' else 'medium' end", "select entity_id as id, taxonomy from justifications where architectural_pattern = 'mixed'"),
    _listed("low_quality_justification", "quality", _over(0.1, "justifications"), "select entity_id as id from scored where score < 0.5"),
    _listed("high_fan_in", "complexity", "case when max(n) >= 20 then 'high' else 'medium' end", "select dst as id, count(*) as n from edges where kind = 'calls' group by 1 having count(*) >= 10"),
    _listed("high_fan_out", "complexity", "case when max(n) >= 15 then 'high' else 'medium' end", "select src as id, count(*) as n from edges where kind = 'calls' group by 1 having count(*) >= 10"),
    _listed("circular_dependency", "architecture", "'high'", "select array_to_string(cycle, ',') as id from (select cycle from ring order by len(cycle), cycle limit 10)"),
    _listed("taxonomy_anomaly", "taxonomy", "'medium'", "select entity_id as id from justifications left join (select dst, count(*) as n from edges where kind = 'calls' group by 1) x on dst = entity_id where (taxonomy = 'VERTICAL' and n is null) or (taxonomy = 'HORIZONTAL' and n = 1)"),
    _listed("confidence_gap", "quality", "case when min(a) < 0.4 then 'high' else 'medium' end", "select feature_tag as id, avg(confidence) as a from justifications group by 1 having avg(confidence) < 0.6"),
    _counted("missing_justification", "taxonomy", "case when count(*) filter (j.entity_id is null) > 0.2 * count(*) then 'high' else 'medium' end", "count(*) filter (j.entity_id is null)", "count(*) filter (j.entity_id is null) > 0.05 * count(*)", "entities e left join justifications j on j.entity_id = e.id"),
])


@query("A12_health_report", f"select * from ({REPORT}) where (select {STUB} < count(*) from justifications) union all " + _counted("llm_failure", "quality", "'high'", STUB, f"{STUB} = count(*) and count(*) > 0"), *G, J, SCORE, *CYCLES)
def health_report(spark, d):
    js = p.justifications(spark, d)
    found = health.report(js, reports.feature_counts(js), p.entities(spark, d), p.edges(spark, d), scored(spark, d))
    return found.withColumn("samples", F.array_join("samples", ","))


from ..operators import review as r  # noqa: E402

CHANGED = "changed as (select * from entities where id % 20 = 0)"


def changed(spark, d):
    return p.entities(spark, d).where("id % 20 = 0")


@query("R1_impact_check", "select c.id, count(*) as callers from changed c join edges e on e.dst = c.id and e.kind = 'calls' group by c.id having count(*) >= 6", *G, CHANGED)
def r1(spark, d):
    return r.impact_check(changed(spark, d), p.edges(spark, d), 6).select("id", "callers")


@query("R2_complexity_check", "select id, complexity from changed where complexity >= 10", *G, CHANGED)
def r2(spark, d):
    return r.complexity_check(changed(spark, d), 10).select("id", "complexity")


@query("R3_pattern_check", "select l_orderkey as violation, l_linenumber as line, case l_returnflag when 'R' then 'error' else 'warning' end as severity from lineitem where l_linenumber between 2 and 4")
def r3(spark, d):
    li = p.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("violation"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return r.in_changed_lines(li, [(2, 4)]).select("violation", "line", F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("severity"))


@query("R4_test_companion", "select p_partkey as id from part where p_partkey % 3 <> 0 and p_partkey % 7 <> 0")
def r4(spark, d):
    k = F.col("p_partkey").cast("string")
    files = p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("src/f"), k, F.lit(".ts")).alias("file_path"))
    tests = files.where("id % 3 = 0").select(F.concat(F.lit("src/__tests__/f"), F.col("id").cast("string"), F.lit(".test.ts")).alias("file_path")).unionAll(files.where("id % 7 = 0").select(F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".spec.ts"))))
    return r.without_tests(files, tests).select("id")


CALLS = "calls as (select distinct src, dst from edges where kind = 'calls')"


def _walk(name: str, to: str, at: str, hops: int) -> list[str]:
    """What each changed entity reaches within that many calls."""
    steps = [f"{name}1 as (select c.id as seed, e.{to} as id from changed c join calls e on e.{at} = c.id)"]
    steps += [f"{name}{k} as (select seed, e.{to} as id from {name}{k - 1} x join calls e on e.{at} = x.id)" for k in range(2, hops + 1)]
    return [*steps, f"{name} as (" + " union ".join(f"select seed, id from {name}{k}" for k in range(1, hops + 1)) + ")"]


@query("R6_trust_boundary", """select id from changed where kind in ('function', 'method') and id % 499 <> 2 and id in (select seed from up where id % 9 = 0) and id in (select seed from down where id % 9 = 1)
  and id not in (select seed from up where id % 499 = 2) and id not in (select seed from down where id % 499 = 2)""", *G, CHANGED, CALLS, *_walk("up", "src", "dst", 3), *_walk("down", "dst", "src", 3))
def r6(spark, d):
    i = F.col("id")
    return r.trust_boundary(changed(spark, d), p.edges(spark, d), p.entities(spark, d), i % 9 == 0, i % 9 == 1, i % 499 == 2).select("id")


@query("R7_idempotency", """select id from changed where kind in ('function', 'method') and complexity % 2 = 0 and id % 89 <> 2 and id in (select seed from down where id % 5 = 1) and id not in (select seed from down where id % 89 = 2)""", *G, CHANGED, CALLS, *_walk("down", "dst", "src", 2))
def r7(spark, d):
    i = F.col("id")
    return r.idempotency(changed(spark, d), p.edges(spark, d), p.entities(spark, d), F.col("complexity") % 2 == 0, i % 5 == 1, i % 89 == 2).select("id")


@query("R8_env_check", "select distinct p_brand as variable from part where p_brand not in ('Brand#11', 'Brand#12')")
def r8(spark, d):
    text = F.concat(F.lit("const x = process.env."), F.upper(F.regexp_replace("p_brand", "#", "_")), F.lit("; "))
    used = r.env_usage(p.table(spark, d, "part").select(text.alias("line")))
    known = spark.createDataFrame([("BRAND_11",), ("BRAND_12",)], "variable string")
    return used.join(F.broadcast(known), "variable", "left_anti").select(F.regexp_replace(F.initcap("variable"), "_", "#").alias("variable"))


@query("R9_contract", "select c.id from changed c where exists (select 1 from edges e join entities v on v.id = e.src where e.dst = c.id and e.kind = 'calls' and v.kind = 'interface')", *G, CHANGED)
def r9(spark, d):
    return r.contract_check(changed(spark, d), p.edges(spark, d), p.entities(spark, d), ("interface",)).select("id")


@query("R10_semantic_lgtm", """select c.file as file, bool_and(coalesce(j.taxonomy, '') in ('HORIZONTAL', 'UTILITY') and coalesce(n, 0) <= 5) as approve from (select id, id % 30 as file from changed) c
  left join justifications j on j.entity_id = c.id left join (select dst, count(*) as n from edges where kind = 'calls' group by dst) x on x.dst = c.id group by 1""", *G, J, CHANGED)
def r10(spark, d):
    return r.looks_good(changed(spark, d).withColumn("file", F.col("id") % 30), p.justifications(spark, d), p.edges(spark, d), ["file"])


@query("P4_secret_scrub", "select doc_id, regexp_matches(text, '(?i)(password|secret|token|api_key|apikey|auth_token|access_token|private_key)\\s*[=:]\\s*[\"'']?[^\\s\"'',;}{]{3,}') as had_secret from documents")
def scrubbed(spark, d):
    t = F.col("text")
    return p.table(spark, d, "documents").select("doc_id", F.contains(s.scrub(t), F.lit("[REDACTED:password]")).alias("had_secret"))


@query("P4_entropy", "select p_brand, round(entropy, 6) as entropy from (select p_brand, (select -sum(n / length(p_brand) * log2(n / length(p_brand))) from (select count(*)::double as n from (select unnest(string_split(p_brand, '')) as c) group by c)) as entropy from (select distinct p_brand from part))")
def brand_entropy(spark, d):
    return p.table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.round(s.entropy(F.col("p_brand")), 6).alias("entropy"))
