"""More of the query API as registered queries, each over the whole tables that the tool reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import projections as p
from ..tools import TOOLS, Repo
from .base import query
from .surface import repo

# The entity that the tools are asked about: the first that imports another.
ASKED = "asked as (select name, file_path as path from entities where id = (select min(src) from edges where kind = 'imports'))"
NAMED = "named as (select e.id from entities e, asked a where contains(lower(e.name), lower(a.name)) or contains(lower(e.signature), lower(a.name)) order by length(a.name) / length(e.name) desc, e.id limit 1)"


def _asked(spark, d):
    """Its row."""
    first = p.edges(spark, d).where("kind = 'imports'").agg(F.min("src").alias("id"))
    return p.entities(spark, d).join(first, "id").first()


@query("X5_tool_get_blueprint", """select feature_tag, count(*) as entity_count, count(*) filter (taxonomy = 'VERTICAL') as vertical, count(*) filter (taxonomy = 'HORIZONTAL') as horizontal,
  count(*) filter (taxonomy = 'UTILITY') as utility, round(avg(confidence), 6) as average_confidence from justifications group by feature_tag""", p.JUSTIFICATIONS)
def blueprint(spark, d):
    return TOOLS["get_blueprint"](repo(spark, d)).withColumn("average_confidence", F.round("average_confidence", 6))


@query("X5_tool_search_by_purpose", """select id, row_number() over (order by score desc, id) as rank from (select v.id, list_cosine_similarity(v, (select v from vectors where id = 7)) as score
  from vectors v join justifications j on j.entity_id = v.id where taxonomy = 'UTILITY') order by rank limit 15""", p.VECTORS, p.JUSTIFICATIONS)
def by_purpose(spark, d):
    x = repo(spark, d)
    asked = x.vectors.where("id = 7").first()["v"]  # one vector
    return TOOLS["search_by_purpose"](x, vector=asked, taxonomy="UTILITY").select("id", "rank")


@query("X5_tool_file_context", """select feature_tag, count(*) as n, array_to_string(list_sort(list_distinct(flatten(list(domain_concepts)))), ',') as concepts
  from entities e join asked on file_path = path join justifications on entity_id = e.id group by feature_tag""", p.ENTITIES, p.EDGES, p.JUSTIFICATIONS, ASKED)
def file_context(spark, d):
    found = TOOLS["file_context"](repo(spark, d), path=_asked(spark, d)["file_path"])
    return found.select("feature_tag", "n", F.array_join(F.array_sort("concepts"), ",").alias("concepts"))


NEAR = "near as (select id from named union select dst from edges join named on src = named.id union select src from edges join named on dst = named.id)"
DEGREE = "degrees as (select id, least(count(*) / (2.0 * ((select count(*) from entities) - 1)), 1.0) as centrality from (select src as id from edges union all select dst from edges) group by id)"


@query("X5_tool_assemble_context", "select e.id, name, round(coalesce(centrality, 0), 9) as centrality, taxonomy, feature_tag from near join entities e using (id) left join degrees using (id) left join justifications j on j.entity_id = e.id order by centrality desc, e.id limit 5", p.ENTITIES, p.EDGES, p.JUSTIFICATIONS, ASKED, NAMED, NEAR, DEGREE)
def assemble(spark, d):
    return TOOLS["assemble_context"](repo(spark, d), name=_asked(spark, d)["name"]).select("id", "name", F.round("centrality", 9).alias("centrality"), "taxonomy", "feature_tag")


@query("X5_tool_get_imports", "select file_path, min(depth) as distance, count(distinct r.id) as entities from reach r join entities e on e.id = r.id where depth > 0 group by file_path", p.ENTITIES, p.EDGES, ASKED,
  "reach(id, depth) as (select id, 0 from entities join asked on file_path = path union select e.dst, r.depth + 1 from reach r join edges e on e.src = r.id where e.kind = 'imports' and r.depth < 5)")
def imports(spark, d):
    return TOOLS["get_imports"](repo(spark, d), path=_asked(spark, d)["file_path"], hops=5).select("file_path", "distance", F.size("entities").cast("long").alias("entities"))


def _events(spark, d):
    return p.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("branch"), F.col("ts").cast("timestamp").alias("created_at"))


@query("X5_tool_recent_changes", "select event_id as id from events order by ts desc, event_id limit 20")
def recent(spark, d):
    return TOOLS["get_recent_changes"](Repo(events=_events(spark, d))).select("id")


@query("X5_tool_timeline", "select event_id as id from events where event_type = (select min(event_type) from events) order by ts desc, event_id desc limit 21")
def timeline(spark, d):
    e = _events(spark, d)
    return TOOLS["get_timeline"](Repo(ledger=e), branch=e.agg(F.min("branch")).first()[0]).select("id")  # one value


RULES = """rules as (select p_partkey as id, p_brand || ' ' || p_type as title, case p_size % 5 when 0 then 'workspace' when 1 then 'branch' when 2 then 'path' when 3 then 'repo' else 'org' end as scope,
  5 - p_size % 5 as near, p_size as priority, case p_size % 5 when 0 then 'function' when 1 then 'method' when 2 then 'class' when 3 then 'interface' else 'variable' end as kind from part where p_partkey % 7 <> 0)"""


def _rules(spark, d):
    """Every part as a rule; one in seven is archived."""
    n = F.col("p_size") % 5
    scope = F.when(n == 0, "workspace").when(n == 1, "branch").when(n == 2, "path").when(n == 3, "repo").otherwise("org")
    kind = F.get(F.array(*map(F.lit, p.KINDS)), n.cast("int"))
    status = F.when(F.col("p_partkey") % 7 == 0, "archived").otherwise("active")
    return p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("title"), scope.alias("scope"), status.alias("status"), F.col("p_size").alias("priority"), F.lit(None).cast("string").alias("path_glob"), F.array(kind).alias("entity_kinds"))


@query("X5_tool_get_rules", "select id from (select *, row_number() over (partition by lower(title) order by near desc, priority desc, id) as rn from rules) where rn = 1 order by near desc, priority desc, id limit 50", RULES)
def rules(spark, d):
    return TOOLS["get_rules"](Repo(rules=_rules(spark, d))).select("id")


@query("X5_tool_relevant_rules", """select r.id, priority + 5 * coalesce(n, 0) as score from rules r left join (select kind, count(*) as n from (select distinct v.id, v.kind from edges e join named on e.src = named.id join entities v on v.id = e.dst where e.kind in ('calls', 'references')) group by kind) c using (kind)
  order by score desc, r.id limit 10""", p.ENTITIES, p.EDGES, ASKED, NAMED, RULES)
def relevant(spark, d):
    x = repo(spark, d)
    x.rules = _rules(spark, d)
    return TOOLS["get_relevant_rules"](x, name=_asked(spark, d)["name"]).select("id", F.col("score").cast("long").alias("score"))
