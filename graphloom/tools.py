"""The query API by tool name: one function per tool over a repository's tables, each returning a DataFrame.

    repo = Repo(entities=..., edges=..., justifications=..., vectors=..., rules=..., patterns=..., ledger=..., events=..., commits=...)
    TOOLS["get_callers"](repo, name="save", hops=2)

Tables that a tool does not use may be missing.  Lists a tool is asked about (names, paths) are arguments, not tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import providers
from .functions import scalars as s
from .operators import change as c
from .operators import graph as g
from .operators import joins as j
from .operators import mutations as m
from .operators import review as r
from .operators import search as se
from .operators import windows as w


@dataclass
class Repo:
    """Tables of one repository (or of many, filtered to it)."""

    entities: DataFrame | None = None
    edges: DataFrame | None = None
    justifications: DataFrame | None = None
    vectors: DataFrame | None = None
    rules: DataFrame | None = None
    patterns: DataFrame | None = None
    ledger: DataFrame | None = None
    events: DataFrame | None = None
    commits: DataFrame | None = None
    features: DataFrame | None = None
    comments: DataFrame | None = None


TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = f
    return f


def _named(repo: Repo, name: str) -> DataFrame:
    """The entity of that name, else the best match: one row."""
    return se.keyword_search(repo.entities, name, 1).select("id")


def _current(repo: Repo) -> DataFrame:
    js = repo.justifications
    return js.where("valid_to is null") if "valid_to" in js.columns else js


@tool
def search_code(repo: Repo, query: str, limit: int = 20, scope: str | None = None) -> DataFrame:
    rows = j.scope_overlay(repo.entities, scope) if scope else repo.entities
    return se.keyword_search(rows, query, limit)


@tool
def semantic_search(repo: Repo, query: str, limit: int = 10, model: Callable | None = None) -> DataFrame:
    """Vector and keyword legs fused; vectors (id, v) hold embeddings of the same model as the query's."""
    spark = repo.entities.sparkSession
    q = providers.embed(spark.createDataFrame([(0, query)], "id long, text string"), "text", model).select(F.col("id").alias("q_id"), F.col("embedding").alias("q"))
    sem = se.cosine_top(repo.vectors, q, 20).select(F.lit("semantic").alias("leg"), "id", (F.col("rank") - 1).alias("rank"), F.lit(0.7).alias("weight"))
    key = se.keyword_search(repo.entities, query, 20)
    key = w.first_per_group(key.withColumn("one_", F.lit(1)), ["one_"], [F.desc("score"), "id"], 20)
    rn = F.row_number().over(w.W.partitionBy("one_").orderBy(F.desc("score"), "id")) - 1  # at most 20 rows
    legs = sem.unionByName(key.select(F.lit("keyword").alias("leg"), "id", rn.alias("rank"), F.lit(1.0).alias("weight")))
    toks = [t for t in query.lower().split() if t not in s.STOP_WORDS]
    return se.fuse(legs, repo.entities.select("id", "name"), se.adaptive_k(legs), toks or [query], limit)


@tool
def find_similar(repo: Repo, id, limit: int = 10) -> DataFrame:
    q = repo.vectors.where(F.col("id") == id).select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    return se.cosine_top(repo.vectors, q, limit + 1).where("id <> q_id").orderBy("rank").limit(limit)


@tool
def get_function(repo: Repo, name: str) -> DataFrame:
    """The function with its callers and callees as arrays."""
    return _profiles(repo, _named(repo, name))


@tool
def get_class(repo: Repo, name: str) -> DataFrame:
    """Methods whose lines lie in the class."""
    cls = _named(repo, name).join(repo.entities, "id").select("file_path", F.col("id").alias("class_id"), "start_line", "end_line")
    methods = repo.entities.where("kind = 'method'").select("file_path", F.col("id").alias("method_id"), F.col("name").alias("method"), F.col("start_line").alias("start"), F.col("start_line").alias("end"))
    return j.overlaps(methods, cls).select("class_id", "method_id", "method")


@tool
def get_file(repo: Repo, path: str) -> DataFrame:
    return repo.entities.where(F.col("file_path") == path).orderBy("start_line", "id")


@tool
def file_context(repo: Repo, path: str) -> DataFrame:
    """The file's feature tags by frequency with their top concepts."""
    x = get_file(repo, path).select("id").join(_current(repo), F.col("id") == F.col("entity_id"))
    n = x.groupBy("feature_tag").agg(F.count("*").alias("n"))
    top = w.first_per_group(x.select("feature_tag", F.explode("domain_concepts").alias("concept")).groupBy("feature_tag", "concept").agg(F.count("*").alias("k")), ["feature_tag"], [F.desc("k"), "concept"], 15)
    return n.join(top.groupBy("feature_tag").agg(F.collect_list("concept").alias("concepts")), "feature_tag", "left").orderBy(F.desc("n"), "feature_tag")


@tool
def get_callers(repo: Repo, name: str, hops: int = 1) -> DataFrame:
    return g.callers(repo.edges, repo.entities, _named(repo, name), hops)


@tool
def get_callees(repo: Repo, name: str, hops: int = 1) -> DataFrame:
    return g.callees(repo.edges, repo.entities, _named(repo, name), hops)


@tool
def get_imports(repo: Repo, path: str, hops: int = 1) -> DataFrame:
    """Files a file imports within ``hops``, with their distance and entities."""
    seeds = repo.entities.where(F.col("file_path") == path).select("id")
    found = g.traverse(repo.edges.where("kind = 'imports'"), seeds, max(1, min(5, hops)), inbound=False).groupBy("id").agg(F.min("depth").alias("distance"))
    files = found.join(repo.entities.select("id", "file_path"), "id").groupBy("file_path").agg(F.min("distance").alias("distance"))
    return files.join(repo.entities, "file_path").groupBy("file_path", "distance").agg(F.collect_list(F.struct("id", "name", "kind")).alias("entities"))


@tool
def get_project_stats(repo: Repo) -> DataFrame:
    k = F.col("kind")
    return repo.entities.agg(F.count_if(k.isin("function", "method")).alias("functions"), F.count_if(k == "class").alias("classes"), F.count_if(k == "interface").alias("interfaces"), F.count_if(k == "variable").alias("variables"), F.count_distinct("file_path").alias("files"))


@tool
def sync_local_diff(repo: Repo, path: str, hunks: list[tuple[int, int]]) -> DataFrame:
    """Entities of a file that a diff's hunks (start, added lines) touch or move, at their new lines."""
    return m.shift_lines(repo.entities.where(F.col("file_path") == path), hunks)


@tool
def get_business_context(repo: Repo, name: str) -> DataFrame:
    return _named(repo, name).join(_current(repo), F.col("id") == F.col("entity_id"))


@tool
def search_by_purpose(repo: Repo, vector: list[float], taxonomy: str | None = None, limit: int = 15) -> DataFrame:
    v = repo.vectors
    if taxonomy:
        v = v.join(_current(repo).where(F.col("taxonomy") == taxonomy).select(F.col("entity_id").alias("id")), "id", "left_semi")
    q = v.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "q_id long, q array<double>")
    return se.cosine_top(v, q, limit).orderBy("rank")


@tool
def analyze_impact(repo: Repo, name: str, hops: int = 5) -> DataFrame:
    """Callers by taxonomy."""
    found = g.impact(repo.edges, repo.entities, _named(repo, name), hops).select("id")
    return found.join(_current(repo), F.col("id") == F.col("entity_id"), "left").groupBy(F.coalesce("taxonomy", F.lit("unknown")).alias("taxonomy")).agg(F.count("*").alias("entities"))


@tool
def get_blueprint(repo: Repo) -> DataFrame:
    t = F.col("taxonomy")
    return _current(repo).groupBy("feature_tag").agg(F.count("*").alias("entity_count"), F.count_if(t == "VERTICAL").alias("vertical"), F.count_if(t == "HORIZONTAL").alias("horizontal"), F.count_if(t == "UTILITY").alias("utility"), F.avg("confidence").alias("average_confidence"))


@tool
def get_recent_changes(repo: Repo, limit: int = 20) -> DataFrame:
    return repo.events.orderBy(F.desc("created_at"), "id").limit(limit)


@tool
def get_timeline(repo: Repo, branch: str | None = None, cursor: str | None = None, limit: int = 20) -> DataFrame:
    x = repo.ledger if branch is None else repo.ledger.where(F.col("branch") == branch)
    if cursor is None:
        return x.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)
    at = F.broadcast(repo.ledger.where(F.col("id") == cursor).select(F.col("created_at").alias("cursor_")))
    return w.keyset(x.join(at, F.col("created_at") < F.col("cursor_")).drop("cursor_"), "created_at", "id", F.current_timestamp() + F.expr("interval 100 years"), limit)


@tool
def mark_working(repo: Repo, ids: list) -> DataFrame:
    """The ledger after marking entries as working, where their state allows it."""
    hit = F.col("id").isin(*ids) & m.may_become(F.col("status"), F.lit("working"))
    return repo.ledger.withColumn("status", F.when(hit, "working").otherwise(F.col("status")))


@tool
def revert_to_working_state(repo: Repo, target) -> DataFrame:
    """The ledger after reverting all uncommitted entries newer than ``target``."""
    at = F.broadcast(repo.ledger.where(F.col("id") == target).select(F.col("created_at").alias("at_")))
    x = repo.ledger.join(at, how="left")
    hit = (F.col("created_at") > F.col("at_")) & ~F.col("status").isin("committed", "reverted")
    return x.withColumn("status", F.when(hit, "reverted").otherwise(F.col("status"))).drop("at_")


@tool
def sync_dirty_buffer(repo: Repo, path: str, text: str) -> DataFrame:
    """Entities of an unsaved buffer, which stand before the file's committed ones."""
    from .sources.code import parse_entities

    spark = repo.entities.sparkSession
    return parse_entities(spark.createDataFrame([(path, text)], "path string, text string"))


@tool
def get_rules(repo: Repo, path: str | None = None, limit: int = 50) -> DataFrame:
    """Active rules that apply to a path: nearer scopes first, one per title."""
    x = repo.rules.where("status = 'active'")
    if path is not None:
        x = x.where(F.col("path_glob").isNull() | F.rlike(F.lit(path), j.glob_regex(F.col("path_glob"))))
    near = F.when(F.col("scope") == "workspace", 5).when(F.col("scope") == "branch", 4).when(F.col("scope") == "path", 3).when(F.col("scope") == "repo", 2).otherwise(1)
    x = w.first_per_group(x.withColumn("near_", near).withColumn("title_", F.lower("title")), ["title_"], [F.desc("near_"), F.desc("priority"), "id"])
    return x.orderBy(F.desc("near_"), F.desc("priority"), "id").limit(limit).drop("near_", "title_")


@tool
def check_rules(repo: Repo, files: DataFrame) -> DataFrame:
    """Matches of the rules' patterns in files (path, language, text)."""
    from .sources.workspace import scan_patterns

    return scan_patterns(files, repo.rules.where("status = 'active'").select("id", "language", "regex", F.col("enforcement").alias("severity")))


@tool
def get_relevant_rules(repo: Repo, name: str, limit: int = 10) -> DataFrame:
    near = g.callees(repo.edges, repo.entities, _named(repo, name)).groupBy("kind").agg(F.count("*").alias("n"))
    x = repo.rules.where("status = 'active'").select("id", "title", "priority", F.explode_outer("entity_kinds").alias("kind")).join(near, "kind", "left")
    return x.groupBy("id", "title", "priority").agg((F.first("priority") + 5 * F.coalesce(F.sum("n"), F.lit(0))).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


@tool
def check_patterns(repo: Repo, confidence: float = 0.0, status: str | None = None) -> DataFrame:
    x = repo.patterns.where(F.col("confidence") >= confidence)
    return x if status is None else x.where(F.col("status") == status)


@tool
def get_conventions(repo: Repo) -> DataFrame:
    """Active rules and confirmed patterns as one list."""
    rules = repo.rules.where("status = 'active'").select("id", F.lit("rule").alias("kind"), "title", F.col("priority").cast("double").alias("weight"))
    return rules.unionByName(repo.patterns.where("status = 'confirmed'").select("id", F.lit("pattern").alias("kind"), "title", F.col("adherence").alias("weight")))


@tool
def suggest_approach(repo: Repo, path: str) -> DataFrame:
    """Conventions, with the entities of the file they are meant for."""
    n = get_file(repo, path).agg(F.count("*").alias("entities_in_file"))
    return get_conventions(repo).join(F.broadcast(n), how="left")


@tool
def review_pr_status(repo: Repo) -> DataFrame:
    return repo.comments.groupBy("severity").agg(F.count("*").alias("comments"))


def _profiles(repo: Repo, ids: DataFrame) -> DataFrame:
    i, o = j.neighbour_sets(repo.edges.where("kind = 'calls'"))
    x = ids.join(repo.entities, "id").join(i, "id", "left").join(o, "id", "left")
    if repo.justifications is not None:
        x = x.join(_current(repo).select(F.col("entity_id").alias("id"), "taxonomy", "feature_tag"), "id", "left")
    return x


@tool
def assemble_context(repo: Repo, name: str, limit: int = 5) -> DataFrame:
    """The entity's one-hop neighbourhood with profiles, most central first."""
    found = g.subgraph(repo.edges, _named(repo, name), 1)[0].select("id", "depth")
    return _profiles(repo, found).join(g.centrality(repo.edges, repo.entities), "id").orderBy(F.desc("centrality"), "id").limit(limit)


@tool
def refresh_context(repo: Repo, paths: list[str]) -> DataFrame:
    return _profiles(repo, repo.entities.where(F.col("file_path").isin(*paths)).select("id"))


@tool
def review_changes(repo: Repo, changed: DataFrame, callers: int = 15, complexity: int = 10) -> DataFrame:
    """Findings over changed entities: (check, id, value)."""
    a = r.impact_check(changed, repo.edges, callers).select(F.lit("impact").alias("check"), "id", F.col("callers").cast("long").alias("value"))
    b = r.complexity_check(changed, complexity).select(F.lit("complexity").alias("check"), "id", F.col("complexity").cast("long").alias("value"))
    return a.unionByName(b)


@tool
def prompt_drift(repo: Repo) -> DataFrame:
    """Branches whose last prompt repeats earlier ones."""
    return c.prompt_drift(repo.ledger, ["branch"], "created_at", "prompt")
