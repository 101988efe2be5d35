"""Summaries: counts, features, usage, adherence, patterns and motifs.  Inputs are the library's relations; columns that
differ from repository to repository are parameters.  Empty tables give empty results (one row of zeros where a
result has no key); rows with null keys form a group of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .windows import first_per_group

CALLABLE = ("function", "method")
TAXONOMIES = ("VERTICAL", "HORIZONTAL", "UTILITY")


def project_stats(entities: DataFrame) -> DataFrame:
    """One row: functions and methods, classes, interfaces, variables and distinct files."""
    k = F.col("kind")
    return entities.agg(F.count_if(k.isin(*CALLABLE)).alias("functions"), *[F.count_if(k == x).alias(y) for x, y in (("class", "classes"), ("interface", "interfaces"), ("variable", "variables"))], F.count_distinct("file_path").alias("files"))


def collection_counts(entities: DataFrame) -> DataFrame:
    """(collection, n) by the collection that keeps each kind; callables and all else are functions."""
    k = F.col("kind")
    name = F.when(k == "class", "classes").when(k == "interface", "interfaces").when(k == "variable", "variables").otherwise("functions")
    return entities.groupBy(name.alias("collection")).agg(F.count("*").alias("n"))


def file_paths(entities: DataFrame) -> DataFrame:
    return entities.select("file_path").distinct()


def token_usage(calls: DataFrame, prices: dict[str, float], other: float, model: str = "model", tokens: str = "tokens") -> DataFrame:
    """(model, tokens, calls, cost) per model and in total (model ``total``); prices are per million tokens, ``other``
    that of models without one."""
    m = F.col(model)
    price = F.lit(other)
    for name, known in prices.items():
        price = F.when(m == name, known).otherwise(price)
    x = calls.select(m.alias("model"), F.col(tokens).alias("tokens"), (F.col(tokens) * price).alias("cost"))
    sums = x.rollup("model").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"), F.round(F.sum("cost") / 1_000_000, 6).alias("cost"), F.grouping("model").alias("all"))
    return sums.select(F.when(F.col("all") == 1, "total").otherwise(F.col("model")).alias("model"), "tokens", "calls", "cost")


def max_branch(ledger: DataFrame, branch: str = "branch") -> DataFrame:
    """The highest timeline branch, 0 where there is none."""
    return ledger.agg(F.coalesce(F.max(branch), F.lit(0)).alias("branch"))


def feature_counts(justifications: DataFrame) -> DataFrame:
    """(feature_tag, entity_count, average_confidence)."""
    return justifications.groupBy("feature_tag").agg(F.count("*").alias("entity_count"), F.avg("confidence").alias("average_confidence"))


def entry_points(justifications: DataFrame, entities: DataFrame, edges: DataFrame, most: int | None = 10) -> DataFrame:
    """(feature_tag, entity_id) of a feature's entities that are called from outside it or by nothing, files apart; the
    first ``most`` by id (None: all)."""
    mine = justifications.select("feature_tag", "entity_id").distinct()
    mine = mine.join(entities.where("kind <> 'file'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    calls = edges.where("kind = 'calls'").select(F.col("src").alias("caller"), F.col("dst").alias("entity_id")).distinct()
    of = justifications.select(F.col("entity_id").alias("caller"), F.col("feature_tag").alias("caller_tag"), F.lit(True).alias("known_")).distinct()
    met = mine.join(calls, "entity_id", "left").join(of, "caller", "left")
    n = met.groupBy("feature_tag", "entity_id").agg(F.count_distinct("caller").alias("callers"), F.count_distinct(F.when(F.col("known_") & F.col("caller_tag").eqNullSafe(F.col("feature_tag")), F.col("caller"))).alias("inside"))
    found = n.where("callers = 0 or callers > inside").select("feature_tag", "entity_id")
    return found if most is None else first_per_group(found, ["feature_tag"], ["entity_id"], most)


def features(justifications: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(feature_tag, entity_count, vertical, horizontal, utility, average_confidence, entry_points): a feature each, its
    entry points as an array of at most ``most`` ids in order."""
    entry = entry_points(justifications, entities, edges, most).groupBy("feature_tag").agg(F.array_sort(F.collect_list("entity_id")).alias("entry_points"))
    by = [F.count_if(F.col("taxonomy") == t).alias(t.lower()) for t in TAXONOMIES]
    a = justifications.groupBy("feature_tag").agg(F.count("*").alias("entity_count"), *by, F.avg("confidence").alias("average_confidence"))
    b = entry.withColumnRenamed("feature_tag", "tag_")
    return a.join(b, F.col("feature_tag").eqNullSafe(F.col("tag_")), "left").drop("tag_")


def domain_terms(names: DataFrame, core: int, common: int, least: int = 2) -> DataFrame:
    """(term, n, tier) of the words of (id, words: array), counted once an entity; tiers by how many entities hold one."""
    n = names.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("tier", F.when(F.col("n") >= core, "core").when(F.col("n") >= common, "common").otherwise("rare"))


def new_concepts(justifications: DataFrame, terms: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """(concept, n) of the ``most`` frequent concepts that ``terms`` (term) does not hold, from ``least`` uses on."""
    n = justifications.select(F.explode("domain_concepts").alias("concept")).groupBy("concept").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(terms.select(F.col("term").alias("concept")), "concept", "left_anti").orderBy(F.desc("n"), "concept").limit(most)


def category_summary(rows: DataFrame, category: str, value: str) -> DataFrame:
    """(category, n, mean)."""
    return rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def issue_summary(issues: DataFrame, weight: float = 0.5) -> DataFrame:
    """(category, high, medium, low, priority, health) of (category, severity): the gravest severity, the number and the
    category's weight make the priority, every issue lowers the health."""
    n = lambda x: F.count_if(F.col("severity") == x)
    priority = F.max(s.severity_weight(F.col("severity")) * 40) + F.least(F.count("*"), F.lit(50)) / 50 * 30 + weight * 30
    health = F.greatest(F.lit(0), 100 - 15 * n("high") - 8 * n("medium") - 3 * n("low"))
    return issues.groupBy("category").agg(n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"), F.round(priority, 6).alias("priority"), health.alias("health"))


def health_grades(issues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grade) from A to F by the severities found."""
    n = issues.groupBy(*keys).agg(F.count_if(F.col("severity") == "high").alias("h_"), F.count_if(F.col("severity") == "medium").alias("m_"))
    return n.select(*keys, s.grade(F.col("h_"), F.col("m_")).alias("grade"))


def adherence(patterns: DataFrame, value: str, dead: Column) -> DataFrame:
    """One row: the mean of ``value`` and how many rows ``dead`` holds for."""
    return patterns.agg(F.round(F.avg(value), 6).alias("average"), F.count_if(dead).alias("dead"))


def impact_report(findings: DataFrame, most: int = 50) -> DataFrame:
    """(file, findings, errors, effort) of (file, severity): the ``most`` affected files."""
    n = F.count("*")
    out = findings.groupBy("file").agg(n.alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.when(n > 40, "large").when(n > 10, "medium").otherwise("small").alias("effort"))
    return out.orderBy(F.desc("findings"), "file").limit(most)


def community_patterns(members: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(community, size, motif, confidence, internal_edges) of (id, community): communities of ``least`` members or more.

    The motif hashes all ids of a community in order, so they come together; 16 bytes a member are its bound."""
    n = F.count_distinct("id")
    ids = F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ",")
    a = members.groupBy("community").agg(n.alias("size"), F.substring(F.sha2(ids, 256), 1, 16).alias("motif"), F.round(F.least(n / 20.0, F.lit(1.0)), 6).alias("confidence")).where(F.col("size") >= least)
    src, dst = members.select(F.col("id").alias("src"), "community"), members.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    inner = edges.join(src, "src").join(dst, "dst").where("community = other").groupBy("community").agg(F.count("*").alias("internal_edges"))
    return a.join(inner, "community", "left").fillna(0, ["internal_edges"])


def call_motifs(members: DataFrame, edges: DataFrame, share: float = 0.6, least: int = 3, crowd: int = 5) -> DataFrame:
    """(community, motif, n, adherence): kinds along calls of two and three callables within a community of (id, kind,
    community), found at least ``least`` times and ``share`` times as often as it has callables, of which it needs ``crowd``.

    Chains of three are counted as callers by kind times callees by kind of their middle, never listed."""
    m = members.where(F.col("kind").isin(*CALLABLE))
    a = m.select(F.col("id").alias("src"), F.col("kind").alias("sk"), "community")
    b = m.select(F.col("id").alias("dst"), F.col("kind").alias("dk"), F.col("community").alias("other"))
    calls = edges.where("kind = 'calls'").select("src", "dst").join(a, "src").join(b, "dst").where("community = other").select("src", "dst", "sk", "dk", "community")
    two = calls.groupBy("community", F.concat_ws("->", "sk", "dk").alias("motif")).agg(F.count("*").alias("n"))
    into = calls.groupBy("community", F.col("dst").alias("mid"), "sk", F.col("dk").alias("mk")).agg(F.count("*").alias("x"))
    out = calls.groupBy("community", F.col("src").alias("mid"), "dk").agg(F.count("*").alias("y"))
    three = into.join(out, ["community", "mid"]).groupBy("community", F.concat_ws("->", "sk", "mk", "dk").alias("motif")).agg(F.sum(F.col("x") * F.col("y")).alias("n"))
    total = m.groupBy("community").agg(F.count("*").alias("total")).where(F.col("total") >= crowd)
    kept = F.least(F.col("n") / F.col("total"), F.lit(1.0))
    return two.unionByName(three).where(F.col("n") >= least).join(total, "community").where(kept >= share).select("community", "motif", "n", F.round(kept, 6).alias("adherence"))


def pattern_stats(matches: DataFrame) -> DataFrame:
    """(pattern, matches, files, adherence, confidence) of (pattern, file)."""
    n, f = F.count("*"), F.count_distinct("file")
    return matches.groupBy("pattern").agg(n.alias("matches"), f.alias("files"), F.round(F.least(n / f, F.lit(1.0)), 6).alias("adherence"), F.round(F.least(n / 20.0, F.lit(0.95)), 6).alias("confidence"))


def top_concepts(justifications: DataFrame, keys: list[str], most: int = 15) -> DataFrame:
    """(keys, concept, n): the most frequent concepts of each key, ties by name."""
    x = justifications.select(*keys, F.explode("domain_concepts").alias("concept")).groupBy(*keys, "concept").agg(F.count("*").alias("n"))
    return first_per_group(x, keys, [F.desc("n"), "concept"], most)


def calls_by_taxonomy(edges: DataFrame, justifications: DataFrame) -> DataFrame:
    """(taxonomy, n) of the callers of all calls."""
    return edges.where("kind = 'calls'").join(justifications.select(F.col("entity_id").alias("src"), "taxonomy"), "src").groupBy("taxonomy").agg(F.count("*").alias("n"))


def ledger_summary(entries: DataFrame) -> DataFrame:
    """(branch, entries, files, lines) of (branch, file, lines)."""
    return entries.groupBy("branch").agg(F.count("*").alias("entries"), F.count_distinct("file").alias("files"), F.sum("lines").alias("lines"))


def rewind_radius(entries: DataFrame, reverted: Column) -> DataFrame:
    """(file, reverted, state) of (file, …) if the entries for which ``reverted`` holds were undone: a file is safe with
    none of them, at risk with only these, conflicted with others too."""
    r = F.coalesce(reverted, F.lit(False))
    state = F.when(F.bool_or(~r) & F.bool_or(r), "conflicted").when(F.bool_or(r), "at_risk").otherwise("safe")
    return entries.groupBy("file").agg(F.count_if(r).alias("reverted"), state.alias("state"))


def hotspots(entities: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(id, name, callers): the entities with most calls, ties by id."""
    n = edges.where("kind = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    return n.join(entities.select("id", "name"), "id").orderBy(F.desc("callers"), "id").limit(most).select("id", "name", "callers")


def histogram(rows: DataFrame, **by: Column) -> DataFrame:
    """(by, n): counts by named expressions."""
    return rows.groupBy(*[c.alias(k) for k, c in by.items()]).agg(F.count("*").alias("n"))


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Each (subject, predicate, object) once."""
    return triples.select("subject", "predicate", "object").distinct()


def file_tree(files: DataFrame) -> DataFrame:
    """(path, is_dir, files): every folder and file of (file_path), with the rows below or at it."""
    x = files.select(F.split("file_path", "/").alias("s")).select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k"))
    return x.groupBy(F.array_join(F.slice("s", F.lit(1), F.col("k")), "/").alias("path")).agg(F.max((F.col("k") < F.size("s")).cast("int")).alias("is_dir"), F.count("*").alias("files"))


def signal_quality(entities: DataFrame, justifications: DataFrame) -> DataFrame:
    """One row: entities, justified ones and their share in percent (null without entities)."""
    known = justifications.select(F.col("entity_id").alias("id"), F.lit(True).alias("known_")).distinct()
    x = entities.select("id").join(known, "id", "left")
    return x.agg(F.count("*").alias("entities"), F.count("known_").alias("justified"), F.round(F.try_divide(F.count("known_") * 100.0, F.count("*")), 6).alias("coverage"))


def import_resolution(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(resolved, n): how many imports lead to an entity, and how many do not."""
    known = entities.select(F.col("id").alias("dst"), F.lit(True).alias("known_")).distinct()
    return edges.where("kind = 'imports'").join(known, "dst", "left").groupBy(F.col("known_").isNotNull().alias("resolved")).agg(F.count("*").alias("n"))
