"""Risk detectors over justifications (entity_id, taxonomy, confidence, feature_tag, architectural_pattern), features
(feature_tag, entity_count, average_confidence), entities (id, name, kind) and edges (src, dst, kind).

A detector gives its findings; those with a severity carry it in every row.  ``report`` brings them together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, joins

SAMPLES = 20  # findings that a report shows of each risk
NOT_CODE = ("file", "module", "namespace", "directory")  # kinds that need no justification


def _with_severity(found: DataFrame, severity: Column) -> DataFrame:
    """The findings with one aggregate over all of them, a single row that goes along as a broadcast."""
    return found.join(F.broadcast(found.agg(severity.alias("severity"))), how="left")


def _high(condition: Column) -> Column:
    return F.when(condition, "high").otherwise("medium")


def share_at_risk(rows: DataFrame, condition: Column, high: float) -> DataFrame:
    """(n, severity) of rows that meet a condition: high if they are more than that share.  Null counts as not met."""
    n = F.count_if(condition)
    return rows.agg(n.alias("n"), _high(n > high * F.count("*")).alias("severity"))


def fallbacks(justifications: DataFrame) -> DataFrame:
    """(n, total, all_fallback, mostly_fallback): stubs that a failing model leaves; mostly is more than four fifths.
    Neither holds of no justifications."""
    stub = (F.col("confidence") <= 0.3) & (F.col("feature_tag") == "unclassified") & (F.col("taxonomy") == "UTILITY")
    counts = justifications.agg(F.count_if(stub).alias("n"), F.count("*").alias("total"))
    return counts.withColumn("all_fallback", F.expr("total > 0 and n = total")).withColumn("mostly_fallback", F.expr("total > 0 and n > 0.8 * total"))


def low_confidence(justifications: DataFrame, least: float = 0.5, high: float = 0.3) -> DataFrame:
    return share_at_risk(justifications, F.col("confidence") < least, high)


def untested_vertical(justifications: DataFrame, least: float = 0.6, many: int = 5) -> DataFrame:
    """(entity_id, severity) of business entities that nothing vouches for."""
    return _with_severity(justifications.where((F.col("taxonomy") == "VERTICAL") & (F.col("confidence") < least)).select("entity_id"), _high(F.count("*") > many))


def single_entity_features(features: DataFrame, most: int | None = 5) -> DataFrame:
    """Features of one entity by name, the first ``most`` (None: all)."""
    found = features.where("entity_count = 1").orderBy("feature_tag")
    return found if most is None else found.limit(most)


def utility_ratio(justifications: DataFrame, most: float = 0.7) -> DataFrame:
    """(hit, n): whether more than that share are utilities, and how many are."""
    n = F.count_if(F.col("taxonomy") == "UTILITY")
    return justifications.agg((n > most * F.count("*")).alias("hit"), n.alias("n"))


def dead_code(entities: DataFrame, edges: DataFrame, share: float = 0.05) -> DataFrame:
    """(id, name, severity) of entities that nothing reaches; high if they are more than that share of all."""
    found = joins.unreferenced(entities, edges).select("id", "name")
    both = found.agg(F.count("*").alias("n")).join(entities.agg(F.count("*").alias("all")), how="left")  # a row each
    return found.join(F.broadcast(both.select(_high(F.col("n") > share * F.col("all")).alias("severity"))), how="left")


def mixed_architecture(justifications: DataFrame) -> DataFrame:
    """(entity_id, taxonomy, severity) of entities that mix domain and infrastructure; high if any is business code."""
    found = justifications.where("architectural_pattern = 'mixed'").select("entity_id", "taxonomy")
    return _with_severity(found, _high(F.coalesce(F.bool_or(F.col("taxonomy") == "VERTICAL"), F.lit(False))))


def crowded(edges: DataFrame, end: str, high: int, least: int = 10) -> DataFrame:
    """(id, n, severity) of entities with ``least`` calls or more at that end (dst: callers, src: callees)."""
    found = edges.where("kind = 'calls'").groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _with_severity(found, _high(F.max("n") >= high))


def taxonomy_anomalies(justifications: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, taxonomy, callers): business code that nothing calls, shared code that has one caller."""
    n = edges.where("kind = 'calls'").groupBy(F.col("dst").alias("entity_id")).agg(F.count("*").alias("callers"))
    x = justifications.select("entity_id", "taxonomy").join(n, "entity_id", "left").fillna(0, ["callers"])
    return x.where("(taxonomy = 'VERTICAL' and callers = 0) or (taxonomy = 'HORIZONTAL' and callers = 1)")


def confidence_gaps(features: DataFrame, least: float = 0.6, low: float = 0.4) -> DataFrame:
    """(feature_tag, average_confidence, severity) of features below ``least``; high if any is below ``low``."""
    return _with_severity(features.where(F.col("average_confidence") < least).select("feature_tag", "average_confidence"), _high(F.min("average_confidence") < low))


def unjustified(entities: DataFrame, justifications: DataFrame) -> DataFrame:
    """Entities without a justification."""
    return entities.join(justifications.select(F.col("entity_id").alias("id")), "id", "left_anti")


def missing_justifications(entities: DataFrame, justifications: DataFrame, high: float = 0.2, exempt: tuple[str, ...] = NOT_CODE) -> DataFrame:
    """(n, total, severity) of entities that need a justification and have none."""
    known = justifications.select(F.col("entity_id").alias("id"), F.lit(True).alias("known_")).distinct()
    x = entities.where(~F.col("kind").isin(*exempt)).select("id").join(known, "id", "left")
    n = F.count_if(F.col("known_").isNull())
    return x.agg(n.alias("n"), F.count("*").alias("total"), _high(n > high * F.count("*")).alias("severity"))


def report(justifications: DataFrame, features: DataFrame, entities: DataFrame, edges: DataFrame, scores: DataFrame, most_cycles: int = 10) -> DataFrame:
    """(risk, category, severity, affected, samples): one row per risk found, with at most ``SAMPLES`` ids as strings.

    ``scores``: (entity_id, score) of each justification's quality.  If all justifications are stubs that is the only
    risk.  No justifications, entities or edges give no risk of theirs."""

    def part(rows: DataFrame, name: str, category: str, severity: Column, affected: Column, samples: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("risk"), F.lit(category).alias("category"), severity.alias("severity"), affected.cast("long").alias("affected"), samples.cast("array<string>").alias("samples"))

    def listed(name: str, category: str, found: DataFrame, key: str, severity: str | None = None) -> DataFrame:
        sev, none = F.lit(severity) if severity else F.col("severity"), F.lit(None)
        rows = found.select(F.col(key).alias("at"), sev.alias("severity"))
        total = rows.agg(F.max("severity").alias("severity"), F.count("*").alias("n")).where("n > 0")
        first = rows.orderBy("at").limit(SAMPLES).agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x.cast("string")).alias("ids"))
        return part(total, name, category, F.col("severity"), F.col("n"), none).unionByName(part(first, name, category, none.cast("string"), none, F.col("ids")))

    def counted(name: str, category: str, found: DataFrame, hit: str, severity: str | None = None) -> DataFrame:
        return part(found.where(hit), name, category, F.lit(severity) if severity else F.col("severity"), F.col("n"), F.array())

    stubs = fallbacks(justifications)
    low = scores.where("score < 0.5").select("entity_id")
    quality = share_at_risk(scores, F.col("score") < 0.5, 0.1).select("severity")
    rows = [
        counted("llm_partial_failure", "quality", stubs, "mostly_fallback", severity="high"),
        counted("low_confidence", "quality", low_confidence(justifications), "n > 0"),
        listed("untested_vertical", "quality", untested_vertical(justifications), "entity_id"),
        listed("single_entity_feature", "taxonomy", single_entity_features(features), "feature_tag", "low"),
        counted("high_utility_ratio", "taxonomy", utility_ratio(justifications), "hit", severity="medium"),
        listed("dead_code", "dead_code", dead_code(entities, edges), "id"),
        listed("architectural_violation", "architecture", mixed_architecture(justifications), "entity_id"),
        listed("low_quality_justification", "quality", low.join(F.broadcast(quality), how="left"), "entity_id"),
        listed("high_fan_in", "complexity", crowded(edges, "dst", 20), "id"),
        listed("high_fan_out", "complexity", crowded(edges, "src", 15), "id"),
        listed("circular_dependency", "architecture", graph.cycles(edges, most_cycles).select(F.array_join(F.transform("cycle", lambda v: v.cast("string")), ",").alias("cycle")), "cycle", "high"),
        listed("taxonomy_anomaly", "taxonomy", taxonomy_anomalies(justifications, edges), "entity_id", "medium"),
        listed("confidence_gap", "quality", confidence_gaps(features), "feature_tag"),
        counted("missing_justification", "taxonomy", missing_justifications(entities, justifications), "n > 0.05 * total"),
    ]
    found = reduce(DataFrame.unionByName, rows).join(F.broadcast(stubs.select("all_fallback")), how="left").where("not all_fallback").drop("all_fallback")
    found = found.unionByName(counted("llm_failure", "quality", stubs, "all_fallback", severity="high"))
    found = found.groupBy("risk", "category").agg(F.max("severity").alias("severity"), F.max("affected").alias("affected"), F.max("samples").alias("samples"))
    return found.where("affected is not null")
