"""Change classification, staleness, quality and confidence scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..plans.lineage import materialise
from .graph import connected

# Code shapes whose change is a change of meaning, and test assertions.
ANCHORS = (r"\bif\s*\(", r"\bswitch\s*\(", r"\bthrow\s+", r"\breturn\s+", r"\bawait\s+", r"\byield\s+", r"\.emit\s*\(", r"\.dispatch\s*\(", r"\.save\s*\(", r"\.update\s*\(", r"\.delete\s*\(", r"\.insert\s*\(", r"\.create\s*\(", r"\.remove\s*\(", r"\.push\s*\(", r"\.set\s*\(")
ASSERTIONS = (r"\bexpect\s*\(", r"\bassert\s*[.(]", r"\.toBe\s*\(", r"\.toEqual\s*\(", r"\.toThrow\s*\(", r"\.toContain\s*\(", r"\.toHaveBeenCalled", r"\.should\.")
# Wording that lowers or raises a justification's score.
GENERIC_PHRASES = ("handles operations", "manages data", "performs operations", "handles processing", "manages the", "provides functionality", "utility function", "helper function", "does various", "general purpose", "handles various")
GENERIC_TAGS = ("utility", "misc", "other", "general", "unknown")
PROGRAMMING_TERMS = tuple(
    "function class string number boolean object array variable parameter argument return void null undefined interface type method property constructor instance"
    " module import export async await promise callback".split()
)
DOMAIN_TERMS = (
    r"(?i)\b(auth|authenticat|authoriz|session|credential|login|signup|oauth|sso|rbac|permission)\b",
    r"(?i)\b(payment|billing|invoice|subscription|checkout|refund|pricing|revenue|charge)\b",
    r"(?i)\b(order|cart|shipment|inventory|catalog|warehouse|fulfillment|sku)\b",
    r"(?i)\b(patient|diagnosis|prescription|clinical|medical|health|treatment|pharmacy)\b",
    r"(?i)\b(workflow|pipeline|orchestrat|queue|job|scheduler|dispatch|routing)\b",
    r"(?i)\b(notification|alert|email|webhook|event|publish|subscribe|broadcast)\b",
    r"(?i)\b(cache|index|search|query|filter|aggregat|pagination|shard|replica)\b",
    r"(?i)\b(encrypt|decrypt|hash|sign|verify|certificate|tls|ssl|vault|secret)\b",
    r"(?i)\b(deploy|ci/cd|migration|rollback|release|canary|feature.?flag|toggle)\b",
    r"(?i)\b(compliance|audit|gdpr|hipaa|pci|regulation|retention|consent)\b",
    r"(?i)\b(analytics|metrics|telemetry|tracing|logging|monitoring|dashboard|report)\b",
    r"(?i)\b(tenant|organization|workspace|team|role|policy|access.?control)\b",
)
LAZY_PHRASING = r"(?i)^(a |the |this )(function|class|method|interface|type|variable)"
CODE_SIGNALS = (
    r"(?i)\bnam(e|ing|ed)\b|\bpattern\b|\bsignat|\bimport|\bcall(s|ed|ing)?\b|\breturn|\bimplement|\bextend|\bfile\b|\bmodule\b|\bclass\b|\bfunction\b|\binterface\b|\bmethod\b|\bparam"
    r"|\basync\b|\bdependen|\binherit|\bexport|\btest"
)
EVIDENCE = (r"[A-Z][a-z]+[A-Z]", r"\b\w+\.\w+\.\w+", r"\b\w+_\w+\b", r"`[^`]+`", r"(?i)\b\d+\s*(call|import|depend|reference|usage)")
# Names that say nothing, weights of model tiers, what always goes to the best model, commit subjects.
NON_DESCRIPTIVE = tuple("handle handler process do run get set data info temp tmp foo bar baz test main init setup execute call invoke apply cb fn func val obj res req err".split())
TIER_WEIGHTS = {"heuristic": 0.15, "fast": 0.15, "standard": 0.18, "premium": 0.20}
SAFETY = r"(?i)auth|security|validate|verify|credential|password|token|permission|encrypt|decrypt|sanitize|csrf|xss"
INTENTS = (
    (r"(?i)\b(fix|bug|patch|hotfix|resolve|issue)\b", "bugfix"), (r"(?i)\b(feat|add|new|implement|introduce)\b", "feature"), (r"(?i)\b(refactor|rename|move|clean|restructure)\b", "refactoring"),
    (r"(?i)\b(test|spec|coverage|assert)\b", "testing"), (r"(?i)\b(doc|readme|comment|jsdoc|typedoc)\b", "documentation"), (r"(?i)\b(perf|optim|speed|cache|fast)\b", "performance"),
    (r"(?i)\b(chore|ci|build|deps|dependency|bump|upgrade)\b", "maintenance"),
)


def intent(subject: Column) -> Column:
    """What a commit is for, by the first pattern its subject fits; null if none."""
    return reduce(lambda rest, x: F.when(subject.rlike(x[0]), x[1]).otherwise(rest), reversed(INTENTS), F.lit(None).cast("string"))


def matches(body: Column, patterns: tuple[str, ...]) -> Column:
    """All matches of the patterns in turn, trimmed."""
    hits = F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(p), F.lit(0)) for p in patterns]))
    return F.transform(hits, lambda x: F.trim(x))


def found(body: Column, patterns: tuple[str, ...]) -> Column:
    """All matches of the patterns, sorted: a multiset to compare."""
    return F.array_sort(matches(body, patterns))


def classify_change(old_sig: Column, new_sig: Column, old: Column, new: Column, path: Column) -> Column:
    """signature_changed, comments_only, test_assertions (of test files), anchors_changed or body_refactor: the first
    that holds."""
    empty = F.lit("")
    os, ns, ob, nb = (F.coalesce(x, empty) for x in (old_sig, new_sig, old, new))
    test = path.rlike(r"(?i)\.(test|spec|_test)\.[a-z]+$") | path.rlike("/__tests__/|/test/")
    return (
        F.when(os != ns, "signature_changed").when(s.strip_comments(ob) == s.strip_comments(nb), "comments_only")
        .when(test & (matches(ob, ASSERTIONS) != matches(nb, ASSERTIONS)), "test_assertions").when(found(ob, ANCHORS) != found(nb, ANCHORS), "anchors_changed").otherwise("body_refactor")
    )


def cascades(change: Column, similarity: Column | None = None) -> Column:
    """Whether a change of that kind reaches callers: a refactored body does unless its vector barely moved (null: not
    known, so it does)."""
    moved = F.lit(True) if similarity is None else ~(F.coalesce(similarity, F.lit(0.0)) > 0.95)
    return change.isin("signature_changed", "test_assertions", "anchors_changed") | ((change == "body_refactor") & moved)


def keywords(taxonomy: Column, tag: Column, concepts: Column, purpose: Column, pattern: Column) -> Column:
    """The set of words that stand for a justification's meaning."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.lower(purpose), "[^a-z0-9\\s]", " ")), "\\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*s.STOP_WORDS))
    one = F.array_compact(F.array(F.lower(taxonomy), F.when(tag != "unclassified", tag), F.when(pattern != "unknown", pattern)))
    return F.array_distinct(F.concat(one, F.transform(concepts, lambda c: F.trim(F.lower(c))), words))


def staleness(has: Column, old_hash: Column, new_hash: Column, quality: Column, fallback: Column, age_days: Column, callee_changed: Column) -> Column:
    """Why a justification is to be made again, the first that holds; null if it stands."""
    return (
        F.when(~has, "no_justification").when(old_hash != new_hash, "body_changed").when(quality < 0.4, "low_quality").when(fallback, "fallback")
        .when(age_days > 30, "aged").when(callee_changed, "callee_changed")
    )


def quality(purpose: Column, reasoning: Column, confidence: Column, taxonomy: Column, concepts: Column, tag: Column, pattern: Column, triples: Column, compliance: Column) -> tuple[Column, Column]:
    """(score, flags): half a point less penalties, plus bonuses, held to 0..1 and rounded half up to cents."""
    n = F.size(concepts)
    prog = F.size(F.filter(concepts, lambda c: F.lower(c).isin(*PROGRAMMING_TERMS)))
    real = n - prog
    why = F.coalesce(reasoning, F.lit(""))
    lower, low_why = F.trim(F.lower(purpose)), F.trim(F.lower(why))
    has = F.length(why) > 0
    copies = has & ((low_why == lower) | ((F.length(lower) > 20) & F.contains(low_why, lower)))
    signals = why.rlike(CODE_SIGNALS)
    evidence = sum(why.rlike(p).cast("int") for p in EVIDENCE)
    domains = sum(lower.rlike(p).cast("int") for p in DOMAIN_TERMS)
    full = F.size(F.filter(triples, lambda t: (F.length(t["subject"]) > 2) & (F.length(t["predicate"]) > 2) & (F.length(t["object"]) > 2)))
    rules = [
        ("-generic_phrase", reduce(lambda a, x: a | F.contains(lower, F.lit(x)), GENERIC_PHRASES, F.lit(False)), -0.15), ("-short_purpose", F.length(purpose) < 30, -0.1),
        ("-high_confidence_no_concepts", (confidence >= 0.8) & (n == 0), -0.1),
        ("-programming_terms", prog > 0, -F.least(0.08 * prog, F.lit(0.15))),
        ("-generic_feature_tag", tag.isin(*GENERIC_TAGS), -0.05),
        ("-lazy_phrasing", purpose.rlike(LAZY_PHRASING), -0.08),
        ("-missing_reasoning", ~has, -0.08), ("-short_reasoning", has & (F.length(why) < 80), -0.08), ("-reasoning_copies_purpose", copies, -0.08), ("-no_code_signals", has & ~signals, -0.05),
        ("-low_confidence_vertical", (confidence < 0.5) & (taxonomy == "VERTICAL"), -0.08),
        ("-confident_utility_no_concepts", (confidence >= 0.9) & (taxonomy == "UTILITY") & (n == 0), -0.05),
        ("-vertical_few_concepts", (taxonomy == "VERTICAL") & (n < 2), -0.05), ("-pure_domain_no_concepts", (pattern == "pure_domain") & (n == 0), -0.05),
        ("+rich_concepts", real >= 3, 0.1), ("+has_concepts", (real >= 1) & (real < 3), 0.05),
        ("+domain_terms", domains >= 2, 0.1), ("+domain_term", domains == 1, 0.05), ("+specific_tag", ~tag.isin(*GENERIC_TAGS) & (F.length(tag) > 2), 0.05), ("+rich_triples", full >= 3, 0.1), ("+has_triples", (full >= 1) & (full < 3), 0.05),
        ("+detailed_purpose", F.length(purpose) >= 80, 0.05), ("+rich_evidence", (F.length(why) >= 120) & (evidence >= 2), 0.1), ("+some_evidence", (F.length(why) >= 120) & (evidence == 1), 0.05),
        ("+compliance", F.size(compliance) > 0, 0.05), ("+architecture", ~pattern.isin("unknown", "other"), 0.05),
    ]
    failed = F.contains(F.lower(purpose), F.lit("classification failed"))
    holds = [(f, F.coalesce(c, F.lit(False)), p if isinstance(p, Column) else F.lit(p)) for f, c, p in rules]
    total = reduce(lambda a, x: a + F.when(x[1], x[2]).otherwise(0.0), holds, F.lit(0.5))
    bonus = reduce(lambda a, x: a + F.when(x[1] & (x[2] > 0), x[2]).otherwise(0.0), holds, F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.round_half_up(F.when(failed, bonus).otherwise(total), 2)))
    return score, F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c, _ in holds]))


def calibrated_confidence(callers: Column, callees: Column, percentile: Column, docs: Column, tests: Column, descriptive: Column, llm: Column, tier: Column) -> Column:
    """Structural share up to 0.5, intent up to 0.3, the model's own by its tier."""
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    weight = reduce(lambda rest, x: F.when(tier == x[0], x[1]).otherwise(rest), TIER_WEIGHTS.items(), F.lit(0.15))
    structural = part(callers, 0.25) + part(callees, 0.15) + part(F.coalesce(percentile, F.lit(0)) > 50, 0.10)
    intent = part(docs, 0.15) + part(tests, 0.10) + part(descriptive, 0.05)
    return F.least(structural + intent + F.least(llm, F.lit(1.0)) * weight, F.lit(1.0))


def descriptive_name(name: Column) -> Column:
    base = F.lower(F.regexp_replace(F.regexp_replace(name, "^(get|set|is|has|on|_)", ""), "(Handler|Callback|Fn|Impl)$", ""))
    return (F.length(name) > 3) & ~base.isin(*NON_DESCRIPTIVE) & ~F.lower(name).isin(*NON_DESCRIPTIVE)


def fingerprint_tokens(percentile: Column, depth: Column, fan_ratio: Column, boundary: Column, community: Column) -> Column:
    central = F.when(percentile >= 95, "critical").when(percentile >= 75, "high").when(percentile >= 25, "medium").otherwise("low")
    role = F.when(fan_ratio > 2, "orchestrator").when(fan_ratio >= 0.5, "connector").otherwise("leaf/utility")
    where = F.when(depth >= 99, "disconnected").otherwise(F.concat(depth.cast("string"), F.lit(" hops from entry")))
    parts = [
        F.concat(F.lit("Centrality: "), central, F.lit(" (P"), F.floor(percentile + 0.5).cast("string"), F.lit(")")), F.concat(F.lit("Depth: "), where), F.concat(F.lit("Role: "), role),
        F.concat(F.lit("Boundary: "), F.when(boundary, "yes").otherwise("no")), F.when(community >= 0, F.concat(F.lit("Community: "), community.cast("string"))),
    ]
    return F.concat_ws(" | ", *parts)


def model_tier(name: Column, path: Column, kind: Column, centrality: Column, complexity: Column, callers: Column) -> Column:
    safe = name.rlike(SAFETY) | path.rlike(SAFETY)
    return F.when(safe | (centrality > 0.8) | (complexity >= 10) | (callers >= 8), "premium").when(kind.isin("variable", "constant"), "fast").otherwise("standard")


def decay_score(triggered: Column, overridden: Column, false_positive: Column, fixed: Column, days: Column) -> Column:
    """1 is healthy: overrides weigh 0.4, false positives 0.3, up to 90 idle days 0.2, missing fixes 0.1."""
    total = F.when(F.coalesce(triggered, F.lit(0)) == 0, 1).otherwise(triggered)
    loss = 0.4 * overridden / total + 0.3 * false_positive / total + 0.2 * F.least(days / 90.0, F.lit(1.0)) + 0.1 * (1 - fixed / total)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - loss))


def rule_health(events: DataFrame) -> DataFrame:
    """Counters per rule from its events (rule_id, event, ts)."""
    n = lambda e: F.count_if(F.col("event") == e)
    return events.groupBy("rule_id").agg(n("triggered").alias("triggered_count"), n("overridden").alias("overridden_count"), n("false_positive").alias("false_positive_count"), n("auto_fixed").alias("auto_fixed_count"), F.max(F.when(F.col("event") == "triggered", F.col("ts"))).alias("last_triggered_at"))


def prompt_drift(prompts: DataFrame, keys: list[str], at: str, text: str, threshold: float = 0.7) -> DataFrame:
    """Whether a conversation's last prompt is close to two or more before it: (…, similarity, drifting)."""
    toks = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9\\s]", " "), "\\s+"), lambda t: F.length(t) > 2))
    g = prompts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), toks.alias("t")))), lambda x: x["t"]).alias("ps"))
    last = F.element_at("ps", -1)
    sims = F.transform(F.slice("ps", F.lit(1), F.size("ps") - 1), lambda p: s.jaccard(last, p))
    enough = F.size("ps") >= 3
    return g.select(*keys, F.when(enough, F.array_max(sims)).otherwise(0.0).alias("similarity"), (enough & (F.size(F.filter(sims, lambda x: x > threshold)) >= 2)).alias("drifting"))


def similar_pairs(rows: DataFrame, col: str, least: float = 0.75) -> DataFrame:
    """(a, b) for all distinct values a < b of ``col`` whose edit-distance similarity is ``least`` or more; exact.

    Two such values differ by at most t = length of the longer * (1 - least) edits.  The longer one is cut into t + 1
    pieces, of which one at least is whole in the other, moved by t places at most: pieces and places of the same
    lengths are joined, and the pairs that meet are compared.  Nothing but equal pieces brings values together."""
    x = rows.select(F.col(col).alias("v")).where("v is not null").distinct().withColumn("n", F.length("v"))
    edits = lambda m: F.floor(m * (1 - least) + 1e-9).cast("int")
    cut = lambda i: F.floor(i * F.col("m") / (F.col("t") + 1)).cast("int")
    piece = lambda at: F.substring(F.col("v"), at + 1, F.col("size"))

    def pieces(df: DataFrame) -> DataFrame:
        df = df.withColumn("t", edits(F.col("m"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t"))))
        return df.withColumn("at", cut(F.col("i"))).withColumn("size", cut(F.col("i") + 1) - F.col("at"))

    long = pieces(x.withColumn("m", F.col("n"))).select("m", "i", piece(F.col("at")).alias("p"), F.col("v").alias("y"))
    short = pieces(x.withColumn("m", F.explode(F.sequence("n", F.floor(F.col("n") / least + 1e-9).cast("int")))))
    low, high = F.greatest(F.lit(0), F.col("at") - F.col("t")), F.least(F.col("n") - F.col("size"), F.col("at") + F.col("t"))
    short = short.withColumn("s", F.explode(F.when(low <= high, F.sequence(low, high)))).select("m", "i", piece(F.col("s")).alias("p"), F.col("v").alias("x")).distinct()
    met = short.join(long, ["m", "i", "p"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return met.where(s.levenshtein_similarity(F.col("a"), F.col("b")) >= least)


def merge_tags(tags: DataFrame, least: float = 0.75) -> DataFrame:
    """(tag, canonical) for tags (tag, n): tags that chains of similar tags connect become the most frequent of them
    (then the first by name).  Clusters are whole, whatever the order of the tags."""
    pairs = materialise(similar_pairs(tags, "tag", least), "similar")
    roots = connected(pairs, "a", "b")
    t = tags.select("tag", "n").join(roots.select(F.col("node").alias("tag"), "root"), "tag", "left").withColumn("root", F.coalesce("root", "tag"))
    best = t.groupBy("root").agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("canonical"))
    return t.join(best, "root").select("tag", "canonical")


def fingerprint(text: Column) -> Column:
    """32 hex digits of a text's SHA-256 with its white space made one space each."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(text, "[ \\t\\n]+", " ")), 256), 1, 32)


def quarantine(files: DataFrame, size: str, most: int = 5 * 1024 * 1024, failed: Column | None = None) -> DataFrame:
    """Files with the reason they are not parsed: too large, failed (a condition), or null for those that are."""
    reason = F.when(F.col(size) > most, "file_too_large")
    return files.withColumn("reason", reason if failed is None else reason.when(failed, "extraction_error"))


def healed(quarantined: DataFrame, files: DataFrame) -> DataFrame:
    """Placeholders (file_path) whose files parse again, to be replaced: those with a row and no reason in ``files``."""
    return quarantined.join(files.where("reason is null").select("file_path"), "file_path", "left_semi")


def merge_significance(events: DataFrame, keys: list[str], significant: Column, least: int = 10) -> DataFrame:
    """(keys, significant): the added entities of (keys, added) reach ``least``, or any row is significant by itself."""
    return events.groupBy(*keys).agg((F.coalesce(F.sum("added"), F.lit(0)) >= least).alias("many_"), F.bool_or(F.coalesce(significant, F.lit(False))).alias("any_")).select(*keys, F.expr("many_ or any_").alias("significant"))
