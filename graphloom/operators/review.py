"""Checks over a set of changed entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cut_lines
from . import graph

# What third-party packages are for, by prefix, in order.
CATEGORIES = (
    ("database", ("@prisma/", "prisma", "mongoose", "typeorm", "pg", "mysql", "sqlalchemy", "redis", "ioredis", "knex")),
    ("http", ("axios", "node-fetch", "got", "requests", "httpx", "express", "fastify", "net/http")),
    ("auth", ("next-auth", "passport", "jsonwebtoken", "bcrypt")),
    ("testing", ("vitest", "jest", "mocha", "pytest", "@testing-library/")),
    ("ui", ("react", "vue", "svelte", "@radix-ui/")),
)


def boundary_category(imports: DataFrame, col: str = "package") -> DataFrame:
    """``imports`` with the category of the first prefix that fits, else other."""
    out = F.lit("other")
    for name, prefixes in reversed(CATEGORIES):
        fits = F.lit(False)
        for x in prefixes:
            fits = fits | F.startswith(F.col(col), F.lit(x))
        out = F.when(fits, name).otherwise(out)
    return imports.withColumn("category", out)


def impact_check(changed: DataFrame, edges: DataFrame, threshold: int = 15) -> DataFrame:
    """Changed entities with many callers, and their five first callers."""
    calls = edges.where("kind = 'calls'").select(F.col("dst").alias("id"), "src")
    n = calls.join(changed.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("callers"), F.slice(F.array_sort(F.collect_list("src")), 1, 5).alias("top"))
    return n.where(F.col("callers") >= threshold)


def complexity_check(changed: DataFrame, threshold: int = 10) -> DataFrame:
    return changed.where(F.col("complexity") >= threshold)


def in_changed_lines(found: DataFrame, ranges: list[tuple[int, int]], line: str = "line") -> DataFrame:
    """Findings inside a diff's changed line ranges."""
    hunks = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ranges])
    return found.where(F.exists(hunks, lambda h: (F.col(line) >= h["s"]) & (F.col(line) <= h["e"])))


def test_paths(path: Column) -> Column:
    """Where a file's tests would be."""
    folder, base = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)\.[jt]sx?$", 1)
    return F.array(*[F.concat(folder, F.lit(pre), base, F.lit(post)) for pre in ("__tests__/", "") for post in (".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx")])


def without_tests(files: DataFrame, tests: DataFrame) -> DataFrame:
    """Files of which no test file exists."""
    have = files.select("id", F.explode(test_paths(F.col("file_path"))).alias("t")).join(tests.select(F.col("file_path").alias("t")), "t", "left_semi").select("id").distinct()
    return files.join(have, "id", "left_anti")


def env_usage(lines: DataFrame, col: str = "line") -> DataFrame:
    """Environment variables that code reads."""
    found = F.regexp_extract_all(F.col(col), F.lit(r"(?:process\.env\.|os\.environ(?:\.get)?[\[(]['\"]|os\.Getenv\(\")([A-Z][A-Z0-9_]*)"), F.lit(1))
    return lines.select(F.explode(found).alias("variable")).distinct()


# How many elements an answer's lists keep.
LIST_CAPS = {"callers": 20, "callees": 20, "results": 50, "imports": 30, "entities": 50}
BODIES = ("body", "source", "content", "code")
HINT = "[truncated — call get_function with specific name for full details]"


def cap_payload(rows: DataFrame, most: int) -> DataFrame:
    """Rows as answers of at most about ``most`` bytes of JSON: longer ones lose the ends of their lists (and say so in
    _<list>Truncated), then the last lines of their bodies; ``_hint`` says that one is still too long.

    Shorter rows stay as they are; missing columns are passed over; null lists and bodies stay null."""
    size = lambda df: F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    out = rows.withColumn("size_", size(rows))
    lists = {c: n for c, n in LIST_CAPS.items() if c in rows.columns and rows.schema[c].dataType.typeName() == "array"}
    over = F.col("size_") > most
    for c, n in lists.items():
        out = out.withColumn(f"_{c}Truncated", F.coalesce(over & (F.size(c) > n), F.lit(False))).withColumn(c, F.when(over, F.slice(c, 1, n)).otherwise(F.col(c)))
    out = out.withColumn("size_", size(out))
    for c in [x for x in BODIES if x in rows.columns and rows.schema[x].dataType.typeName() == "string"]:
        budget = F.greatest(F.lit(most) - (F.col("size_") - F.octet_length(c)) - 200, F.lit(500))
        out = out.withColumn(c, F.when(over & (F.col("size_") > most), cut_lines(F.col(c), budget)).otherwise(F.col(c)))
    return out.withColumn("_hint", F.when(size(out) > most, HINT)).drop("size_")


def review_comments(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A comment for each review (``keys``) from findings (check, severity, file_path, line, message): verdict, count
    by severity, and the findings as lines, errors first, then by file and line.  No findings give no comment."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    line = F.concat(F.lit("- **"), "check", F.lit("** `"), "file_path", F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""), F.lit("`: "), "message")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "file_path", "line", "check", line.alias("text")))), lambda x: x["text"])
    n = lambda s: F.count_if(F.col("severity") == s)
    g = findings.groupBy(*keys).agg(n("error").alias("errors"), n("warning").alias("warnings"), F.count("*").alias("findings"), rows.alias("rows"))
    head = F.concat(F.lit("## Review: "), F.when(F.col("errors") > 0, "changes requested").otherwise("comments"), F.lit("\n\n"), F.col("errors").cast("string"), F.lit(" errors, "), F.col("warnings").cast("string"), F.lit(" warnings\n\n"))
    return g.select(*keys, "errors", "warnings", "findings", F.concat(head, F.array_join("rows", "\n"), F.lit("\n")).alias("body"))


# Names that show what an entity does.
VALIDATES = "(?i)auth|valid|sanitiz|middleware|guard|protect|verify|permission"
MUTATES = "(?i)insert|update|delete|upsert|save|create|remove|destroy|drop|write"
TRIGGERED = "(?i)webhook|handler|on[A-Z]\\w*Event|trigger|consumer|listener|subscriber"
WRITES = "(?i)insert|update|delete|upsert|save|create|remove|destroy|write|put|post"
ONCE = "(?i)idempoten|dedup|upsert|lock|mutex|semaphore|once|unique.*constraint"
CALLABLE = ("function", "method")


def _met(found: DataFrame, flags: DataFrame) -> DataFrame:
    """(id and, for each flag of ``flags`` (id, flags…), whether any entity reached from it (seed, id) has it)."""
    names = [c for c in flags.columns if c != "id"]
    return found.select("seed", "id").join(flags, "id").groupBy(F.col("seed").alias("id")).agg(*[F.bool_or(n).alias(n) for n in names])


def trust_boundary(changed: DataFrame, edges: DataFrame, entities: DataFrame, route: Column, mutation: Column, validator: Column, vouched: DataFrame | None = None, hops: int = 3) -> DataFrame:
    """Changed callables between a route that reaches them and a mutation they reach within ``hops`` calls, with no
    validator among callers, callees or themselves; route, mutation and validator are conditions on entities.  Those in
    ``vouched`` (id) are left out."""
    calls = edges.where("kind = 'calls'")
    seeds = changed.where(F.col("kind").isin(*CALLABLE))
    flag = lambda c: F.coalesce(c, F.lit(False))
    flags = entities.select("id", flag(route).alias("route"), flag(mutation).alias("mutation"), flag(validator).alias("guard"))
    up = _met(graph.traverse(calls, seeds.select("id"), hops), flags.select("id", "route", "guard")).withColumnRenamed("guard", "guard_up")
    down = _met(graph.traverse(calls, seeds.select("id"), hops, inbound=False), flags.select("id", "mutation", "guard"))
    own = flags.select("id", F.col("guard").alias("guard_own"))
    out = seeds.join(up, "id").join(down, "id").join(own, "id", "left").where("route and mutation and not guard and not guard_up and not coalesce(guard_own, false)").select(*changed.columns)
    return out if vouched is None else out.join(vouched.select("id"), "id", "left_anti")


def idempotency(changed: DataFrame, edges: DataFrame, entities: DataFrame, triggered: Column, mutation: Column, guard: Column, hops: int = 2) -> DataFrame:
    """Changed callables that ``triggered`` holds for and that reach a mutation within ``hops`` calls, neither they nor
    anything reached being a guard."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    flags = entities.select("id", flag(mutation).alias("mutation"), flag(guard).alias("guard"))
    seeds = changed.where(F.col("kind").isin(*CALLABLE)).where(triggered)
    down = _met(graph.traverse(edges.where("kind = 'calls'"), seeds.select("id"), hops, inbound=False), flags)
    own = flags.select("id", F.col("guard").alias("guard_own"))
    return seeds.join(down, "id").join(own, "id", "left").where("mutation and not guard and not coalesce(guard_own, false)").select(*changed.columns)


def contract_check(changed: DataFrame, edges: DataFrame, entities: DataFrame, kinds: tuple[str, ...] = ("api_route", "webhook_handler"), hops: int = 1) -> DataFrame:
    """Changed entities that something of those kinds calls within ``hops``."""
    ends = entities.where(F.col("kind").isin(*kinds)).select("id")
    hit = graph.traverse(edges.where("kind = 'calls'"), changed.select("id"), hops).join(ends, "id", "left_semi").select(F.col("seed").alias("id")).distinct()
    return changed.join(hit, "id", "left_semi")


def looks_good(changed: DataFrame, justifications: DataFrame, edges: DataFrame, keys: list[str], callers: int = 5, errors: DataFrame | None = None, areas: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, approve): all changed entities are justified, none is business code, outside the ``areas`` of low risk (None:
    any feature) or has more than ``callers`` callers, and no finding (``errors``: keys) stands against them."""
    n = edges.where("kind = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers_"))
    x = changed.select("id", *keys).join(justifications.select(F.col("entity_id").alias("id"), "taxonomy", "feature_tag"), "id", "left").join(n, "id", "left")
    ok = F.coalesce(F.col("taxonomy") != "VERTICAL", F.lit(False)) & (F.coalesce("callers_", F.lit(0)) <= callers)
    if areas is not None:
        ok = ok & F.coalesce(F.col("feature_tag").isin(*areas), F.lit(False))
    out = x.groupBy(*keys).agg(F.bool_and(ok).alias("approve"))
    if errors is None:
        return out
    return out.join(errors.select(*keys).distinct().withColumn("wrong_", F.lit(True)), keys, "left").withColumn("approve", F.col("approve") & F.col("wrong_").isNull()).drop("wrong_")
