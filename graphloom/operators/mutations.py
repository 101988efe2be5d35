"""Writes as set operations: each gives the table after the change, to be written as the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import entity_id

# States of a ledger entry and what each may become.
TRANSITIONS = {
    "pending": ("working", "broken", "committed", "reverted"), "working": ("broken", "committed", "reverted"),
    "broken": ("working", "reverted"), "committed": (), "reverted": (),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, the new one's non-null columns win."""
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.struct(*new.columns).alias("n_"))
    on = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = old.withColumn("o_", F.lit(1)).join(n, cond, "full")
    names = [*old.columns, *[c for c in new.columns if c not in old.columns]]
    pick = lambda c: F.coalesce(F.col(f"n_.{c}"), F.col(c)) if c in new.columns and c in old.columns else F.col(f"n_.{c}") if c in new.columns else F.col(c)
    return both.select(*[pick(c).alias(c) for c in names])


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("r_")).select(*keys, *[F.col(f"r_.{c}").alias(c) for c in rest])


def file_entities(entities: DataFrame, repo: str) -> DataFrame:
    """A file entity per path (id, name, file_path, members) for the contains edges."""
    f = entities.groupBy("file_path").agg(F.count("*").alias("members"))
    name = F.element_at(F.split("file_path", "/"), -1)
    return f.select(entity_id(F.lit(repo), F.col("file_path"), F.lit("file"), name, F.lit(None).cast("string")).alias("id"), name.alias("name"), "file_path", "members")


def close_and_insert(facts: DataFrame, fresh: DataFrame, key: str, at: Column) -> DataFrame:
    """Current facts of the fresh keys end at ``at``; the fresh ones begin there."""
    hit = fresh.select(F.col(key).alias("f_")).distinct().withColumn("h_", F.lit(True))
    closed = facts.join(hit, F.col(key) == F.col("f_"), "left").withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("h_"), at).otherwise(F.col("valid_to"))).drop("f_", "h_")
    return closed.unionByName(fresh.withColumn("valid_from", at).withColumn("valid_to", F.lit(None).cast("timestamp")))


def apply_branch(rows: DataFrame, scope: str, delta: DataFrame, deleted: DataFrame) -> DataFrame:
    """The scope's rows replaced by a delta and tombstones; other scopes stay."""
    new = delta.withColumn("scope", F.lit(scope))
    dead = deleted.select("id").withColumn("kind", F.lit("tombstone")).withColumn("scope", F.lit(scope))
    return rows.where(F.col("scope") != scope).unionByName(new).unionByName(dead, allowMissingColumns=True)


def delete(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def purge(rows: DataFrame, at: str, since: Column, key: str, prefix: str) -> DataFrame:
    """Rows without those older than ``since`` and those whose key begins with ``prefix``; null times and keys stay."""
    old, overlay = F.coalesce(F.col(at) < since, F.lit(False)), F.coalesce(F.startswith(F.col(key), F.lit(prefix)), F.lit(False))
    return rows.where(~old & ~overlay)


def replace_edges(edges: DataFrame, sources: DataFrame, new: DataFrame) -> DataFrame:
    """The given sources' edges replaced by new ones."""
    return edges.join(sources.select("src").distinct(), "src", "left_anti").unionByName(new).distinct()


def may_become(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for a, to in TRANSITIONS.items():
        if to:
            out = out | ((old == a) & new.isin(*to))
    return out


def compact_body(body: Column, lines: int = 50) -> Column:
    """The first lines, and how many more there are."""
    s = F.split(body, "\n")
    more = F.concat(F.lit("\n… "), (F.size(s) - lines).cast("string"), F.lit(" more lines"))
    return F.concat(F.array_join(F.slice(s, 1, lines), "\n"), F.when(F.size(s) > lines, more).otherwise(""))


def keep_recent(rows: DataFrame, keys: list[str], at: str, tie: str, since: Column) -> DataFrame:
    """Rows since then, and each key's latest whatever its age."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at), tie))
    return rows.withColumn("rn_", rn).where((F.col("rn_") == 1) | (F.col(at) >= since)).drop("rn_")


def shift_lines(entities: DataFrame, hunks: list[tuple[int, int]], line: str = "start_line") -> DataFrame:
    """Entities moved by the added lines of hunks (start, added) that begin before them."""
    h = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(n).alias("n")) for a, n in hunks])
    by = F.aggregate(F.filter(h, lambda x: x["s"] < F.col(line)), F.lit(0), lambda a, x: a + x["n"])
    return entities.withColumn(line, F.col(line) + by)


def write_version(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """A table version as Parquet, by tenant if asked, so readers prune partitions."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def export_snapshot(entities: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """A compacted snapshot: both tables under ``path``, and a manifest row with counts and a checksum of all keys."""
    write_version(entities, f"{path}/entities")
    write_version(edges, f"{path}/edges")
    spark = entities.sparkSession
    e, g = spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/edges")
    mark = lambda df, cols: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h"))
    m = mark(e, ["id"]).select(F.col("n").alias("entities"), F.col("h").alias("a")).join(mark(g, ["src", "dst", "kind"]).select(F.col("n").alias("edges"), F.col("h").alias("b")), how="inner")
    m = m.select("entities", "edges", F.sha2(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("checksum"))
    m.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def import_jsonl(lines: DataFrame, schema: str, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines (value), and counts of created, updated and broken ones."""
    x = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    rows = x.where(F.col(f"r.{key}").isNotNull()).select("r.*")
    k = known.select(F.col(key).alias("k_")).distinct()
    hit = rows.join(k, F.col(key) == F.col("k_"), "left")
    bad = x.where(F.col(f"r.{key}").isNull()).agg(F.count("*").alias("errors"))
    counts = hit.agg(F.count_if(F.col("k_").isNull()).alias("created"), F.count_if(F.col("k_").isNotNull()).alias("updated")).join(bad, how="inner")
    return rows, counts
