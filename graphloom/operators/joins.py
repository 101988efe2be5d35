"""Joins of the code graph: lookups, intervals, as-of, deltas, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import materialise, materialise_telling


def touching(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with an end in ``keys``, each once."""
    k = keys.select(F.col("id").alias("k_")).distinct()
    return edges.join(k, F.col("src") == F.col("k_"), "left_semi").unionAll(edges.join(k, F.col("dst") == F.col("k_"), "left_semi")).distinct()


def unreferenced(entities: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("calls", "references", "imports")) -> DataFrame:
    """Entities that no edge of those kinds leads to."""
    used = edges.where(F.col("kind").isin(*kinds)).select(F.col("dst").alias("u_")).distinct()
    return entities.join(used, F.col("id") == F.col("u_"), "left_anti")


def overlaps(hunks: DataFrame, entities: DataFrame, bucket: int = 64, crowd: int = 1000) -> DataFrame:
    """Hunks (file_path, start, end) that overlap entities of their file (start_line, end_line).

    Both sides are dealt out by file and by the line ranges' buckets, and the entities of a bucket that holds more than ``crowd`` of
    them by parts of about that many, each of which meets all hunks of the bucket: no file or bucket is one task's work.  A pair
    meets in several buckets but counts in the first that both share."""
    span = lambda s, e: F.sequence(F.floor(s / bucket).cast("int"), F.floor(e / bucket).cast("int"))
    h = hunks.withColumn("b_", F.explode(span(F.col("start"), F.col("end"))))
    e = entities.withColumn("b_", F.explode(span(F.col("start_line"), F.col("end_line"))))
    full = e.groupBy("file_path", "b_").agg(F.ceil(F.count("*") / crowd).cast("int").alias("k_")).where("k_ > 1")
    full = materialise(full, "crowds")
    keys = ["file_path", "b_"]
    if full.head(1):
        k = F.coalesce("k_", F.lit(1))
        h = h.join(full, keys, "left").withColumn("p_", F.explode(F.sequence(F.lit(0), k - 1))).drop("k_")
        e = e.join(full, keys, "left").withColumn("p_", F.pmod(F.xxhash64(*entities.columns), k).cast("int")).drop("k_")
        keys = [*keys, "p_"]
        n = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs outnumber rows: few bytes are no small task
        h, e = h.repartition(n, *keys), e.repartition(n, *keys)
    j = h.join(e, keys).where((F.col("start") <= F.col("end_line")) & (F.col("end") >= F.col("start_line")))
    first = F.floor(F.greatest("start", "start_line") / bucket).cast("int")
    return j.where(F.col("b_") == first).drop("b_", "p_")


def containing(refs: DataFrame, entities: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """As-of: for each reference, the last entity of its key that starts at or before it (null if none).

    One sort of both sides together and a running last value; no pairs are made."""
    a = refs.select(*keys, F.col(line).alias("at_"), F.lit(1).alias("side_"), F.struct(*refs.columns).alias("ref_"), F.lit(None).cast("struct<id:bigint,start_line:bigint>").alias("ent_"))
    b = entities.select(*keys, F.col("start_line").alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(a.schema["ref_"].dataType).alias("ref_"), F.struct(F.col("id").cast("long").alias("id"), F.col("start_line").cast("long").alias("start_line")).alias("ent_"))
    w = W.partitionBy(*keys).orderBy("at_", "side_", F.col("ent_.id")).rowsBetween(W.unboundedPreceding, 0)
    j = a.unionByName(b).withColumn("ent_", F.last("ent_", ignorenulls=True).over(w)).where("side_ = 1")
    return j.select("ref_.*", F.col("ent_.id").alias("entity_id"))


def diff_sets(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change): added, updated or deleted, by one full outer join and null-safe comparison."""
    o = old.select(F.col(key).alias("k_o"), F.struct(*compared).alias("o_"))
    n = new.select(F.col(key).alias("k_n"), F.struct(*compared).alias("n_"))
    j = o.join(n, F.col("k_o") == F.col("k_n"), "full")
    change = F.when(F.col("k_o").isNull(), "added").when(F.col("k_n").isNull(), "deleted").when(~F.col("o_").eqNullSafe(F.col("n_")), "updated")
    return j.select(F.coalesce("k_n", "k_o").alias(key), change.alias("change")).where("change is not null")


def moves(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Deleted and added entities of equal fingerprint and kind, matched one to one in order of id."""
    n = lambda df, c: df.select("fingerprint", "kind", F.col("id").alias(c), F.row_number().over(W.partitionBy("fingerprint", "kind").orderBy("id")).alias("n_"))
    return n(deleted, "old_id").join(n(added, "new_id"), ["fingerprint", "kind", "n_"]).select("old_id", "new_id", "kind", "fingerprint")


def scope_overlay(rows: DataFrame, scope: str) -> DataFrame:
    """The view of a scope: its own rows, and primary rows that it neither replaces nor deletes."""
    own = rows.where(F.col("scope") == scope)
    primary = rows.where("scope = 'primary'").join(own.select(F.col("id").alias("o_")), F.col("id") == F.col("o_"), "left_anti")
    return primary.unionByName(own.where("kind <> 'tombstone'"))


def first_of_layers(keys: DataFrame, *layers: DataFrame) -> DataFrame:
    """For each key the row of the first layer that has it: one pass over all layers with their rank."""
    all_ = None
    for i, layer in enumerate(layers):
        x = layer.withColumn("layer_", F.lit(i))
        all_ = x if all_ is None else all_.unionByName(x)
    rest = [c for c in all_.columns if c != "id"]
    best = all_.join(keys.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*rest), "layer_").alias("r_"))
    return best.select("id", *[F.col(f"r_.{c}").alias(c) for c in rest if c != "layer_"], F.col("r_.layer_").alias("layer"))


CROWD = 1000  # items of one group whose pairs come out of one array
PAIRS = 500_000  # pairs of a task


def co_occurrence(rows: DataFrame, group: str, item: str, least: int = 1, crowd: int = CROWD, share: int = PAIRS) -> DataFrame:
    """(a, b, support) for items a < b that share ``least`` groups or more, with each one's own count.

    Items in fewer groups go first.  Groups of up to ``crowd`` items are arrays once and pairs come out of them, so no
    self-join of the rows is shuffled; larger ones are joined with themselves in parts, so no task holds a whole one.

    Pairs are counted before they are made, so that a task makes and counts ``share`` of them however many there are.  Where
    items are so few that pairs must recur, they are counted where they are made and only the counts are shuffled."""
    per = materialise(rows.select(F.col(group).alias("g_"), F.col(item).alias("i_")).where("i_ is not null").distinct(), "items")
    counts, items = materialise_telling(per.groupBy("i_").agg(F.count("*").alias("n")), "items", n=F.count("*"))
    if least > 1 and (rare := counts.where(F.col("n") < least).select("i_")).head(1):
        per = per.join(rare, "i_", "left_anti")
    seen, n = Observation(), F.col("n").cast("double")
    sizes = per.groupBy("g_").agg(F.count("*").alias("n")).observe(seen, F.sum(n * (n - 1) / 2).alias("pairs"))
    large = materialise(sizes.where(F.col("n") > crowd).select("g_", F.ceil(F.col("n") / crowd).cast("int").alias("k")), "crowds")
    some, total = bool(large.head(1)), seen.get["pairs"] or 0.0
    parts = int(total // share) + 1
    small = per.join(large.select("g_"), "g_", "left_anti") if some else per
    sets = small.repartition(parts, "g_").groupBy("g_").agg(F.array_sort(F.collect_list("i_")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode(F.filter("s", lambda x: x > F.col("a"))).alias("b"))
    if some:
        part = lambda c: F.pmod(F.xxhash64(c), F.col("k")).cast("int")
        x = per.join(large, "g_")
        one = x.select("g_", F.col("i_").alias("a"), part("i_").alias("p"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"))
        two = x.select("g_", F.col("i_").alias("b"), part("i_").alias("q"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("p"))
        pairs = pairs.unionAll(one.join(two, ["g_", "p", "q"]).where("a < b").select("a", "b"))
    if total < items["n"] ** 2 / 2:
        pairs = pairs.repartition(parts, "a", "b")
    support = pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    out = support.join(counts.select(F.col("i_").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("i_").alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "support", "n_a", "n_b")


def band_first(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, width: int) -> DataFrame:
    """For each left row the first right row (by start, id) with \\|start - at\\| < width.

    Lines are whole numbers: rows of equal position count once, the left by (keys, at), the right by (keys, start) with its
    least id, and both meet in buckets of the width, each left position looking into its own and the two beside it.  So
    a position meets 2 * width - 1 starts at most, however many rows stand there; rows then look their position up."""
    spots = left.select(*keys, at).distinct().withColumn("b_", F.explode(F.array(*[F.floor(F.col(at) / width) + k for k in (-1, 0, 1)])))
    starts = right.groupBy(*keys, start).agg(F.min("id").alias("id")).withColumn("b_", F.floor(F.col(start) / width))
    met = spots.join(starts, [*keys, "b_"]).where(F.abs(F.col(start) - F.col(at)) < width)
    first = met.groupBy(*keys, at).agg(F.min(F.struct(start, "id"))["id"].alias("entity_id"))
    return left.distinct().join(first, [*keys, at]).select(*left.columns, "entity_id")


def neighbour_sets(edges: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Callers and callees of each entity as arrays of at most ``most``, smallest ids first."""
    from .windows import first_per_group

    i = first_per_group(edges, ["dst"], ["src"], most).groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("callers"))
    o = first_per_group(edges, ["src"], ["dst"], most).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("callees"))
    return i, o


def glob_regex(glob: Column) -> Column:
    """A path glob as an anchored regular expression: ** spans directories, * stays within one."""
    c = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\*\*", "\u0001"), r"\*", "[^/]*")
    return F.concat(F.lit("^"), F.replace(c, F.lit("\u0001"), F.lit(".*")), F.lit("$"))
