"""What surrounds an entity: ends of edges, justifications, imports, tests, siblings, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with name and kind (dst_kind) of what they lead to; dangling ones and those to tombstones drop out."""
    v = entities.where("kind <> 'tombstone'").select(F.col("id").alias("dst"), "name", F.col("kind").alias("dst_kind"))
    return edges.join(v, "dst").select(*edges.columns, "name", "dst_kind")


def justified(entities: DataFrame, justifications: DataFrame, how: str = "left") -> DataFrame:
    """Entities with the columns of their current justification (at most one each)."""
    return entities.join(justifications.withColumnRenamed("entity_id", "id"), "id", how)


def with_total(rows: DataFrame) -> DataFrame:
    """Rows with how many there are: one aggregate that goes along as a broadcast row."""
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("total"))), how="left")


def cross_feature_calls(edges: DataFrame, justifications: DataFrame, entities: DataFrame, names: str) -> DataFrame:
    """(src, dst, from_feature, to_feature, name) of calls from one feature into another's callees of that name pattern."""
    v = entities.where(F.col("name").rlike(names)).select(F.col("id").alias("dst"), "name")
    a = justifications.select(F.col("entity_id").alias("src"), F.col("feature_tag").alias("from_feature"))
    b = justifications.select(F.col("entity_id").alias("dst"), F.col("feature_tag").alias("to_feature"))
    x = edges.where("kind = 'calls'").join(v, "dst").join(a, "src").join(b, "dst").where("from_feature <> to_feature")
    return x.select("src", "dst", "from_feature", "to_feature", "name")


def imported_entities(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, members, n): the entities that each importer reaches, in order of id."""
    x = edges.where("kind = 'imports'").join(entities.select(F.col("id").alias("dst")), "dst")
    return x.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("members"), F.count("*").alias("n"))


def at_line(entities: DataFrame, line: int, path: str | None = None) -> DataFrame:
    """Entities whose lines hold a position; one without an end goes to the end of its file."""
    x = entities if path is None else entities.where(F.col("file_path") == path)
    return x.where((F.col("start_line") <= line) & (F.col("end_line").isNull() | (F.col("end_line") >= line)))


def boundary(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(id): importers of something that is not a known entity."""
    return edges.where("kind = 'imports'").join(known.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id")).distinct()


def edge_delta(base: DataFrame, branch: DataFrame) -> DataFrame:
    """(src, dst, kind, change): edges that only the branch has (added) or only the base (deleted).

    Both sides meet in one aggregate: a task holds a row an edge, no sorted copies of either side."""
    keys = ["src", "dst", "kind"]
    side = lambda df, is_branch: df.select(*keys, F.lit(is_branch).alias("in_"))
    seen = side(branch, True).unionAll(side(base, False)).groupBy(*keys).agg(F.bool_or("in_").alias("new_"), F.bool_and("in_").alias("only_"))
    return seen.where("not new_ or only_").select(*keys, F.when(F.col("new_"), "added").otherwise("deleted").alias("change"))


def tests_of(edges: DataFrame, entities: DataFrame, is_test: Column, stem: Column | None = None) -> DataFrame:
    """(id, test_id): callers that are tests of what is none, and where ``stem`` (what the path of a file and of its
    test have in common) is given, the tests of the same stem."""
    e = entities.select("id", F.coalesce(is_test, F.lit(False)).alias("test"), *([stem.alias("stem")] if stem is not None else []))
    tests, others = e.where("test").select(F.col("id").alias("test_id"), *e.columns[2:]), e.where("not test").drop("test")
    found = edges.where("kind = 'calls'").select(F.col("src").alias("test_id"), F.col("dst").alias("id")).join(tests.select("test_id"), "test_id", "left_semi").join(others.select("id"), "id", "left_semi").select("id", "test_id")
    if stem is not None:
        found = found.unionByName(others.join(tests, "stem").select("id", "test_id"))
    return found.distinct()


MEMBERS = 500  # of a parent in one part: its list is shuffled once for so many
LISTED = 10_000_000  # ids that a task lists


def siblings(entities: DataFrame, parent: list[str], most: int | None = None, joined_by: str | None = None) -> DataFrame:
    """(id, siblings): the others of the same parent (columns) in order, at most the first ``most``; with ``joined_by`` as one
    text.  Entities without a parent (null) and those alone have none.

    All of a parent's ids come together once: a parent is a class or file, the bound is its members.  The lists, as many ids as
    the members' square, are made in parts of ``MEMBERS`` members, dealt out by the number of ids: what stands before a part's
    members and after them is put together once a part."""
    e = entities.select("id", *parent).dropna(subset=parent)
    groups = e.groupBy(*parent).agg(F.array_sort(F.collect_list("id")).alias("all")).select("all").where(F.get("all", F.lit(0)) < F.element_at("all", -1))
    each = F.count("id").cast("double")
    total = e.groupBy(*parent).agg((each * (each if most is None else F.least(each, F.lit(most + 1.0)))).alias("n")).agg(F.sum("n")).first()[0] or 0.0
    part = F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / MEMBERS).cast("int"))).alias("part")
    x = groups.select("all", part).repartition(int(total // LISTED) + 1)
    x = x.select("all", F.slice("all", F.col("part") * MEMBERS + 1, MEMBERS).alias("ids"))
    low, high = F.get("ids", F.lit(0)), F.element_at("ids", -1)
    shown = F.col("all") if most is None else F.slice("all", 1, most + 1)
    x = x.select("ids", F.filter(shown, lambda v: v < low).alias("before"), F.filter(shown, lambda v: v.between(low, high)).alias("among"), F.filter(shown, lambda v: v > high).alias("after"))
    own = F.array_remove("among", F.col("id"))
    if joined_by is not None and most is None:
        text = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), joined_by)).alias(c)
        x = x.select("ids", text("before"), "among", text("after"))
        return x.select(F.explode("ids").alias("id"), "before", "among", "after").select("id", F.concat_ws(joined_by, "before", own.cast("array<string>"), "after").alias("siblings"))
    x = x.select(F.explode("ids").alias("id"), "before", "among", "after").select("id", F.concat("before", own, "after").alias("siblings")).where(F.size("siblings") > 0)
    x = x if most is None else x.withColumn("siblings", F.slice("siblings", 1, most))
    return x if joined_by is None else x.withColumn("siblings", F.array_join(F.col("siblings").cast("array<string>"), joined_by))


def new_dependencies(imported: DataFrame, known: DataFrame) -> DataFrame:
    """(dep): packages that a change imports and nothing imported before."""
    return imported.select("dep").distinct().join(known.select("dep"), "dep", "left_anti")


def hubs(edges: DataFrame, least: int = 50) -> DataFrame:
    """(id, callers) of entities with ``least`` callers or more."""
    return edges.where("kind = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers")).where(F.col("callers") >= least)


def neighbourhood(edges: DataFrame) -> DataFrame:
    """(id, inbound, outbound, kinds): how many edges come and go, and their kinds in order."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(True).alias("into"), "kind").unionAll(edges.select("src", F.lit(False), "kind"))
    return ends.groupBy("id").agg(F.count_if("into").alias("inbound"), F.count_if(~F.col("into")).alias("outbound"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def rank_rules(rules: DataFrame, near: DataFrame, most: int = 10) -> DataFrame:
    """Rules (rule, priority, kinds: array, fits_file: boolean) with their score, best first: priority (50 if null), 5 for
    every entity nearby (id, kind) of a kind the rule is about, 20 if it is about the file's type."""
    n = near.select("id", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    hits = rules.select("rule", F.explode(F.array_distinct("kinds")).alias("kind")).join(n, "kind").groupBy("rule").agg(F.sum("n").alias("n"))
    score = F.coalesce("priority", F.lit(50)) + 5 * F.coalesce("n", F.lit(0)) + F.when(F.col("fits_file"), 20).otherwise(0)
    return rules.join(hits, "rule", "left").withColumn("score", score).drop("n").orderBy(F.desc("score"), "rule").limit(most)
