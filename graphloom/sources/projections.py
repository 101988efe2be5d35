"""The code-graph relations, projected from the test tables: entities, edges, commits, justifications and so on.

Every projection returns the columns the operators expect of real data; SQL in ``CTES`` gives the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("function", "method", "class", "interface", "variable")
TAXONOMY = ("VERTICAL", "HORIZONTAL", "UTILITY", "VERTICAL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("p_size") % 5).cast("int"))
    return table(spark, d, "part").select(
        F.lit("org").alias("org_id"), F.lit("repo").alias("repo_id"), F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("name"),
        F.concat_ws("/", F.lit("src"), "p_brand", "p_type", F.concat(F.col("p_partkey").cast("string"), F.lit(".ts"))).alias("file_path"),
        (F.col("p_partkey") % 97 + 1).cast("long").alias("start_line"), (F.col("p_partkey") % 97 + 1 + F.col("p_size")).cast("long").alias("end_line"),
        F.concat(F.col("p_name"), F.lit("(a: number)")).alias("signature"), F.col("p_size").cast("long").alias("complexity"),
    )


def line_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of different parts on consecutive lines of an order, with the order's number mod 20."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    pairs = li.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return pairs.where("dst is not null and src <> dst").select("src", "dst", (F.col("l_orderkey") % 20).alias("m"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    kind = F.when(m % 5 == 0, "calls").when(m == 1, "imports").when(m == 2, "references").when(m == 3, "extends").when(m == 4, "implements")
    return line_edges(spark, d).select("src", "dst", kind.alias("kind")).where("kind is not null").distinct()


SHARE = 150_000  # rows of a task where tables are dealt out by their counts


def commits(spark: SparkSession, d: str, file_col: str = "l_partkey") -> DataFrame:
    """(sha, author, ts epoch seconds, subject, file): one row per distinct file of a commit.

    Both sides are dealt out by commit in as many parts as the rows ask for: they are joined and made distinct in one step, whose
    tasks hold no more rows as the tables grow."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey")
    parts = li.count() // SHARE + 1  # from the files' footers
    if file_col != "l_partkey":
        part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), file_col)
        li = li.join(part, "l_partkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.unix_timestamp("o_orderdate").alias("ts"), F.lower("o_orderpriority").alias("subject"))
    return li.select("sha", F.col(file_col).cast("string").alias("file")).repartition(parts, "sha").distinct().join(o.repartition(parts, "sha"), "sha")


def justifications(spark: SparkSession, d: str) -> DataFrame:
    doc, lab = table(spark, d, "documents"), table(spark, d, "labels")
    i = F.col("doc_id")
    return doc.select("doc_id", "source", "lang", "n_chars").join(lab, "doc_id", "left").select(
        i.alias("entity_id"), F.get(F.array(*map(F.lit, TAXONOMY)), (i % 4).cast("int")).alias("taxonomy"),
        (F.col("n_chars") % 100 / 100.0).alias("confidence"), F.when(i % 13 == 0, "unclassified").otherwise(F.col("source")).alias("feature_tag"),
        F.when(i % 17 == 0, "mixed").otherwise("layered").alias("architectural_pattern"), F.array("lang", "source").alias("domain_concepts"),
        F.col("quality"), F.col("toxic"), F.col("n_chars"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").cast("long").alias("label"))


def scd(spark: SparkSession, d: str) -> DataFrame:
    """Facts with valid_from and valid_to (null: current) per (user, event type)."""
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


def scoped(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scoped facts: branch rows, tombstones and primary rows."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("kind"))
    branch = o.where("id % 10 = 0").select("id", (F.col("price") * 2).alias("price"), "kind", F.lit("branch:x").alias("scope"))
    dead = o.where("id % 10 = 1").select("id", F.lit(None).cast("double").alias("price"), F.lit("tombstone").alias("kind"), F.lit("branch:x").alias("scope"))
    return o.withColumn("scope", F.lit("primary")).unionByName(branch).unionByName(dead)


ENTITIES = """entities as (select 'org' as org_id, 'repo' as repo_id, p_partkey as id,
  case p_size % 5 when 0 then 'function' when 1 then 'method' when 2 then 'class' when 3 then 'interface' else 'variable' end as kind,
  p_name as name, 'src/' || p_brand || '/' || p_type || '/' || p_partkey || '.ts' as file_path,
  p_partkey % 97 + 1 as start_line, p_partkey % 97 + 1 + p_size as end_line, p_name || '(a: number)' as signature, p_size::bigint as complexity from part)"""
EDGES = """numbered as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem),
line_edges as (select a.l_partkey as src, b.l_partkey as dst, a.l_orderkey % 20 as m from numbered a join numbered b on a.l_orderkey = b.l_orderkey and b.rn = a.rn + 1 where a.l_partkey <> b.l_partkey),
edges as (select distinct src, dst, case when m % 5 = 0 then 'calls' when m = 1 then 'imports' when m = 2 then 'references' when m = 3 then 'extends' when m = 4 then 'implements' end as kind
  from line_edges where m % 5 = 0 or m in (1, 2, 3, 4))"""


def commits_sql(file_col: str = "l_partkey") -> str:
    join = "" if file_col == "l_partkey" else " join part on p_partkey = l_partkey"
    return f"""commits as (select f.sha, f.file, o_custkey as author, epoch(o_orderdate)::bigint as ts, lower(o_orderpriority) as subject
  from (select distinct l_orderkey as sha, {file_col}::varchar as file from lineitem{join}) f join orders on o_orderkey = f.sha)"""


JUSTIFICATIONS = """justifications as (select d.doc_id as entity_id, case doc_id % 4 when 0 then 'VERTICAL' when 1 then 'HORIZONTAL' when 2 then 'UTILITY' else 'VERTICAL' end as taxonomy,
  (n_chars % 100) / 100.0::double as confidence, case when doc_id % 13 = 0 then 'unclassified' else source end as feature_tag,
  case when doc_id % 17 = 0 then 'mixed' else 'layered' end as architectural_pattern, [lang, source] as domain_concepts, quality, toxic, n_chars
  from documents d left join labels using (doc_id))"""
VECTORS = "vectors as (select vec_id as id, embedding::double[] as v, label::bigint as label from embeddings)"
SCD = "scd as (select event_id, user_id, event_type, value, ts as valid_from, lead(ts) over (partition by user_id, event_type order by ts, event_id) as valid_to from events)"
SCOPED = """scoped as (select o_orderkey as id, o_totalprice as price, o_orderstatus as kind, 'primary' as scope from orders
  union all select o_orderkey, o_totalprice * 2, o_orderstatus, 'branch:x' from orders where o_orderkey % 10 = 0
  union all select o_orderkey, null, 'tombstone', 'branch:x' from orders where o_orderkey % 10 = 1)"""
