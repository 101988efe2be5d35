"""Code-intelligence indexes as a source and sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import index_files, scip
from ..sources import projections as p
from .base import query
from .lineage import shared_dir


def write_index(spark, d) -> str:
    """An index of all parts in the shared folder: each part's file defines it on line 1 and refers on line 2 to what its edges lead to."""
    spark.dataSource.register(index_files.IndexSource)
    path = f"{shared_dir(spark)}/graphloom/index-{uuid.uuid4().hex}"
    name = lambda c: F.concat(F.lit("scip ts npm app 1 "), F.col(c).cast("string"), F.lit(".ts/p"), F.col(c).cast("string"), F.when(F.col(c) % 2 == 0, "().").otherwise("#"))
    at = lambda c, line, defined: F.struct(name(c).alias("symbol"), F.lit(line).alias("line"), F.lit(line).alias("end_line"), F.lit(defined).alias("definition"))
    found = p.entities(spark, d).select("id", at("id", 1, True).alias("o")).unionAll(p.edges(spark, d).select(F.col("src").alias("id"), at("dst", 2, False)))
    docs = found.groupBy("id").agg(F.collect_list("o").alias("occurrences"))
    docs.select(F.concat(F.lit("src/"), F.col("id").cast("string"), F.lit(".ts")).alias("relative_path"), "occurrences").write.format("code_index").mode("append").save(path)
    return path


@query("S6_index_edges", """select distinct 'p' || src as src, 'p' || dst as dst, case when dst % 2 = 0 then 'calls' else 'references' end as kind from edges
  where src in (select id from entities) and dst in (select id from entities)""", p.ENTITIES, p.EDGES)
def index_edges(spark, d):
    """Edges read back out of index files that were written from all entities and edges."""
    occ = spark.read.format("code_index").option("rangeBytes", 1 << 20).load(write_index(spark, d))
    ents, edges = scip.linked(occ, "repo", ["app"])
    n = lambda side: ents.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    return edges.join(n("src"), "src").join(n("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "kind")
