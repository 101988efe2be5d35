"""Order-dependent clusters and substring postings as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change, clusters, joins, postings
from ..sources import projections as p
from .base import query

TAGS = """tags as (select name, count(*) as n, min(p_partkey) as id from (select p_partkey, lower(split_part(p_name, ' ', 1) || '_' || split_part(p_type, ' ', 1)) as name from part) group by name),
near as (select x.id as a, y.id as b from tags x join tags y on x.id < y.id and 1 - levenshtein(x.name, y.name)::double / greatest(length(x.name), length(y.name)) >= 0.75)"""


def tags(spark, d):
    """(name, n, id): tags in the order in which they come first."""
    part = p.table(spark, d, "part")
    word = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    return part.groupBy(F.lower(F.concat_ws("_", word("p_name"), word("p_type"))).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("id"))


@query("J27_tag_clusters", """select c.name as tag, b.canonical from (select l.*, t.name, t.n from labelled l join tags t using (id)) c
  join (select seed, arg_min(name, (-n, name)) as canonical from labelled join tags using (id) group by seed) b using (seed)""",
  TAGS, "reached as (select id, id as root from tags union select r.id, near.a from reached r join near on near.b = r.root)", "labelled as (select id, min(root) as seed from reached group by id)")
def tag_clusters(spark, d):
    """Each tag under the most frequent one of the cluster that the first tags open."""
    t = tags(spark, d)
    near = change.similar_pairs(t, "name", 0.75)
    at = lambda side: t.select(F.col("name").alias(side), F.col("id").alias(f"{side}_id"))
    ends = near.join(at("a"), "a").join(at("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return clusters.named(clusters.chain_clusters(t, ends), t).withColumnRenamed("name", "tag")


@query("J27_feature_areas", """select name as tag, canonical from (select m.*, f.name, f.n from member m join features f using (id)) join
  (select seed, arg_min(name, (-n, name)) as canonical from member join features using (id) group by seed) using (seed)""",
  """features as (select l_partkey as id, 'feature' || l_partkey as name, count(distinct l_orderkey) as n from lineitem group by l_partkey), concepts as (select distinct l_partkey as id, l_orderkey as c from lineitem),
  near as (select x.id as a, y.id as b from concepts x join concepts y on x.c = y.c and x.id < y.id group by all having count(*) >= 2),
  ordered as (select id, row_number() over (order by id) as i, coalesce(list(a), []) as earlier from features left join near on b = id group by id),
  walk as (select 0::bigint as i, []::bigint[] as seeds union all select w.i + 1, case when list_has_any(o.earlier, w.seeds) then w.seeds else list_append(w.seeds, o.id) end from walk w join ordered o on o.i = w.i + 1),
  last as (select unnest(seeds) as s from walk where i = (select max(i) from ordered)),
  member as (select id, coalesce((select min(a) from near join last on s = a where b = o.id), id) as seed from ordered o)""")  # fmt: skip
def feature_areas(spark, d):
    """Features that share two concepts or more with the feature that opens an area, under the most frequent one."""
    li = p.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("concept"))
    names = li.groupBy("id").agg(F.concat(F.lit("feature"), F.col("id").cast("string")).alias("name"), F.count_distinct("concept").alias("n"))
    near = joins.co_occurrence(li, "concept", "id", 2).select("a", "b")
    return clusters.named(clusters.star_clusters(names, near), names).withColumnRenamed("name", "tag")


@query("F6_trigram_search", """select query_id, id from (select p_partkey as query_id, lower(substr(p_name, 2, 7)) as q from part where p_partkey % 100 = 0)
  join (select p_partkey as id, lower(p_name) as name, lower(p_type || ' ' || p_brand) as signature from part) on contains(name, q) or contains(signature, q)""")
def trigram_search(spark, d):
    """The middle of the name of every hundredth part, looked up in all names and signatures at once."""
    part = p.table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("signature"))
    asked = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.substring("p_name", 2, 7).alias("query"))
    return postings.Postings(rows, "id", ["name", "signature"], copies=True).search(asked)


@query("V6_indexed_keyword", "select doc_id from documents where contains(lower(text), 'ing the ')")
def indexed_keyword(spark, d):
    """Whole documents that hold a phrase, by the postings of its trigrams."""
    docs = p.table(spark, d, "documents").select("doc_id", "text")
    return postings.Postings(docs, "doc_id", ["text"]).find("ing the ").select(F.col("id").alias("doc_id"))
