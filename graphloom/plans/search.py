"""Search and vector queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import neighbours
from ..operators import search as se
from ..operators import texts
from ..operators import windows as w
from ..operators.context import rank_rules
from ..sources import projections as p
from .base import query

STOPS = ", ".join(f"'{x}'" for x in s.STOP_WORDS)
COS = "vectors_n as (select id, v, label, sqrt(list_dot_product(v, v)) as nv from vectors)"
EVERY = "id % 100 = 0"


def near_sql(k: int, extra: str = "", keep_self: bool = True) -> str:
    me = "" if keep_self else " and b.id <> q.id"
    return f"""select q_id, id, rank, round(score, 6) as score from (select q.id as q_id, b.id, list_dot_product(q.v, b.v) / (q.nv * b.nv) as score,
  row_number() over (partition by q.id order by list_dot_product(q.v, b.v) / (q.nv * b.nv) desc, b.id) as rank from vectors_n q, vectors_n b where q.{EVERY}{me}{extra}) where rank <= {k}"""


@query("V1_cosine_topk", near_sql(20), p.VECTORS, COS)
def cosine_topk(spark, d):
    v = p.vectors(spark, d)
    q = v.where(EVERY).select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    return se.cosine_top(v, q, 20).select("q_id", "id", "rank", F.round("score", 6).alias("score"))


@query("V2_filtered_topk", near_sql(15, " and b.label = 3"), p.VECTORS, COS)
def filtered_topk(spark, d):
    v = p.vectors(spark, d)
    q = v.where(EVERY).select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    return se.cosine_top(v.where("label = 3"), q, 15).select("q_id", "id", "rank", F.round("score", 6).alias("score"))


@query("V4_cosine", "select id, round(list_dot_product(v, (select v from vectors where id = 1)) / (nv * (select nv from vectors_n where id = 1)), 6) as similarity from vectors_n", p.VECTORS, COS)
def cosine(spark, d):
    v = p.vectors(spark, d)
    one = F.broadcast(v.where("id = 1").select(F.col("v").alias("q")))
    return v.join(one, how="inner").select("id", F.round(s.cosine(F.col("v"), F.col("q")), 6).alias("similarity"))


@query("V5_find_similar", near_sql(10, keep_self=False), p.VECTORS, COS)
def find_similar(spark, d):
    v = p.vectors(spark, d)
    q = v.where(EVERY).select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    x = se.cosine_top(v, q, 11).where("id <> q_id")
    rank = F.row_number().over(W.partitionBy("q_id").orderBy("rank"))
    return x.withColumn("rank", rank).where("rank <= 10").select("q_id", "id", "rank", F.round("score", 6).alias("score"))


@query("V3_neighbour_graph")
def neighbour_graph(spark, d):
    """Neighbours through a graph of every row; recall and the share of rows met are measured in the tests."""
    v = p.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where(EVERY).select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    found, _ = neighbours.graph_search(neighbours.neighbour_graph(v), v, q, 10)
    return found.select("q_id", "id", "rank", F.round("score", 6).alias("score"))


@query("V3_quantised_index")
def quantised(spark, d):
    """Neighbours through the index over every row; recall is measured in the tests."""
    v = p.vectors(spark, d)
    q = v.where(EVERY).select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    return se.quantised_top(se.quantised(v), v, q, 10).select("q_id", "id", "rank", F.round("score", 6).alias("score"))


@query("V6_keyword_search", "select id, name, round(3.0 / length(name), 6) as score from entities where contains(lower(name), '#12') or contains(lower(signature), '#12') order by score desc, id limit 20", p.ENTITIES)
def keyword(spark, d):
    return se.keyword_search(p.entities(spark, d), "#12", 20).select("id", "name", F.round("score", 6).alias("score"))


TOKENS = "tokens as (select distinct p_partkey as id, unnest(string_split(lower(p_type), ' ')) as token from part)"


@query("V7_token_search", "select id, count(*) as score from tokens where token in ('promo', 'steel', 'small') group by id order by score desc, id limit 30", TOKENS)
def tokens(spark, d):
    part = p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.initcap("p_type").alias("name"))
    return se.token_search(se.token_index(part), "the promo of steel small", 30)


@query("V8_query_tokens", "select conv_id, turn, len([x for x in string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' ') if length(x) > 1 and x not in (" + STOPS + ")]) as n from conversations")
def query_tokens(spark, d):
    return p.table(spark, d, "conversations").select("conv_id", "turn", F.size(s.query_tokens(F.lower("text"))).alias("n"))


LEGS = """legs as (select 'sem' as leg, id, rank - 1 as rank, 0.7 as weight from (select b.id, row_number() over (order by list_dot_product(q.v, b.v) / (q.nv * b.nv) desc, b.id) as rank from vectors_n q, vectors_n b where q.id = 0) where rank <= 20
  union all select 'key', id, rank - 1, 1.0 from (select id, row_number() over (order by score desc, id) as rank from (select id, 2.0 / length(name) as score from entities where contains(name, '#1'))) where rank <= 20
  union all select 'just', id, rank - 1, 0.5 from (select b.id, row_number() over (order by list_dot_product(q.v, b.v) / (q.nv * b.nv) desc, b.id) as rank from vectors_n q, vectors_n b where q.id = 0 and b.label < 5) where rank <= 15),
tops as (select leg, list(id) as ids from legs where rank < 10 group by leg),
adaptive as (select floor(30 * greatest(0.5, least(2.0, 2.0 - 1.5 * avg(len(list_intersect(a.ids, b.ids))::double / len(list_distinct(list_concat(a.ids, b.ids)))))) + 0.5)::bigint as k from tops a, tops b where a.leg < b.leg)"""


def legs(spark, d):
    v = p.vectors(spark, d)
    q = v.where("id = 0").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    leg = lambda df, name, wt: df.select(F.lit(name).alias("leg"), "id", (F.col("rank") - 1).alias("rank"), F.lit(wt).alias("weight"))
    key = se.keyword_search(p.entities(spark, d), "#1", 20).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # 20 rows
    return leg(se.cosine_top(v, q, 20), "sem", 0.7).unionAll(leg(key, "key", 1.0)).unionAll(leg(se.cosine_top(v.where("label < 5"), q, 15), "just", 0.5))


@query("V9_adaptive_k", "select k from adaptive", p.ENTITIES, p.VECTORS, COS, LEGS)
def adaptive_k(spark, d):
    return se.adaptive_k(legs(spark, d))


@query("V10_rank_fusion", "select id, round(score, 6) as score from (select l.id, e.name, sum(weight / (k + rank + 1)) as score from legs l, adaptive join entities e on e.id = l.id group by l.id, e.name) order by score desc, name, id limit 10", p.ENTITIES, p.VECTORS, COS, LEGS)
def fusion(spark, d):
    x = legs(spark, d)
    return se.fuse(x, p.entities(spark, d).select("id", "name"), se.adaptive_k(x), ["1"], 10).select("id", F.round("score", 6).alias("score"))


@query("V11_hybrid_search", """select f.id, round(f.score, 6) as score, coalesce(c.callers, '') as callers from (select l.id, e.name, sum(weight / (k + rank + 1)) as score from legs l, adaptive join entities e on e.id = l.id group by l.id, e.name order by score desc, e.name, l.id limit 30) f
  left join (select dst, string_agg(src::varchar, ',' order by src) as callers from (select *, row_number() over (partition by dst order by src) as rn from edges where kind = 'calls') where rn <= 5 group by dst) c on c.dst = f.id""", p.ENTITIES, p.EDGES, p.VECTORS, COS, LEGS)
def hybrid(spark, d):
    x = legs(spark, d)
    top = se.fuse(x, p.entities(spark, d).select("id", "name"), se.adaptive_k(x), ["1"], 30)
    calls = p.edges(spark, d).where("kind = 'calls'").join(F.broadcast(top.select(F.col("id").alias("dst"))), "dst")  # 30 rows
    callers = w.first_per_group(calls, ["dst"], ["src"], 5).groupBy(F.col("dst").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda v: v.cast("string")), ",").alias("callers"))
    return top.join(callers, "id", "left").select("id", F.round("score", 6).alias("score"), F.coalesce("callers", F.lit("")).alias("callers"))


@query("V12_variants", "select p_partkey % 100 as key, count(*) as n from part group by 1")
def variants(spark, d):
    k = F.concat((F.col("p_partkey") % 100).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "::code").otherwise(""))
    return p.table(spark, d, "part").groupBy(texts.plain_key(k).cast("long").alias("key")).agg(F.count("*").alias("n"))


@query("V14_context", """select s.id, s.depth, round(least(count(x.a) / (2.0 * ((select count(*) from entities) - 1)), 1.0), 9) as centrality from
  (select id, min(depth) as depth from (select 100 as id, 0 as depth union all select src, 1 from edges where dst = 100 and kind <> 'references' union all select dst, 1 from edges where src = 100 and kind <> 'references'
     union all select src, 1 from edges where dst = 100 and kind = 'references' union all select dst, 1 from edges where src = 100 and kind = 'references') group by id) s
  left join (select src as a from edges union all select dst from edges) x on x.a = s.id group by s.id, s.depth order by centrality desc, s.id limit 5""", p.ENTITIES, p.EDGES)
def context(spark, d):
    from ..operators import graph as g

    e, v = p.edges(spark, d), p.entities(spark, d)
    found = g.subgraph(e, v.where("id = 100").select("id"), 1)[0]
    return found.join(g.centrality(e, v), "id").orderBy(F.desc("centrality"), "id").limit(5).select("id", "depth", F.round("centrality", 9).alias("centrality"))


@query("V15_embedding_text", """select e.id::varchar || case v when 'code' then '::code' else '' end as key, v as variant, upper(kind[1]) || kind[2:] || ': ' || name || chr(10) || 'File: ' || file_path || chr(10)
  || case kind when 'interface' then 'Contract: ' else 'Signature: ' end || signature || case when v = 'semantic' and j.entity_id is not null then chr(10) || 'Domain: ' || array_to_string(domain_concepts, ', ') || coalesce(chr(10) || 'Feature: ' || feature_tag, '') else '' end as text
  from entities e cross join (values ('semantic'), ('code')) t(v) left join justifications j on j.entity_id = e.id""", p.ENTITIES, p.JUSTIFICATIONS)
def embedding_text(spark, d):
    return texts.embedding_texts(p.entities(spark, d), p.justifications(spark, d)).select("key", "variant", "text")


@query("V16_hash_embedding")
def hash_embedding(spark, d):
    from ..functions.providers import embed

    return embed(p.entities(spark, d).select("id", F.col("name").alias("text")), "text")


@query("V17_rule_similarity", "select a.id as a, b.id as b from vectors_n a, vectors_n b where a.id % 100 = 0 and b.id <> a.id and list_dot_product(a.v, b.v) / (a.nv * b.nv) > 0.75", p.VECTORS, COS)
def rule_similarity(spark, d):
    v = p.vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    return se.cosine_above(v, q, 0.75).where("q_id <> id").select(F.col("q_id").alias("a"), F.col("id").alias("b"))


@query("V18_drift_class", """select a.id, round(case when a.id % 5 = 0 then 1.0 else list_dot_product(a.v, b.v) / (a.nv * b.nv) end, 6) as similarity, case when a.id % 5 = 0 then 'stable' when list_dot_product(a.v, b.v) / (a.nv * b.nv) > 0.95 then 'cosmetic'
  when list_dot_product(a.v, b.v) / (a.nv * b.nv) > 0.8 then 'refactor' else 'intent_drift' end as drift from vectors_n a join vectors_n b on b.id = a.id + 10""", p.VECTORS, COS)
def drift(spark, d):
    v = p.vectors(spark, d)
    old = v.select("id", F.col("v").alias("old_v"), F.lit("h").alias("old_hash"))
    new = v.select((F.col("id") - 10).alias("id"), F.col("v").alias("new_v"))
    x = old.join(new, "id").withColumn("new_hash", F.when(F.col("id") % 5 == 0, "h").otherwise("g"))
    return se.drift(x).select("id", F.round("similarity", 6).alias("similarity"), "drift")


@query("V19_rule_ranking", """select p_partkey as rule, p_size % 10 + 5 * (select count(*) from entities e where e.id in (select dst from edges where src = 100) and e.kind = case p_partkey % 5 when 0 then 'function' when 1 then 'method' when 2 then 'class' when 3 then 'interface' else 'variable' end)
  + case when p_brand = 'Brand#11' then 20 else 0 end as score from part order by score desc, rule limit 10""", p.ENTITIES, p.EDGES)
def rule_ranking(spark, d):
    near = p.edges(spark, d).where("src = 100").select(F.col("dst").alias("id")).join(p.entities(spark, d), "id")
    kind = F.get(F.array(*map(F.lit, p.KINDS)), (F.col("p_partkey") % 5).cast("int"))
    rules = p.table(spark, d, "part").select(F.col("p_partkey").alias("rule"), (F.col("p_size") % 10).alias("priority"), F.array(kind).alias("kinds"), (F.col("p_brand") == "Brand#11").alias("fits_file"))
    return rank_rules(rules, near).select("rule", "score")