"""Time-based queries (as tables; the tests run the same operators as streams), and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutations as m
from ..operators import joins as j
from ..sources import projections as p
from ..streaming import operators as st
from .base import query

SESSIONS = """marked as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 3600 second then 0 else 1 end as new from events),
grouped as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from marked)"""


@query("ST1_debounce", "select user_id, min(ts) as first_at, max(ts) + interval 3600 second as fires_at, count(*) as signals, max_by(event_id, ts) as event_id from grouped group by user_id, s", SESSIONS)
def debounce(spark, d):
    return st.debounce(p.table(spark, d, "events"), ["user_id"], "ts", ["event_id"], "3600 seconds", "event_id")


def limiter(condition: str, seconds: int) -> tuple[str, str]:
    """The fixed-window limiter as a walk over each user's events in order."""
    numbered = f"numbered as (select user_id, event_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events where {condition})"
    return numbered, f"""walk(user_id, event_id, t, k, opened, number) as (select user_id, event_id, t, k, t, 1 from numbered where k = 1
  union all select n.user_id, n.event_id, n.t, n.k, case when n.t - w.opened >= {seconds} then n.t else w.opened end, case when n.t - w.opened >= {seconds} then 1 else w.number + 1 end
  from walk w join numbered n on n.user_id = w.user_id and n.k = w.k + 1)"""


@query("ST4_fixed_window_limit", "select user_id, event_id, number, number <= 2 as allowed from walk", *limiter("true", 36_000))
def fixed(spark, d):
    return st.fixed_window_table(p.table(spark, d, "events"), ["user_id"], "ts", "event_id", 2, 36_000)


@query("ST5_sliding_limit", "select event_id, count(*) over w as requests, round(sum(value) over w, 6) as used from events window w as (partition by user_id order by ts range between interval 6 hour preceding and current row)")
def sliding(spark, d):
    x = st.sliding_usage(p.table(spark, d, "events"), ["user_id"], "ts", "value", 6 * 3600)
    return x.select("event_id", "requests", F.round("used", 6).alias("used"))


@query("ST6_circuit_breaker", "select user_id, event_id, number, floor(t + 300)::bigint as open_until from walk where number > 1", *limiter("event_type = 'error'", 86_400))
def breaker(spark, d):
    return st.breaker(p.table(spark, d, "events").where("event_type = 'error'"), ["user_id"], "ts", "event_id", 1, 86_400, 300)


@query("ST7_ttl", "select event_id from events where ts >= (select max(ts) from events) - interval 5 day")
def ttl(spark, d):
    e = p.table(spark, d, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return st.alive(e.join(now, how="left"), "ts", F.col("now"), "5 days").select("event_id")


@query("ST8_first_seen", "select distinct user_id, event_type from events")
def seen(spark, d):
    return st.first_seen(p.table(spark, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("ST9_change_feed", "select event_id from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is null or b is distinct from event_type")
def feed(spark, d):
    return st.changes(p.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id")


@query("ST11_timeline", "select event_id, ts, event_type from events where user_id = 3 order by ts desc, event_id limit 50")
def timeline(spark, d):
    return p.table(spark, d, "events").where("user_id = 3").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "event_type")


@query("ST12_window_counts", "select event_type, time_bucket(interval 1 day, ts) as start, count(*) as n from events group by 1, 2")
def window_counts(spark, d):
    return st.rolling_counts(p.table(spark, d, "events"), ["event_type"], "ts", "1 day")


OLD = "old as (select o_orderkey as id, o_totalprice as price, o_orderstatus as s from orders where o_orderkey % 3 <> 0)"
NEW = "new as (select o_orderkey as id, o_totalprice + 1 as price, null::varchar as s from orders where o_orderkey % 5 = 0)"


def old_new(spark, d):
    o = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("s"))
    return o.where("id % 3 <> 0"), o.where("id % 5 = 0").select("id", (F.col("price") + 1).alias("price"), F.lit(None).cast("string").alias("s"))


@query("K1_upsert_entities", "select coalesce(n.id, o.id) as id, coalesce(n.price, o.price) as price, coalesce(n.s, o.s) as s from old o full join new n on n.id = o.id", OLD, NEW)
def upsert(spark, d):
    return m.upsert(*old_new(spark, d), ["id"])


@query("K2_upsert_edges", "select distinct src, dst, kind from edges", p.EDGES)
def upsert_edges(spark, d):
    e = p.edges(spark, d)
    return m.upsert(e.where("src % 2 = 0"), e.where("src % 3 <> 1 or src % 2 = 1"), ["src", "dst", "kind"])


@query("K4_prewrite", "select left(sha256('repo' || chr(0) || 'src/' || p_brand || chr(0) || 'file' || chr(0) || p_brand || chr(0) || ''), 16) as id, p_brand as name, count(*) as members from part group by p_brand")
def prewrite(spark, d):
    return m.file_entities(p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), "p_brand").alias("file_path")), "repo").select("id", "name", "members")


@query("K5_scd2_close_insert", """select entity, value, valid_from, valid_to from (select o_custkey % 200 as entity, max(o_totalprice) as value, timestamp '2024-01-01' as valid_from, case when o_custkey % 200 % 2 = 0 then timestamp '2024-06-01' end as valid_to from orders group by 1, 4)
  union all select distinct o_custkey % 200, 1.0, timestamp '2024-06-01', null from orders where o_custkey % 200 % 2 = 0""")
def scd2(spark, d):
    o = p.table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("entity")).agg(F.max("o_totalprice").alias("value"))
    facts = o.select("entity", "value", F.lit("2024-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    fresh = o.where("entity % 2 = 0").select("entity", F.lit(1.0).alias("value"))
    return m.close_and_insert(facts, fresh, "entity", F.lit("2024-06-01").cast("timestamp"))


@query("K6_branch_delta", """select id, price, kind, scope from scoped where scope = 'primary' union all select o_orderkey, o_totalprice * 2, o_orderstatus, 'branch:x' from orders where o_orderkey % 20 = 0
  union all select o_orderkey, null, 'tombstone', 'branch:x' from orders where o_orderkey % 20 = 1""", p.SCOPED)
def branch_delta(spark, d):
    o = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("kind"))
    return m.apply_branch(p.scoped(spark, d), "branch:x", o.where("id % 20 = 0").withColumn("price", F.col("price") * 2), o.where("id % 20 = 1").select("id")).select("id", "price", "kind", "scope")


@query("K7_delete_keys", "select id, name from entities where id % 4 <> 0", p.ENTITIES)
def delete_keys(spark, d):
    e = p.entities(spark, d)
    return m.delete(e, e.where("id % 4 = 0").select("id"), ["id"]).select("id", "name")


@query("K8_replace_edges", "select src, dst, kind from edges where src % 25 <> 0 union select src, src + 1, 'calls' from edges where src % 25 = 0", p.EDGES)
def replace_edges(spark, d):
    e = p.edges(spark, d)
    mine = e.where("src % 25 = 0").select("src").distinct()
    return m.replace_edges(e, mine, mine.select("src", (F.col("src") + 1).alias("dst"), F.lit("calls").alias("kind")))


@query("K9_ledger_transitions", "select event_id, event_type in ('view', 'signup') as allowed from events")
def transitions(spark, d):
    s = F.col("event_type")
    old = F.when(s == "view", "pending").when(s == "signup", "working").otherwise("committed")
    return p.table(spark, d, "events").select("event_id", m.may_become(old, F.when(s == "view", "working").otherwise("committed")).alias("allowed"))


@query("K10_vector_upsert", "select vec_id % 50 as key, max(vec_id) as last from embeddings group by 1")
def vector_upsert(spark, d):
    v = p.table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("key"), F.col("vec_id").alias("ordinal"))
    return m.last_wins(v, ["key"], "ordinal").select("key", F.col("ordinal").alias("last"))


@query("K11_orphan_vectors", "select id from vectors where id not in (select doc_id from documents where doc_id % 2 = 0)", p.VECTORS)
def orphans(spark, d):
    docs = p.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return m.delete(p.vectors(spark, d), docs, ["id"]).select("id")


@query("K16_compaction", "select doc_id as id, array_to_string(string_split(text, chr(10))[1:5], chr(10)) || case when len(string_split(text, chr(10))) > 5 then chr(10) || '… ' || (len(string_split(text, chr(10))) - 5) || ' more lines' else '' end as body from documents")
def compaction(spark, d):
    return p.table(spark, d, "documents").select(F.col("doc_id").alias("id"), m.compact_body(F.col("text"), 5).alias("body"))


@query("K17_purge_expired", "select event_id from events where ts >= timestamp '2024-01-15' and event_type not like 'sign%'")
def purge(spark, d):
    return m.purge(p.table(spark, d, "events"), "ts", F.lit("2024-01-15").cast("timestamp"), "event_type", "sign").select("event_id")


@query("K18_evict", "select o_orderkey as id from orders qualify o_orderdate >= timestamp '1998-01-01' or row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1")
def evict(spark, d):
    o = p.table(spark, d, "orders")
    return m.keep_recent(o, ["o_custkey"], "o_orderdate", "o_orderkey", F.lit("1998-01-01").cast("timestamp")).select(F.col("o_orderkey").alias("id"))


@query("K20_line_shift", "select p_partkey as id, p_partkey % 97 + 1 + case when p_partkey % 97 + 1 > 10 then 3 else 0 end + case when p_partkey % 97 + 1 > 50 then 5 else 0 end as start_line from part")
def line_shift(spark, d):
    e = p.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97 + 1).alias("start_line"))
    return m.shift_lines(e, [(10, 3), (50, 5)])
