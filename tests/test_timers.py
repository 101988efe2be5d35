"""Streams with timers against the same operators over tables."""

import json

from pyspark.sql import functions as F

from graphloom.plans.shipping import ship
from graphloom.streaming import operators as st
from graphloom.streaming import timers
from tests.test_streams import SF


def test_breaker_stream_gives_the_table_s_rows(spark, tmp_path):
    ship(spark)
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type = 'error'")
    rows = e.orderBy("ts").toPandas()
    size = -(-len(rows) // 3)
    for k in range(3):
        spark.createDataFrame(rows.iloc[k * size : (k + 1) * size], e.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    try:
        s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
        q = timers.breaker_stream(s, "user_id", "ts", "event_id", 1, 86_400, 300).writeStream.format("memory").queryName("broken").outputMode("append").start()
        q.processAllAvailable()
        states = [json.loads(o.json) for p in q.recentProgress for o in p.stateOperators]
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r.user_id, r.event_id, r.number, r.open_until) for r in spark.table("broken").collect())
    want = sorted((r.user_id, r.event_id, r.number, r.open_until) for r in st.breaker(e, ["user_id"], "ts", "event_id", 1, 86_400, 300).collect())
    assert got == want and want
    held = [o["numRowsTotal"] for o in states]
    assert len(held) >= 3 and held[-1] < max(held), held  # timers remove state without a new event of its key
