"""The time-based operators as streams, against the same operators over tables."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from graphloom.streaming import operators as st

SF = "/root/testdata/sf0.001"


def folder(spark, tmp_path, parts=3):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.orderBy("ts").toPandas()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows.iloc[k * size : (k + 1) * size], e.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return e


def collect(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_debounce_stream(spark, tmp_path):
    e = folder(spark, tmp_path)
    s = st.event_stream(spark, f"{tmp_path}/in", e.schema, "1 second")
    got = {tuple(r) for r in collect(spark, st.debounce(s, ["user_id"], "ts", ["event_id"], "3600 seconds", "event_id"), "deb").collect()}
    want = {tuple(r) for r in st.debounce(e, ["user_id"], "ts", ["event_id"], "3600 seconds", "event_id").collect()}
    assert got <= want and len(want) - len(got) <= 200 and got


def brute_limiter(rows, seconds):
    out, state = {}, {}
    for t, i, u in sorted(rows):
        o, n = state.get(u, (None, 0))
        if o is None or t - o >= seconds:
            o, n = t, 0
        state[u] = (o, n + 1)
        out[i] = n + 1
    return out


def test_limiter_table_and_stream(spark, tmp_path):
    e = folder(spark, tmp_path)
    rows = [(r.ts.timestamp(), r.event_id, r.user_id) for r in e.collect()]
    want = brute_limiter(rows, 36_000)
    table = {r.event_id: r.number for r in st.fixed_window_table(e, ["user_id"], "ts", "event_id", 2, 36_000).collect()}
    assert table == want
    s = st.event_stream(spark, f"{tmp_path}/in", e.schema, "0 seconds")
    got = collect(spark, st.fixed_window_stream(s, "user_id", "ts", "event_id", 2, 36_000), "lim")
    assert {r.event_id: r.number for r in got.collect()} == want


def test_breaker(spark):
    rows = [(datetime(2024, 1, 1, 0, k), k, 1) for k in range(8)]
    e = spark.createDataFrame(rows, "ts timestamp, id long, k long")
    got = st.breaker(e, ["k"], "ts", "id", 4, 600, 300).orderBy("id").collect()
    assert [(r.id, r.number) for r in got] == [(4, 5), (5, 6), (6, 7), (7, 8)] and got[0].open_until == int(rows[4][0].timestamp()) + 300


def test_first_seen_stream(spark, tmp_path):
    e = folder(spark, tmp_path)
    s = st.event_stream(spark, f"{tmp_path}/in", e.schema, "60 days")
    assert sorted(r.user_id for r in collect(spark, st.first_seen(s, "user_id"), "seen").collect()) == sorted(r.user_id for r in e.select("user_id").distinct().collect())


def test_window_counts_stream(spark, tmp_path):
    e = folder(spark, tmp_path)
    s = st.event_stream(spark, f"{tmp_path}/in", e.schema, "1 second")
    got = collect(spark, st.rolling_counts(s, ["event_type"], "ts", "1 day"), "wins", "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in st.rolling_counts(e, ["event_type"], "ts", "1 day").collect()}


def test_incremental_index(spark, tmp_path):
    schema = "file_path string, id long, body string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: st.run_to_end(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), st.incremental_index(f"{tmp_path}/store", schema, buckets=8), f"{tmp_path}/ck")
    now = lambda name="store": sorted((tuple(r) for r in st.IndexStore(spark, f"{tmp_path}/{name}", schema, 8).read().collect()), key=str)
    assert now() == []
    put([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("c", 4, "w")])
    run()
    put([("a", 1, "new")])
    run()
    assert now() == [("a", 1, "new"), ("b", 3, "z"), ("c", 4, "w")]
    put([("b", None, None), ("c", 5, None)])  # b was deleted; a row with any value is a row
    run()
    assert now() == [("a", 1, "new"), ("c", 5, None)]
    # The same as the whole table with the changes applied, batch by batch.
    table = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("c", 4, "w")], schema)
    for rows, files in (([("a", 1, "new")], "a"), ([("c", 5, None)], "bc")):
        table = st.changed_files(table, spark.createDataFrame(rows, schema), spark.createDataFrame([(f,) for f in files], "file_path string"))
    assert now() == sorted((tuple(r) for r in table.collect()), key=str)


def test_incremental_index_writes_touched_buckets_only(spark, tmp_path):
    schema = "file_path string, id long"
    store = st.IndexStore(spark, f"{tmp_path}/s", schema, 16)
    rows = [(f"f{i}", i) for i in range(200)]
    assert len(store.apply(spark.createDataFrame(rows, schema), 0)) == 16
    for n in range(1, 5):
        assert len(store.apply(spark.createDataFrame([("f7", n)], schema), n)) == 1
    assert sorted(tuple(r) for r in store.read().collect()) == sorted([*((f, i) for f, i in rows if f != "f7"), ("f7", 4)])
    assert store.batches() == [3, 4] and store.apply(spark.createDataFrame([("f8", 9)], schema), 4) == []
    folders = {v: [b for b in os.listdir(f"{tmp_path}/s/{v}") if b.startswith("bucket=")] for v in os.listdir(f"{tmp_path}/s") if v.startswith("v=")}
    assert set(folders) == {"v=0", "v=3", "v=4"} and len(folders["v=0"]) == 15  # no other version stays
    gone = spark.createDataFrame([(f"f{i}", None) for i in range(200)], schema)
    store.apply(gone, 5)
    assert store.read().count() == 0


def test_incremental_index_full_scans(spark, tmp_path):
    schema = "file_path string, id long"
    read = lambda: {tuple(r) for r in st.IndexStore(spark, f"{tmp_path}/big", schema).read().collect()}
    many = spark.createDataFrame([(f"new{i}", i) for i in range(5)] + [("a", 1)], schema)
    st.incremental_index(f"{tmp_path}/big", schema, full_above=3)(spark.createDataFrame([("a", 0), ("b", 3)], schema), 0)
    st.incremental_index(f"{tmp_path}/big", schema, full_above=3)(many, 1)  # many changed files and no full scan: nothing else is lost
    assert read() == {tuple(r) for r in many.collect()} | {("b", 3)}
    st.incremental_index(f"{tmp_path}/big", schema, lambda s: s.createDataFrame([("w", 7)], schema), full_above=3)(many, 2)
    assert read() == {("w", 7)}


def test_first_seen_of_a_table_is_the_earliest(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 2, "w")], "k string, at int, v string").repartition(3)
    assert sorted(tuple(r) for r in st.first_seen(rows, "k", ["at"]).collect()) == [("a", 1, "y"), ("b", 2, "w")]
