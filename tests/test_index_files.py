"""Index files as a format: ranges of bytes, round trips, broken files."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans.shipping import ship
from graphloom.sources import index_files, scip


def docs(spark, n):
    o = lambda s, line, d: F.struct(s.alias("symbol"), F.lit(line).alias("line"), F.lit(line).alias("end_line"), F.lit(d).alias("definition"))
    name = F.concat(F.lit("scip ts npm app 1 a.ts/f"), F.col("id").cast("string"), F.lit("()."))
    return spark.range(n).select(F.concat(F.lit("src/"), F.col("id").cast("string")).alias("relative_path"), F.array(o(name, 1, True), o(name, 300, False)).alias("occurrences"))


def test_one_file_in_many_ranges(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(index_files.IndexSource)
    path = f"{tmp_path}/index"
    docs(spark, 500).coalesce(1).write.format("code_index").mode("append").save(path)
    whole = spark.read.format("code_index").load(path)
    parts = spark.read.format("code_index").option("rangeBytes", 1000).load(path)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() > 20
    want = sorted((f"src/{k}", f"scip ts npm app 1 a.ts/f{k}().", line, line, line == 1) for k in range(500) for line in (1, 300))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == want
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    assert sorted(map(tuple, scip.read_occurrences(content).collect())) == want


def test_empty_null_and_several_lines(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(index_files.IndexSource)
    path = f"{tmp_path}/index"
    rows = spark.createDataFrame([("a", None), (None, []), ("b", []), ("c", [("scip s", 2, 9, True)])], index_files.WRITTEN)
    rows.write.format("code_index").mode("append").save(path)
    assert [tuple(r) for r in spark.read.format("code_index").load(path).collect()] == [("c", "scip s", 2, 9, True)]


def test_a_file_cut_short_is_an_error(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(index_files.IndexSource)
    whole = index_files.document("a.ts", [{"symbol": "scip s", "line": 1, "end_line": 1, "definition": True}])
    (tmp_path / "x.scip").write_bytes(whole + whole[:-1])
    with pytest.raises(Exception, match="ends inside a message"):
        spark.read.format("code_index").load(str(tmp_path / "x.scip")).collect()


def test_a_task_writes_files_of_bounded_size(spark, tmp_path, monkeypatch):
    ship(spark)
    spark.dataSource.register(index_files.IndexSource)
    path = f"{tmp_path}/index"
    monkeypatch.setattr(index_files, "FILE", 4000)
    writer = index_files.IndexWriter({"path": path}, False)
    done = writer.write(docs(spark, 500).coalesce(1).toArrow().to_batches(max_chunksize=70))
    assert len(done.files) > 10 and all(x.name.startswith(".") for x in (tmp_path / "index").iterdir())
    writer.commit([done, None])
    sizes = [x.stat().st_size for x in (tmp_path / "index").iterdir()]
    assert max(sizes) < 4000 + 200
    got = spark.read.format("code_index").load(path)
    assert got.count() == 1000 and got.select("relative_path").distinct().count() == 500


def test_linked_occurrences_are_read_once(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    n = 20
    symbols = [(f"a{k}.ts", f"scip ts npm app 1 a{k}.ts/f{k}().", 1, 1, True) for k in range(n)] + [(f"a{k}.ts", f"scip ts npm app 1 a{k + 1}.ts/f{k + 1}().", 2, 2, False) for k in range(n - 1)]
    occ = spark.createDataFrame(symbols, scip.OCCURRENCES).mapInArrow(count, scip.OCCURRENCES)
    ents, edges = scip.linked(occ, "repo", ["app"])
    named = edges.join(ents.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(ents.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    assert sorted((r.a, r.b, r.kind) for r in named.collect()) == sorted((f"f{k}", f"f{k + 1}", "calls") for k in range(n - 1))
    assert counted.value == len(symbols)
