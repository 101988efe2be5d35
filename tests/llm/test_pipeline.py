import corpus_pipeline as cp
from graphloom.llm import queries, quality
from tests.llm import data
from tests.llm.test_corpus import brute_copies
from tests.llm.test_mixing import brute_targets, nearest
from tests.llm.test_pii import brute_value  # noqa: F401  (the stage's own test holds values)


def test_stages_in_turn(spark, tmp_path):
    data.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "near_dedup", "pii_pseudonyms", "mix_to_weights", "best_fit_packing"]
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{k}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    before, after = seen["quality_rules"]
    kept = {r.id for r in quality.judge(data.frame(spark)).collect() if r.kept}
    assert {r.doc_id for r in after} == kept and len(after) < len(before)
    before, after = seen["near_dedup"]
    want = {c for _, c in brute_copies([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(want) and len(after) < len(before)
    before, after = seen["pii_pseudonyms"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    before, after = seen["mix_to_weights"]
    sizes, taken = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(data.words_of(r.text))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(data.words_of(r.text))
    want = brute_targets(sizes)
    for k in want:
        assert abs(taken.get(k, 0) - want[k]) <= nearest([len(data.words_of(r.text)) for r in before if r.source == k], want[k]) + 1
    before, after = seen["best_fit_packing"]
    per = {}
    for r in after:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + r.length
    assert max(per.values()) <= 2048 and sum(1 for r in after if r.piece == 0) == len(before)
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after)


def test_entry_registers(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and all(any(x.startswith(f"op{n}_") for x in q) for n in range(1, 11))
    assert queries.tokenizer_path()


def test_sql_beside_queries(spark):
    from graphloom.llm import registry
    from tests.oracle import difference

    sf = "/root/testdata/sf0.001"
    for name, sql in registry.oracle_sql().items():
        assert difference(registry.queries()[name](spark, sf), sql, sf) is None, name
