"""Reports, health, context and texts on small inputs worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import change as c
from graphloom.operators import context as x
from graphloom.operators import health as he
from graphloom.operators import reports as rp
from graphloom.operators import review as r
from graphloom.operators import texts as t
from graphloom.streaming import steps

JUST = "entity_id long, taxonomy string, confidence double, feature_tag string, architectural_pattern string, domain_concepts array<string>"


def just(spark, rows):
    return spark.createDataFrame([(*a, *[None] * (6 - len(a))) for a in rows], JUST)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, "calls") for a, b in rows], "src long, dst long, kind string")


def ents(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, kind string, name string")


def test_entry_points(spark):
    """Called from outside or by nothing; files, unknown entities and callers of unknown feature are told apart."""
    j = just(spark, [(1, "VERTICAL", 0.5, "a"), (2, "UTILITY", 0.7, "a"), (3, "VERTICAL", 0.9, "a"), (4, "VERTICAL", 0.9, "b"), (5, None, None, None), (6, "UTILITY", 0.1, "a"), (7, "UTILITY", 0.1, "a"), (9, "UTILITY", 0.1, "b")])
    v = ents(spark, *[(i, "function", "f") for i in (1, 2, 3, 4, 5, 7, 8)], (6, "file", "x"))
    e = edges(spark, (1, 2), (4, 3), (2, 3), (8, 7), (2, 7), (4, 4))
    assert sorted((q.feature_tag or "-", q.entity_id) for q in rp.entry_points(j, v, e).collect()) == [("-", 5), ("a", 1), ("a", 3), ("a", 7)]
    got = {q.feature_tag: q for q in rp.features(j, v, e, 2).collect()}
    assert got["a"].entry_points == [1, 3] and (got["a"].entity_count, got["a"].vertical, got["a"].utility) == (5, 2, 3)
    assert got["b"].entry_points is None and got[None].entry_points == [5]


def test_call_motifs_of_three(spark):
    members = spark.createDataFrame([(i, "function" if i < 4 else "method", "m") for i in range(6)] + [(9, "class", "m"), (7, "function", "n")], "id long, kind string, community string")
    pairs = [(0, 4), (1, 4), (2, 4), (4, 5), (4, 3), (0, 9), (0, 7)]
    got = {(q.motif, q.n, q.adherence) for q in rp.call_motifs(members, edges(spark, *pairs), 0.5).collect()}
    assert got == {("function->method", 3, 0.5), ("function->method->method", 3, 0.5), ("function->method->function", 3, 0.5)}


def test_health_report(spark):
    v = ents(spark, *[(i, "function", f"f{i}") for i in range(40)])
    j = just(spark, [(i, "VERTICAL" if i < 7 else "UTILITY", 0.4 if i < 7 else 0.9, "a" if i else "lone", "mixed" if i == 3 else None) for i in range(30)])
    e = edges(spark, *[(i, 1) for i in range(2, 24)], (1, 2), *[(39, i) for i in range(3, 39)])
    scores = j.select("entity_id", F.when(F.col("entity_id") < 2, 0.1).otherwise(0.8).alias("score"))
    got = {q.risk: (q.severity, q.affected, q.samples) for q in he.report(j, rp.feature_counts(j), v, e, scores).collect()}
    assert got["untested_vertical"] == ("high", 7, [str(i) for i in range(7)])
    assert got["low_confidence"] == ("medium", 7, []) and got["high_utility_ratio"] == ("medium", 23, [])
    assert got["single_entity_feature"] == ("low", 1, ["lone"]) and got["architectural_violation"] == ("high", 1, ["3"])
    assert got["high_fan_in"] == ("high", 1, ["1"]) and got["high_fan_out"] == ("high", 1, ["39"])
    assert got["circular_dependency"] == ("high", 1, ["1,2"]) and got["missing_justification"] == ("high", 10, [])
    assert got["low_quality_justification"] == ("medium", 2, ["0", "1"]) and got["dead_code"] == ("medium", 2, ["0", "39"])
    assert got["confidence_gap"] == ("medium", 1, ["lone"]) and "llm_failure" not in got
    stubs = just(spark, [(i, "UTILITY", 0.3, "unclassified") for i in range(3)])
    only = he.report(stubs, rp.feature_counts(stubs), v, e, scores).collect()
    assert [(q.risk, q.severity, q.affected) for q in only] == [("llm_failure", "high", 3)]


def test_empty_tables(spark):
    j, v, e = just(spark, []), ents(spark), edges(spark)
    assert he.report(j, rp.feature_counts(j), v, e, j.select("entity_id", F.lit(0.1).alias("score"))).count() == 0
    for f in (rp.features(j, v, e), rp.file_tree(v.withColumn("file_path", F.lit(""))), rp.hotspots(v, e), rp.import_resolution(e, v), x.boundary(e, v), x.neighbourhood(e), t.embedding_texts(v, j)):
        assert f.count() == 0
    assert tuple(rp.signal_quality(v, j).first()) == (0, 0, None)
    assert tuple(rp.max_branch(j.select(F.col("entity_id").alias("branch"))).first()) == (0,)
    assert r.trust_boundary(v, e, v, F.lit(True), F.lit(True), F.lit(False)).count() == 0


def test_counts_and_usage(spark):
    calls = spark.createDataFrame([("a", 1_000_000), ("b", 500_000), (None, 500_000)], "model string, tokens long")
    got = {q.model: (q.tokens, q.calls, q.cost) for q in rp.token_usage(calls, {"a": 3.0}, 1.0).collect()}
    assert got == {"a": (1_000_000, 1, 3.0), "b": (500_000, 1, 0.5), None: (500_000, 1, 0.5), "total": (2_000_000, 3, 4.0)}
    f = spark.createDataFrame([("x", 1), ("x", 9), ("y", 9), ("z", 1), ("x", None)], "file string, at int")
    assert {q.file: (q.reverted, q.state) for q in rp.rewind_radius(f, F.col("at") > 5).collect()} == {"x": (1, "conflicted"), "y": (1, "at_risk"), "z": (0, "safe")}


def test_review_paths(spark):
    """0 -> 1 -> 2 -> 3 -> 4, 5 -> 2: a route at 0, a mutation at 4, a guard at 5."""
    v = ents(spark, *[(i, "function", n) for i, n in enumerate(["route", "onOrderEvent", "work", "relay", "insertRow", "verifyUser"])], (6, "class", "C"))
    e = edges(spark, (0, 1), (1, 2), (2, 3), (3, 4))
    cond = (F.col("name") == "route", F.col("name").rlike(r.MUTATES), F.col("name").rlike(r.VALIDATES))
    ids = lambda d: sorted(q.id for q in d.collect())
    assert ids(r.trust_boundary(v, e, v, *cond)) == [1, 2, 3]
    assert ids(r.trust_boundary(v, e, v, *cond, vouched=v.where("id = 2"))) == [1, 3]
    assert ids(r.trust_boundary(v, e.union(edges(spark, (5, 2))), v, *cond)) == [1]
    assert ids(r.trust_boundary(v, e, v, *cond, hops=2)) == [2]
    trig = (F.col("name").rlike(r.TRIGGERED), F.col("name").rlike(r.WRITES), F.col("name").rlike(r.ONCE))
    assert ids(r.idempotency(v, e, v, *trig)) == [] and ids(r.idempotency(v, e, v, *trig, hops=3)) == [1]
    assert ids(r.contract_check(v.where("id > 1"), e, v.withColumn("kind", F.when(F.col("id") == 1, "api_route").otherwise("function")))) == [2]
    j = just(spark, [(i, "VERTICAL" if i == 4 else "UTILITY", 0.5, "logging") for i in range(5)])
    ok = lambda ch, **k: {q.pr: q.approve for q in r.looks_good(ch, j, e, ["pr"], **k).collect()}
    ch = v.withColumn("pr", F.floor(F.col("id") / 2))
    assert ok(ch) == {0: True, 1: True, 2: False, 3: False}
    assert ok(ch.where("id < 4"), errors=spark.createDataFrame([(1,)], "pr long")) == {0: True, 1: False}
    assert ok(ch.where("id < 2"), areas=("auth",)) == {0: False} and ok(ch.where("id in (2, 3)"), callers=0) == {1: False}


def test_a_crowded_parent_is_listed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(x, "MEMBERS", 7, raising=False)
    monkeypatch.setattr(x, "LISTED", 500, raising=False)
    ids = [*range(100), 6, 6, 50]  # equal ids across the edge of a part
    v = spark.createDataFrame([(i, "a") for i in ids] + [(200, "b"), (201, "b"), (300, "c"), (400, None), (500, "d"), (500, "d")], "id long, name string").coalesce(1)
    want = sorted([(i, [k for k in sorted(ids) if k != i]) for i in ids] + [(200, [201]), (201, [200])])
    got = x.siblings(v, ["name"])
    assert sorted((q.id, q.siblings) for q in got.collect()) == want
    held = [q["count"] for q in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 8 and max(held) < 30
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(q) for q in x.siblings(v, ["name"], joined_by=",").collect()) == [(i, ",".join(map(str, s))) for i, s in want]
    assert sorted(tuple(q) for q in x.siblings(v, ["name"], 5, joined_by="-").collect()) == [(q.id, "-".join(map(str, q.siblings))) for q in x.siblings(v, ["name"], 5).orderBy("id").collect()]
    assert {q.id: q.siblings for q in x.siblings(v, ["name"], 5).collect()}[3] == [0, 1, 2, 4, 5]


def test_context(spark):
    v = ents(spark, (1, "class", "a"), (2, "class", "a"), (3, "class", "a"), (4, "class", None))
    assert {q.id: q.siblings for q in x.siblings(v, ["name"]).collect()} == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    assert {q.id: q.siblings for q in x.siblings(v, ["name"], 1).collect()} == {1: [2], 2: [1], 3: [1]}
    f = v.withColumn("path", F.element_at(F.create_map(F.lit(1), F.lit("m.ts"), F.lit(2), F.lit("m.test.ts"), F.lit(3), F.lit("o.ts"), F.lit(4), F.lit("u.test.ts")), F.col("id").cast("int")))
    got = x.tests_of(edges(spark, (4, 3), (2, 4), (1, 3)), f, F.col("path").contains(".test."), F.regexp_replace("path", r"(\.test)?\.ts$", "")).collect()
    assert sorted((q.id, q.test_id) for q in got) == [(1, 2), (3, 4)]
    lines = spark.createDataFrame([(1, "f", 1, 9), (2, "f", 5, None), (3, "g", 1, 9), (4, "f", 8, 9)], "id long, file_path string, start_line int, end_line int")
    assert sorted(q.id for q in x.at_line(lines, 7, "f").collect()) == [1, 2]
    rules = spark.createDataFrame([(1, None, ["class"], False), (2, 60, None, None), (3, 45, ["class", "class", "x"], True)], "rule int, priority int, kinds array<string>, fits_file boolean")
    assert [(q.rule, q.score) for q in x.rank_rules(rules, v.union(v)).collect()] == [(3, 85), (1, 70), (2, 60)]


@pytest.mark.parametrize("name,phrase", [("validateUserInput", "validates user input"), ("retry_failed_jobs", "retries failed jobs"), ("fetchHTTPPage", "fetches http page"), ("userAccountTotals", "user account totals"), ("x", None), (None, None)])
def test_name_phrase(spark, name, phrase):
    assert spark.createDataFrame([(name,)], "n string").select(t.name_phrase(F.col("n"))).first()[0] == phrase


def test_summary(spark):
    assert t.summary_of(None) == "" and t.summary_of("x = 1", 10) == "x = 1"
    filler = ["const a = 1", "let b = 2", "for (const i of items) {", "  logger.info(i)", "}", "// note", "more(1)"]
    body = "\n".join(["if (a) {", *filler, "throw new Error('x')", "one()", "return total"])
    want = "if (a) {\n[SETUP: 2 lines]\n[LOOP: for over items]\n[LOG]\n[... 3 lines ...]\nthrow new Error('x')\none()\nreturn total"
    assert t.summary_of(body, len(body) - 1) == want
    short = t.summary_of(body, 90)
    assert short == "if (a) {\nthrow new Error('x')\nreturn total\n[... 8 lines of supporting code ...]"
    assert t.summary_of(body, 20) == short[:20] + "\n// ... truncated"
    rows = spark.createDataFrame([(body,), (None,), ("",), ("plain " * 400_000,)], "body string")
    got = [q[0] for q in rows.select(t.summarize(F.col("body"), len(body) - 1)).collect()]
    assert got == [want, "", "", "\n[... 1 lines of supporting code ...]"]


def test_embedding_texts(spark):
    e = spark.createDataFrame([(1, "class", "Shop", "s.ts", None, ["m%d" % i for i in range(17)], "class x {}"), (2, "module", None, None, "sig", None, "body"), (3, "file", "f", "f", None, None, None)], "id long, kind string, name string, file_path string, signature string, methods array<string>, body string")
    j = just(spark, [(1, "VERTICAL", 0.5, "pay", None, ["money", "card"])])
    got = {q.key: q.text for q in t.embedding_texts(e, j).collect()}
    head = "Class: Shop\nFile: s.ts\nMethods: " + ", ".join(f"m{i}" for i in range(15)) + " and 2 more"
    assert got == {"1": head + "\nDomain: money, card\nFeature: pay\n\nclass x {}", "1::code": head + "\n\nclass x {}", "2": "Module: unknown", "2::code": "Module: unknown"}


def test_quarantine_and_healing(spark):
    f = spark.createDataFrame([("a", 9, False), ("b", 99, False), ("c", 1, True), ("d", None, None)], "file_path string, size long, bad boolean")
    got = c.quarantine(f, "size", 10, F.col("bad"))
    assert {q.file_path: q.reason for q in got.collect()} == {"a": None, "b": "file_too_large", "c": "extraction_error", "d": None}
    assert [q.file_path for q in c.healed(f.where("file_path in ('a', 'b')"), got).collect()] == ["a"]


def test_steps_go_on(spark, tmp_path):
    runs, fail = [], [True]

    def one(s, _):
        runs.append("one")
        return s.range(5).toDF("id")

    def two(s, rows):
        runs.append("two")
        if fail[0]:
            raise RuntimeError("lost")
        return rows.where("id > 1")

    with pytest.raises(RuntimeError):
        steps.run_steps(spark, str(tmp_path), "r", [("one", one), ("two", two)])
    fail[0] = False
    rows, record = steps.run_steps(spark, str(tmp_path), "r", [("one", one), ("two", two)])
    assert rows.count() == 3 and runs == ["one", "two", "two"]
    assert [(q.step, q.status) for q in record.orderBy("ordinal").collect()] == [("one", "resumed"), ("two", "done")]
    with pytest.raises(ValueError):
        steps.run_steps(spark, str(tmp_path), "s", [("one", one), ("one", one)])
    assert json.dumps(record.columns) == '["ordinal", "step", "status"]'


def test_edge_delta_is_one_aggregate(spark):
    from graphloom.operators import context

    schema = "src long, dst long, kind string"
    base = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (3, 4, "a"), (5, None, "a")], schema)
    branch = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 2, "b"), (5, None, "a")], schema)
    got = context.edge_delta(base, branch)
    assert sorted(map(tuple, got.collect())) == [(1, 2, "b", "added"), (3, 4, "a", "deleted")]
    plan = context.edge_delta(base, branch)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan
