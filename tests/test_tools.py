"""Tools, hierarchy, index decoding and workspaces."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import hierarchy as h
from graphloom.sources import projections as p
from graphloom.sources import scip, workspace
from graphloom.tools import TOOLS, Repo

SF = "/root/testdata/sf0.001"


def repo(spark):
    e = p.entities(spark, SF)
    rules = spark.createDataFrame(
        [(1, "No any", "repo", "active", 5, None, "typescript", "error", r"\bany\b", ["function"]), (2, "no any", "path", "active", 1, "src/**", None, "warn", "any", ["class"]), (3, "Old", "repo", "archived", 9, None, None, "warn", "x", None)],
        "id int, title string, scope string, status string, priority int, path_glob string, language string, enforcement string, regex string, entity_kinds array<string>",
    )
    ledger = spark.createDataFrame(
        [(f"l{i}", "main", ["pending", "committed", "broken", "pending"][i], f"fix the bug number {'one' if i else 'two'}", f"2024-01-0{i + 1}") for i in range(4)],
        "id string, branch string, status string, prompt string, d string",
    ).withColumn("created_at", F.col("d").cast("timestamp"))
    pats = spark.createDataFrame([(1, "Arrow functions", "confirmed", 0.9, 0.8), (2, "Other", "draft", 0.2, 0.1)], "id int, title string, status string, confidence double, adherence double")
    vec = p.vectors(spark, SF)
    return Repo(entities=e, edges=p.edges(spark, SF), justifications=p.justifications(spark, SF), vectors=vec, rules=rules, patterns=pats, ledger=ledger, events=ledger, comments=spark.createDataFrame([("error",), ("error",), ("info",)], "severity string"))


def test_every_tool_answers(spark):
    x = repo(spark)
    name = x.entities.where("id = 10").first().name
    path = x.entities.where("id = 10").first().file_path
    files = spark.createDataFrame([("a.ts", "typescript", "let x: any\nfine\n")], "path string, language string, text string")
    args = {
        "search_code": {"query": name}, "semantic_search": {"query": name, "model": lambda t: np.ones((len(t), 64))}, "find_similar": {"id": 3}, "get_function": {"name": name}, "get_class": {"name": name}, "get_file": {"path": path},
        "file_context": {"path": path}, "get_callers": {"name": name, "hops": 2}, "get_callees": {"name": name}, "get_imports": {"path": path, "hops": 2}, "sync_local_diff": {"path": path, "hunks": [(1, 3)]}, "get_business_context": {"name": name},
        "search_by_purpose": {"vector": [0.1] * 64, "taxonomy": "UTILITY"}, "analyze_impact": {"name": name}, "mark_working": {"ids": ["l0", "l1"]}, "revert_to_working_state": {"target": "l1"}, "get_timeline": {"branch": "main", "cursor": "l2"},
        "sync_dirty_buffer": {"path": "b.py", "text": "def f(): pass\n"}, "get_rules": {"path": "src/a.ts"}, "check_rules": {"files": files}, "get_relevant_rules": {"name": name}, "suggest_approach": {"path": path}, "assemble_context": {"name": name},
        "refresh_context": {"paths": [path]}, "review_changes": {"changed": x.entities.where("id % 20 = 0"), "callers": 1},
    }
    got = {n: f(x, **args.get(n, {})).collect() for n, f in TOOLS.items()}
    assert len(got) >= 30 and got["get_function"][0].name == name and got["get_file"][0].file_path == path
    assert {r.id: r.status for r in got["mark_working"]} == {"l0": "working", "l1": "committed", "l2": "broken", "l3": "pending"}
    assert {r.id: r.status for r in got["revert_to_working_state"]} == {"l0": "pending", "l1": "committed", "l2": "reverted", "l3": "reverted"}
    assert [r.id for r in got["get_rules"]] == [2] and [r.pattern for r in got["check_rules"]] == ["1", "2"] or [r.pattern for r in got["check_rules"]] == [1, 2]
    assert [r.id for r in got["get_timeline"]] == ["l1", "l0"] and got["sync_dirty_buffer"][0].name == "f"
    assert got["prompt_drift"][0].drifting and len(got["get_conventions"]) == 3


def test_louvain_two_cliques(spark):
    cl = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    e = spark.createDataFrame([("r", a, b) for a, b in [*cl("abcde"), *cl("vwxyz"), ("e", "v")]], "repo_id string, src string, dst string")
    v = spark.createDataFrame([("r", x, "function") for x in "abcdevwxyz"], "repo_id string, id string, kind string")
    got = {r.id: r.community for r in h.louvain(e, v, ["repo_id"]).collect()}
    assert len({got[i] for i in "abcde"}) == 1 == len({got[i] for i in "vwxyz"}) and got["a"] != got["v"]


def test_hot_paths(spark):
    e = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), (3, 2, "calls"), (3, 4, "calls"), (9, 4, "calls")], "src long, dst long, kind string")
    f = spark.createDataFrame([(i, "pay") for i in (1, 2, 3, 4)] + [(9, "other")], "entity_id long, feature_tag string")
    assert [(r.feature_tag, r.start, r.path) for r in h.hot_paths(e, f).collect()] == [("pay", 1, [1, 2, 3, 4])]


def test_propagate(spark):
    rows = [("root", None, "x", ["r"], 1.0), ("c1", "root", "pay", ["a"], 0.5), ("c2", "root", "pay", ["a", "b"], 0.7), ("c3", "root", "pay", ["a"], 0.6), ("g1", "c1", "misc", [], 0.2), ("lone", None, "y", ["q"], 0.9)]
    got = {r.id: r for r in h.propagate(spark.createDataFrame(rows, "id string, parent string, tag string, concepts array<string>, confidence double")).collect()}
    assert got["root"].propagated_tag == "pay" and got["root"].propagated_concepts[0] == "a" and got["root"].propagated_confidence == 0.6
    assert got["g1"].propagated_tag == got["c1"].propagated_tag and "a" in got["g1"].propagated_concepts
    assert got["lone"].propagated_tag is None


def test_propagate_as_deep_as_the_tree_is(spark):
    rows = [(i, i - 1 if i else None, "misc" if i else "pay", [], i / 10) for i in range(11)]
    got = {r.id: r for r in h.propagate(spark.createDataFrame(rows, "id long, parent long, tag string, concepts array<string>, confidence double")).collect()}
    assert sorted(got) == list(range(11)) and got[9].propagated_confidence == 1.0


def field(n, v):
    def vint(x):
        out = b""
        while True:
            out += bytes([x & 0x7F | (0x80 if x > 0x7F else 0)])
            x >>= 7
            if not x:
                return out

    return vint(n << 3) + vint(v) if isinstance(v, int) else vint(n << 3 | 2) + vint(len(v)) + v


def test_index_decoding(spark, tmp_path):
    occ = lambda line, sym, d: field(2, field(1, bytes([line, 0, 5])) + field(2, sym.encode()) + field(3, d))
    a, b, t = "scip ts npm app 1 a.ts/main().", "scip ts npm app 1 b.ts/Shop#pay().", "scip ts npm app 1 b.ts/Shop#"
    one = field(1, b"a.ts") + occ(3, a, 1) + occ(5, b, 0) + occ(5, b, 0) + occ(6, "local 1", 0) + occ(0, t, 0)
    two = field(1, b"b.ts") + occ(1, t, 1) + occ(20, b, 1)
    (tmp_path / "x.scip").write_bytes(field(1, b"meta") + field(2, one) + field(2, two))
    files = spark.read.format("binaryFile").load(str(tmp_path / "x.scip"))
    ents, edges = scip.decode(files, "repo", ["app"])
    names = {r.id: (r.kind, r.name, r.start_line) for r in ents.collect()}
    assert sorted(names.values()) == [("class", "Shop", 2), ("function", "main", 4), ("method", "pay", 21)]
    assert [(names[r.src][1], names[r.dst][1], r.kind) for r in edges.collect()] == [("main", "pay", "calls")]


def test_package_roots(tmp_path):
    def put(name, text=""):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    assert workspace.package_roots(str(tmp_path)) == ("single", ["."])
    put("package.json", '{"workspaces": ["packages/*", "!packages/old"]}')
    for x in ("a", "b", "old"):
        put(f"packages/{x}/package.json", "{}")
    assert workspace.package_roots(str(tmp_path)) == ("npm", ["packages/a", "packages/b"])
    put("yarn.lock")
    assert workspace.package_roots(str(tmp_path))[0] == "yarn"
    put("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n")
    assert workspace.package_roots(str(tmp_path)) == ("pnpm", [".", "packages/a", "packages/b", "packages/old"])


def test_gradle_and_maven(tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "settings.gradle").write_text("include ':app', ':gone'\n")
    assert workspace.package_roots(str(tmp_path)) == ("gradle", ["app"])
    (tmp_path / "pom.xml").write_text("<modules><module>app</module></modules>")
    assert workspace.package_roots(str(tmp_path)) == ("maven", ["app"])


def test_catalog(spark):
    text = "- id: p1\n  name: any\n  language: python\n  regex: 'eval\\('\n  severity: error\n- id: p2\n  regex: TODO\n"
    cat = workspace.load_catalog(spark, text)
    assert [(r.id, r.regex) for r in cat.orderBy("id").collect()] == [("p1", "eval\\("), ("p2", "TODO")]
    files = spark.createDataFrame([("a.py", "python", "x\neval(1) # TODO"), ("b.ts", "typescript", "eval(2)")], "path string, language string, text string")
    assert sorted((r.pattern, r.path, r.line) for r in workspace.scan_patterns(files, cat).collect()) == [("p1", "a.py", 2), ("p2", "a.py", 2)]
