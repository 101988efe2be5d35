"""Token trees: comments and strings by language, canonical text, patterns with metavariables."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.sources import code
from graphloom.sources import tokens as t

FILES = {
    "a.ts": ('// class No {}\nexport class Yes {\n  /* function no() {} */\n  m = "class No2 {} // x";\n}\nconst s = `\nclass No3 {}\n`;\nexport function go(a) { return go(go(1)); }', {"Yes", "go"}),
    "a.py": ('"""\nclass No:\n"""\n# class No2:\nclass Yes:\n    def m(self):\n        x = \'# not a comment\'\n', {"Yes", "m"}),
    "a.go": ("package x\n/*\nfunc No() {}\n*/\nfunc Yes() { s := `\nfunc No2() {}\n` }", {"Yes"}),
    "A.java": ('/** class No */\npublic class Yes {\n  String s = """\n  class No2 {}\n  """;\n}', {"Yes"}),
    "a.c": ("/* int no(int a) {\n} */\nint yes(int a) {\n  char q = '\"'; // int no2() {\n}", {"yes"}),
    "a.cpp": ('// class No {\nclass Yes {\n};\nconst char* s = R"(\nclass No2 {\n)";', {"Yes"}),
    "a.cs": ('/*\nclass No {}\n*/\npublic class Yes { string s = @"\nclass No2 {}\n"; }', {"Yes"}),
    "a.php": ("# class No {}\nclass Yes {\n}\n// function no() {}\nfunction go() { return '\nfunction x'; }", {"Yes", "go"}),
    "a.rb": ("=begin\nclass No\n=end\nclass Yes # class No2\n  def m\n    'def no'\n  end\nend", {"Yes", "m"}),
    "a.rs": ("// struct No\nstruct Yes<'a> { c: &'a str }\nfn go() { let c = '\"'; let r = r#\"\nstruct No2\n\"#; }", {"Yes", "go"}),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, x) for p, (x, _) in FILES.items()] + [("none.ts", None), ("empty.py", ""), ("x.unknown", "a b")], "path string, text string")


def test_declarations_in_comments_and_strings_are_none(files):
    lang = code.language(F.col("path"))
    got = {}
    for r in code.parse_entities(files.where("path not in ('none.ts', 'x.unknown')").withColumn("text", t.code_only(F.col("text"), lang))).collect():
        if r["kind"] != "variable":
            got.setdefault(r["file_path"], set()).add(r["name"])
    assert got == {p: names for p, (_, names) in FILES.items()}


def test_nothing_of_a_text_is_lost(files):
    lang = code.language(F.col("path"))
    rows = files.select("path", "text", t.tokens(F.col("text"), lang).alias("ts"), t.code_only(F.col("text"), lang).alias("c")).collect()
    for r in rows:
        if r["path"] in ("none.ts", "x.unknown"):
            assert r["ts"] is None and r["c"] is None
        else:
            assert "".join(r["ts"]) == r["text"]
            assert r["c"].count("\n") == r["text"].count("\n")


def test_depth_and_lines(spark):
    f = spark.createDataFrame([("a.ts", 'f(a, [b, "("]) /* ( */ {\n}\n)')], "path string, text string")
    got = [(r["token"], r["line"], r["depth"]) for r in t.token_table(f).orderBy("pos").collect()]
    assert got == [("f", 1, 0), ("(", 1, 0), ("a", 1, 1), (",", 1, 1), ("[", 1, 1), ("b", 1, 2), (",", 1, 2), ('"("', 1, 2), ("]", 1, 1), (")", 1, 0), ("/* ( */", 1, 0), ("{", 1, 0), ("}", 2, 0), (")", 3, -1)]


def test_canonical(spark):
    same = [("typescript", "a = f( 1 ) // x", "a=f(1)"), ("python", "if a:\n    b()\n", "\nif a: # why\n\n    # note\n    b()\n\n"), ("go", 's := "a  b"', "s  :=\n\"a  b\""), ("ruby", "x = 1 # a", "x   = 1")]
    other = [("typescript", 'a = "x  y"', 'a = "x y"'), ("python", "if a:\n    b()\nc()", "if a:\n    b()\n    c()"), ("java", "int ab;", "int a b;"), ("c", 'x = "// a";', 'x = "// b";')]
    df = spark.createDataFrame([(*x, True) for x in same] + [(*x, False) for x in other], "l string, a string, b string, want boolean")
    for r in df.withColumn("ca", t.canonical(F.col("a"), F.col("l"))).withColumn("cb", t.canonical(F.col("b"), F.col("l"))).collect():
        assert (r["ca"] == r["cb"]) == r["want"], r
    nulls = spark.createDataFrame([(None, "c"), ("a", None), ("a", "text"), ("", "c"), ("// only", "c")], "a string, l string")
    assert [r[0] for r in nulls.select(t.canonical(F.col("a"), F.col("l"))).collect()] == [None, None, None, "", ""]


def found(spark, text, *patterns, path="a.ts"):
    f = spark.createDataFrame([(path, text)], "path string, text string")
    return sorted((r["pattern_id"], r["line"], r["matched"], tuple(sorted(r["bindings"].items()))) for r in t.match_patterns(f, list(patterns)).collect())


def test_metavariables(spark):
    text = 'eval(\n  a /* c */)\neval(b, c); x = "eval(d)" // eval(e)\nif (p === p) q === r\neval((u + (v)))'
    assert found(spark, text, ("one", "typescript", "eval($X)")) == [("one", 1, "eval ( a )", (("X", "a"),)), ("one", 5, "eval ( ( u + ( v ) ) )", (("X", "( u + ( v ) )"),))]
    assert [(r[1], dict(r[3])["ARGS"]) for r in found(spark, text, ("any", "typescript", "eval($$$ARGS)"))] == [(1, "a"), (3, "b , c"), (5, "( u + ( v ) )")]
    assert [(r[1], r[2]) for r in found(spark, text, ("same", "typescript", "$A === $A"))] == [(4, "p === p")]
    assert [r[1:3] for r in found(spark, text, ("lit", "typescript", 'x = "eval(d)"'))] == [(3, 'x = "eval(d)"')]


def test_nested_and_equal_at_other_depths(spark):
    assert [r[2] for r in found(spark, "f(f(1))", ("n", "typescript", "f($$$A)"))] == ["f ( 1 )", "f ( f ( 1 ) )"]
    assert len(found(spark, "g((a), h((a)))", ("d", "typescript", "g($X, h($X))"))) == 1
    assert found(spark, "g((a), h((b)))", ("d", "typescript", "g($X, h($X))")) == []


def test_patterns_share_a_pass_and_a_language(spark):
    f = spark.createDataFrame([("a.py", "os.system(cmd)\n"), ("a.ts", "os.system(cmd)\n"), ("b.py", "# os.system(x)\n"), ("c.py", "")], "path string, text string")
    got = t.match_patterns(f, [("p", "python", "os.system($C)"), ("q", "typescript", "$A.system($$$R)")]).collect()
    assert sorted((r["path"], r["pattern_id"]) for r in got) == [("a.py", "p"), ("a.ts", "q")]


@pytest.mark.parametrize("bad", ["", "f($$$A, b)", "f(", "f)", "$$$A"])
def test_patterns_without_one_meaning_are_refused(bad):
    with pytest.raises(ValueError):
        t.compile_pattern(bad, "typescript")


def test_one_tree_against_brute_force(spark):
    rnd = random.Random(5)

    def expr(n):
        return rnd.choice("ab") if n == 0 else rnd.choice(["(%s)", "f(%s)", "[%s]", "f(%s, a)"]) % expr(n - 1)

    text = "\n".join(expr(rnd.randrange(6)) for _ in range(200))

    def brute(toks):
        n = 0
        for i in range(len(toks) - 3):
            if toks[i] != "f" or toks[i + 1] != "(":
                continue
            j = i + 2
            empty = toks[j] in ")]}"
            if toks[j] in "([{":
                depth = 1
                while depth:
                    j += 1
                    depth += (toks[j] in "([{") - (toks[j] in ")]}")
            n += not empty and toks[j + 1] == ")"
        return n

    assert len(found(spark, text, ("f", "typescript", "f($X)"))) == brute(re.findall(r"\w|[^\w\s]", text)) > 20


def test_long_and_broken_texts_stay_linear(spark):
    texts = ['"' + "\\\\" * 200_000, "/*" * 100_000, "'" * 200_000, "`" * 100_001, "(" * 100_000, "/" * 200_000, '"""' * 60_001]
    f = spark.createDataFrame([(f"{k}.{e}", x) for k, x in enumerate(texts) for e in ("ts", "py", "rs", "cs")], "path string, text string")
    start = time.time()
    lang = code.language(F.col("path"))
    assert f.where(F.array_join(t.tokens(F.col("text"), lang), "") != F.col("text")).count() == 0
    assert f.select(F.length(t.code_only(F.col("text"), lang)).alias("n")).where("n is null").count() == 0
    assert time.time() - start < 60


def test_texts_are_made_once_for_matching(spark):
    """What makes the texts stands once in the plan, not below a filter as well, and comments are not shuffled; separators in texts are blanks."""
    f = spark.createDataFrame([("a.ts", "f(1) //\x1f f(3)"), ("b.ts", "g(2)"), ("c.ts", 'f("a\x1fb\x1ec")'), ("d.ts", None)], "path string, text string")
    made = f.withColumn("text", F.regexp_replace("text", "mark+", "f"))
    m = t.match_patterns(made, [("one", "typescript", "f($X)")])
    assert m._jdf.queryExecution().executedPlan().toString().count("mark+") == 1
    assert {(r["path"], r["bindings"]["X"]) for r in m.collect()} == {("a.ts", "1"), ("c.ts", '"a b c"')}
    assert {r["token"] for r in t.token_table(f.where("path = 'a.ts'"), comments=False).collect()} == {"f", "(", "1", ")"}
