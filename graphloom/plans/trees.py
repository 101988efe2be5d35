"""Token trees over real texts: every document as a source file of one of ten languages, its own words in comments, strings and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import code, tokens
from ..sources import projections as p
from .base import query

# A file of each language.  Marks: 1 the document's text as comment lines, 2 its words as the inside of a literal, 3 its number.
# Each holds a declaration and a call inside a comment or literal, which count for nothing.
LAYOUTS = {
    "ts": "\x01\nexport class C\x03 {\n  m = `\nclass Decoy {}\n\x02`;\n}\nexport function f\x03(a) { /* eval(b) */\n  return eval(a\x03) + eval(`\x02`, a)\n}\n",
    "py": "\x01\nclass C\x03:\n    \"\"\"\nclass Decoy:\n\x02\"\"\"\n    def f\x03(self, a):\n        return eval(a\x03) + eval('\x02', a) # eval(b)\n",
    "go": "\x01\nfunc f\x03(a int) int {\n  s := `\nfunc Decoy()\n\x02`\n  return eval(a\x03) + eval(`\x02`, a) // eval(b)\n}\n",
    "java": "\x01\npublic class C\x03 {\n  String s = \"\"\"\nclass Decoy {\n\x02\"\"\";\n  int x = eval(a\x03) + eval(\"\x02\", a); /* eval(b) */\n}\n",
    "c": "\x01\nint f\x03(int a) {\n  char q = '\"'; /*\nint decoy(int a) {\n*/\n  return eval(a\x03) + eval(\"\x02\", a); // eval(b)\n}\n",
    "cpp": "\x01\nclass C\x03 {\n  const char* s = R\"(\nclass Decoy {\n\x02)\";\n  int x = eval(a\x03) + eval(\"\x02\", a); // eval(b)\n};\n",
    "cs": "\x01\npublic class C\x03 {\n  string s = @\"\nclass Decoy {\n\x02\";\n  int x = eval(a\x03) + eval(\"\x02\", a); // eval(b)\n}\n",
    "php": "\x01\nclass C\x03 {\n  # eval(b)\n  public $s = '\nclass Decoy {\n\x02';\n  public $x = eval(a\x03) + eval('\x02', a);\n}\n",
    "rb": "\x01\nclass C\x03\n=begin\nclass Decoy\n=end\n  def f\x03\n    eval(a\x03) + eval('\x02', a) # eval(b)\n  end\nend\n",
    "rs": "\x01\nstruct C\x03<'a> { s: &'a str }\nfn f\x03(a: i32) -> i32 {\n  let s = r#\"\nstruct Decoy\n\x02\"#;\n  eval(a\x03) + eval(\"\x02\", a) // eval(b)\n}\n",
}
EXTENSIONS = tuple(LAYOUTS)
# What a file declares, by its line after the lines of the text, and where its calls stand.
DECLARED = (
    ("ts", "class", "C", 1), ("ts", "function", "f", 6), ("py", "class", "C", 1), ("py", "method", "f", 5), ("go", "function", "f", 1), ("java", "class", "C", 1), ("c", "function", "f", 1), ("cpp", "class", "C", 1),
    ("cs", "class", "C", 1), ("php", "class", "C", 1), ("rb", "class", "C", 1), ("rb", "method", "f", 5), ("rs", "struct", "C", 1), ("rs", "function", "f", 2),
)
CALL_LINE = {"ts": 7, "py": 6, "go": 5, "java": 5, "c": 5, "cpp": 5, "cs": 5, "php": 6, "rb": 6, "rs": 6}

EXT_SQL = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "][doc_id % 10 + 1]"
FILES_SQL = f"""files as (select doc_id, {EXT_SQL} as ext, 'src/' || doc_id || '.' || {EXT_SQL} as path, coalesce(text, '') as text,
  length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 as lines from documents)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def documents(spark, d):
    """(doc_id, ext, path, text): each document's own text under the name of a source file; a null text is an empty one."""
    docs = p.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("ext", F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 10).cast("int")))
    return docs.withColumn("path", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("."), F.col("ext")))


def files(spark, d):
    """The same documents inside the layout of their language.  The text goes in last, so that nothing in it counts as a mark."""
    docs = documents(spark, d)
    sign = F.when(F.col("ext").isin("py", "rb"), "# ").otherwise("// ")
    comment = F.concat(sign, F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), sign)))
    # Words joined by blanks, and a blank for what stands before and after them: half the time of replacing all between them.
    words = F.array_join(F.regexp_extract_all(F.concat(F.lit("x"), F.col("text"), F.lit("x")), F.lit("[A-Za-z0-9]++"), F.lit(0)), " ")
    literal = F.substr(words, F.lit(2), F.length(words) - 2)
    layout = F.create_map(*[F.lit(x) for kv in LAYOUTS.items() for x in kv])[F.col("ext")]
    numbered = F.replace(layout, F.lit("\x03"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", "ext", "path", F.replace(F.replace(numbered, F.lit("\x02"), literal), F.lit("\x01"), comment).alias("text"))


@query("S8_entities_ten_languages", f"""select f.path as file_path, kind, letter || doc_id as name, lines + off as start_line
  from files f join (values {_values(DECLARED)}) v(ext, kind, letter, off) using (ext)""", FILES_SQL)
def entities(spark, d):
    """Declarations outside comments and strings, in all ten languages."""
    f = files(spark, d).select("path", tokens.code_only(F.col("text"), code.language(F.col("path"))).alias("text"))
    return code.parse_entities(f).select("file_path", "kind", "name", "start_line")


def _cut_sql() -> str:
    """The lexers in SQL: a family's pieces without possessive loops, each token with its class."""
    parts = []
    for name in tokens.FAMILIES:
        comments, literals = ("(?:" + "|".join(map(tokens.plain, x)) + ")" for x in tokens.FAMILIES[name])
        exts = ", ".join(f"'{e}'" for e in EXTENSIONS if tokens.FAMILY_OF[code.LANGUAGES[e]] == name)
        q = lambda x: x.replace("'", "''")
        parts.append(f"""select doc_id, pos, token, case when trim(token, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then 'space' when regexp_full_match(token, '{q(comments)}') then 'comment'
          when regexp_full_match(token, '{q(literals)}') then 'string' when regexp_full_match(token, '{q(tokens.plain(tokens.WORD))}') then 'word' when regexp_full_match(token, '{q(tokens.plain(tokens.NUMBER))}') then 'number' else 'symbol' end as class
          from (select doc_id, unnest(ts) as token, generate_subscripts(ts, 1) as pos from (select doc_id, regexp_extract_all(text, '{q(tokens.plain(tokens.lexer(name)))}') as ts from files where ext in ({exts})))""")
    return "cut as (" + " union all ".join(parts) + ")"


DEPTH_SQL = """deep as (select *, sum(case when class <> 'symbol' then 0 when token in ('(', '[', '{') then 1 when token in (')', ']', '}') then -1 else 0 end) over (partition by doc_id order by pos) as depth from cut)"""


@query("S8_token_trees", """select doc_id, count(*) filter (class = 'comment') as comments, count(*) filter (class = 'string') as strings, count(*) filter (class = 'word') as words,
  count(*) filter (class = 'number') as numbers, count(*) filter (class = 'symbol') as symbols, greatest(max(depth), 0)::integer as deepest from deep where class <> 'space' group by doc_id""", FILES_SQL, _cut_sql(), DEPTH_SQL)
def trees(spark, d):
    """The documents' own texts cut by the lexers of ten languages: tokens by class and the deepest nesting.  Texts without tokens have no row."""
    t = tokens.token_table(documents(spark, d).select("path", "text"))
    opening = (F.col("class") == "symbol") & F.col("token").isin("(", "[", "{")
    inside = F.greatest(F.max(F.col("depth") + opening.cast("int")), F.lit(0))
    n = lambda kind: F.count(F.when(F.col("class") == kind, 1))
    return t.groupBy(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id")).agg(
        n("comment").alias("comments"), n("string").alias("strings"), n("word").alias("words"), n("number").alias("numbers"), n("symbol").alias("symbols"), inside.alias("deepest"))


@query("S17_structural_patterns", f"""select path, 'one' as pattern_id, lines + off as line, 'a' || doc_id as x, 0::bigint as n from files join (values {_values(CALL_LINE.items())}) v(ext, off) using (ext)
  union all select path, 'two', lines + off, 'a', length(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) + 2 from files join (values {_values(CALL_LINE.items())}) v(ext, off) using (ext)""", FILES_SQL)
def patterns(spark, d):
    """Calls by shape: one argument, or a literal and a second argument; never those in comments and strings."""
    wanted = [(name, lang, text) for lang in sorted({code.LANGUAGES[e] for e in EXTENSIONS}) for name, text in (("one", "eval($X)"), ("two", "eval($S, $X)"))]
    m = tokens.match_patterns(files(spark, d).select("path", "text"), wanted)
    bound = lambda name: F.try_element_at("bindings", F.lit(name))
    return m.select("path", "pattern_id", "line", bound("X").alias("x"), F.coalesce(F.length(bound("S")), F.lit(0)).cast("long").alias("n"))


@query("C9_canonical_change", "select doc_id, doc_id % 4 = 1 as changed from documents")
def canonical(spark, d):
    """Which files' code changed: of four, one has new comments, one a new name, one another layout, one is as it was."""
    f, k = files(spark, d), F.col("doc_id") % 4
    sign = F.when(F.col("ext").isin("py", "rb"), "#").otherwise("//")
    new = F.when(k == 0, F.concat(F.col("text"), sign, F.lit(" eval(c)\n"))).when(k == 1, F.replace(F.col("text"), F.lit("+ eval"), F.lit("+ exec"))).when(k == 2, F.replace(F.col("text"), F.lit("+ eval("), F.lit("+   eval( ")))
    lang = code.language(F.col("path"))
    return f.select("doc_id", (tokens.canonical(F.col("text"), lang) != tokens.canonical(F.coalesce(new, F.col("text")), lang)).alias("changed"))
