"""Sources of code facts: workspaces, languages, commit logs, diffs, and a regex parser for entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file extension, directories never indexed, and how paths are classed.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "rs": "rust",
    "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "scala": "scala", "json": "json", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "md": "markdown", "css": "css", "scss": "scss", "html": "html", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell",
}
IGNORED_DIRS = tuple(
    ".git .svn .hg node_modules .next .turbo .yarn .pnp __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .venv venv .eggs target .gradle .mvn bin obj .nuget .bundle"
    " dist build out vendor .cache coverage .idea .vscode".split()
)
IGNORED_FILES = r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|go\.sum)$|\.(?:png|jpe?g|gif|ico|svg|woff2?|ttf|eot|pdf|zip|gz|tar|min\.js|map)$"
TEST_PATH = r"(?:^|/)(?:__tests__|tests?|spec)/|\.(?:test|spec)\.[jt]sx?$|_test\.(?:go|py)$|(?:^|/)test_[^/]*\.py$"
ENTRY_PATH = r"(?:^|/)(?:route|page|layout|main|index|app|server|middleware)\.[a-z]+$"
CONFIG_PATH = r"\.config\.[cm]?[jt]s$|(?:^|/)(?:tsconfig|package|\.eslintrc)[^/]*\.json$|\.(?:ya?ml|toml|ini|env)$"
LOCKFILES = r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|go\.sum|Gemfile\.lock|composer\.lock)$"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root`` with their bytes, ignored ones left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.where(~ignored(F.col("path"))).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def ignored(path: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Whether a path lies in a directory or is a file that is never indexed, or matches an ignore pattern."""
    dirs = "(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS) + ")/"
    out = path.rlike(dirs) | path.rlike(IGNORED_FILES)
    for p in patterns:
        rx = "(?:^|/)" + "".join({"*": "[^/]*", ".": r"\.", "?": "[^/]"}.get(c, c) for c in p.strip("/")) + "(?:/|$)"
        out = out | path.rlike(rx)
    return out


def below(spark: SparkSession, root: str, path: Column) -> Column:
    """Full paths as paths from ``root`` on, in whatever store it lies."""
    r = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = r.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(r).toString()
    return F.substr(path, F.lit(len(full) + 2))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def text_of(content: Column) -> Column:
    """UTF-8 text of a file; null where it holds a NUL or is not UTF-8 (binary)."""
    return F.when(F.position(F.lit("00"), F.hex(F.substring(content, 1, 8192))) % 2 == 1, None).otherwise(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")))


def path_class(path: Column) -> Column:
    return F.when(path.rlike(TEST_PATH), "test").when(path.rlike(CONFIG_PATH), "config").when(path.rlike(ENTRY_PATH), "entry").otherwise("other")


def external_package(imported: Column, lang: Column) -> Column:
    """Name of the package that an import names, null for a local one."""
    parts = F.split(imported, "/")
    scoped = F.when(F.startswith(imported, F.lit("@")), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    dotted = F.get(F.split(imported, r"\."), F.lit(0))
    local = imported.rlike(r"^(\.|/|~/|@/)")
    return F.when(local, None).when(lang.isin("python", "java", "kotlin"), dotted).when(lang == "go", F.concat_ws("/", F.slice(parts, 1, 3))).otherwise(scoped)


def parse_commit_log(records: DataFrame) -> DataFrame:
    """Records (value) of a commit log: fields sha, subject, author, epoch seconds between \\x1f, then files by line.

    Records with fewer fields or without files are left out; a row per commit and file."""
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, F.lit(0)), "\x1f")
    files = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x) != "")
    r = records.select(head.alias("h"), files.alias("files")).where((F.size("h") >= 4) & (F.size("files") > 0))
    return r.select(F.get("h", F.lit(0)).alias("sha"), F.get("h", F.lit(1)).alias("subject"), F.get("h", F.lit(2)).alias("author"), F.get("h", F.lit(3)).cast("long").alias("ts"), F.explode(F.array_distinct("files")).alias("file"))


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """A log file whose records begin with \\x1e."""
    return parse_commit_log(spark.read.text(path, lineSep="\x1e").where("value <> ''"))


def diff_hunks(diffs: DataFrame, id_col: str = "id", diff_col: str = "diff") -> DataFrame:
    """Changed ranges of unified diffs: (id, file, start, count) of each hunk's new side, lock files left out."""
    sections = diffs.select(id_col, F.explode(F.split(diff_col, r"(?m)^diff --git ")).alias("s"))
    file = F.regexp_extract("s", r"(?m)^\+\+\+ b/(.*)$", 1)
    found = F.regexp_extract_all("s", F.lit(r"(?m)^(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"), F.lit(1))
    h = sections.select(id_col, file.alias("file"), F.explode(found).alias("h")).where((F.col("file") != "") & ~F.col("file").rlike(LOCKFILES))
    n = F.regexp_extract("h", r"\+\d+,(\d+)", 1)
    return h.select(id_col, "file", F.regexp_extract("h", r"\+(\d+)", 1).cast("int").alias("start"), F.when(n == "", 1).otherwise(F.expr("try_cast(regexp_extract(h, '\\\\+\\\\d+,(\\\\d+)', 1) as int)")).alias("count"))


# Declarations by language, as (kind, regex with one group for the name).
DECLARATIONS = {
    "typescript": (("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*[=<]"), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("variable", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*[:=]")),
    "python": (("class", r"^\s*class\s+(\w+)"), ("method", r"^\s+(?:async\s+)?def\s+(\w+)"), ("function", r"^(?:async\s+)?def\s+(\w+)"), ("variable", r"^([A-Z][A-Z0-9_]+)\s*=")),
    "go": (("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("type", r"^type\s+(\w+)\s")),
    "java": (("class", r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|protected)\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|protected)\s+)*enum\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(")),
    "c": (("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)"), ("function", r"^[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;]*\)\s*\{")),
    "cpp": (("class", r"^\s*class\s+(\w+)"), ("struct", r"^\s*struct\s+(\w+)"), ("namespace", r"^\s*namespace\s+(\w+)"), ("function", r"^[A-Za-z_][\w\s\*&:<>]*?\b(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{")),
    "csharp": (("class", r"^\s*(?:(?:public|private|internal|protected|abstract|sealed|static|partial)\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:(?:public|internal)\s+)*interface\s+(\w+)"), ("struct", r"^\s*(?:(?:public|internal|readonly)\s+)*struct\s+(\w+)"), ("namespace", r"^\s*namespace\s+([\w.]+)"), ("method", r"^\s+(?:(?:public|private|internal|protected|static|async|virtual|override)\s+)+[\w<>\[\],? ]+\s+(\w+)\s*\(")),
    "php": (("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|abstract|final)\s+)+function\s+(\w+)"), ("function", r"^function\s+(\w+)")),
    "ruby": (("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s+def\s+(?:self\.)?(\w+[?!]?)"), ("function", r"^def\s+(\w+[?!]?)")),
    "rust": (("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("method", r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)")),
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
NOT_NAMES = ("if", "for", "while", "switch", "catch", "return", "else")


def parse_entities(files: DataFrame, repo: str = "repo") -> DataFrame:
    """Entities declared in files (path, text): id, kind, name, file_path, start_line, language.

    Each line is tried against its language's declarations in order; the first that fits names it."""
    from ..functions.scalars import entity_id

    lines = files.withColumn("language", language(F.col("path"))).where(F.col("language") != "unknown").select("path", "language", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    hit = None
    for lang, decls in DECLARATIONS.items():
        chain = None
        for kind, rx in decls:
            test = F.col("line").rlike(rx)
            value = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", rx, 1).alias("name"))
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        hit = F.when(F.col("language") == lang, chain) if hit is None else hit.when(F.col("language") == lang, chain)
    found = lines.withColumn("d", hit).where("d is not null").select("path", "language", "n", "line", "d.kind", "d.name").where(~F.col("name").isin(*NOT_NAMES))
    sig = F.trim("line")
    return found.select(entity_id(F.lit(repo), F.col("path"), F.col("kind"), F.col("name"), sig).alias("id"), "kind", "name", F.col("path").alias("file_path"), (F.col("n") + 1).cast("int").alias("start_line"), "language", sig.alias("signature"))


# Import statements by language, with one group for what is imported.
IMPORTS = {
    "typescript": r"(?:from\s+|import\s+|require\()\s*['\"]([^'\"]+)['\"]", "javascript": r"(?:from\s+|import\s+|require\()\s*['\"]([^'\"]+)['\"]",
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "c": r"^\s*#include\s+[<\"]([^>\"]+)", "cpp": r"^\s*#include\s+[<\"]([^>\"]+)", "csharp": r"^\s*using\s+([\w.]+)\s*;", "php": r"^\s*use\s+([\w\\]+)", "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
}


def parse_imports(files: DataFrame) -> DataFrame:
    """(file_path, imported, language) of files (path, text)."""
    lines = files.withColumn("language", language(F.col("path"))).select("path", "language", F.explode(F.split("text", "\n")).alias("line"))
    got = None
    for lang, rx in IMPORTS.items():
        one = F.regexp_extract("line", rx, 1)
        if lang == "python":
            one = F.concat(one, F.regexp_extract("line", rx, 2))
        got = F.when(F.col("language") == lang, one) if got is None else got.when(F.col("language") == lang, one)
    return lines.select(F.col("path").alias("file_path"), got.alias("imported"), "language").where("imported <> ''").distinct()
