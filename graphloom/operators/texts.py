"""Texts made of code: body summaries, phrases of names and the texts that are embedded."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .change import descriptive_name

# Lines that a summary keeps, the first that fits, and what the others count as.
ANCHORS = (
    r"\b(expect\(|assert[\.(]|\.should\.|\.toBe|\.toEqual|\.toThrow|\.toMatch|\.toContain)",
    r"\b(throw\s+(new\s+)?\w|reject\(|Error\()",
    r"^\s*return\s+(?!;?\s*$)",
    r"(\.\w+\s*=\s|this\.\w+\s*=|\bstate\[|\.set\(|\.push\(|\.delete\(|\.splice\(|\.pop\(|\.shift\(|\.unshift\()",
    r"\b(await\s+|this\.\w+\.\w+\(|fetch\(|axios\.|\.query\(|\.execute\(|\.send\(|\.emit\(|\.publish\(|\.dispatch\()",
    r"\b(if\s*\(|else\s+if\s*\(|switch\s*\(|case\s+\S)",
)
FILLER = (
    ("LOG", r"\b(console|logger|log)\.(log|warn|error|info|debug)\("),
    ("IMPORTS", r"^\s*(import\s|const\s+\w+\s*=\s*require\(|from\s+['\"])"),
    ("LOOP", r"^\s*(for\s*\(|for\s+\w+\s+of|while\s*\(|\.forEach\(|\.map\(|\.filter\(|\.reduce\()"),
    ("TRY_CATCH", r"^\s*(try\s*\{|catch\s*\(|finally\s*\{)"),
    ("SETUP", r"^\s*(const\s|let\s|var\s)"),
)
ORDER = ("IMPORTS", "SETUP", "LOOP", "TRY_CATCH", "LOG")
LOOPS = ((r"for\s*\(\s*(?:const|let|var)\s+\w+\s+of\s+(\w+)", r"for over \1"), (r"for\s*\(.*<\s*(\w+)\.length", r"for over \1"), (r"(\w+)\.(forEach|map|filter|reduce)\(", r"\2 over \1"))
# Verbs that begin the names a phrase is made of.
VERBS = (
    "process validate create update delete fetch get set build parse transform handle send check compute calculate generate load save store find search filter sort render format "
    "extract detect resolve dispatch schedule initialize configure register authenticate authorize encrypt decrypt serialize deserialize normalize aggregate merge sync emit listen "
    "subscribe publish notify retry queue cache"
).split()

_ANCHOR = [re.compile(x) for x in ANCHORS]
_FILLER = [(k, re.compile(x)) for k, x in FILLER]
_LOOPS = [(re.compile(x), y) for x, y in LOOPS]


def _kept(line: str) -> bool:
    """Whether a line is an anchor, conditional expressions (a question mark, white space and later a colon, all behind a
    word's edge) included; in linear time, as lines may be very long."""
    if any(a.search(line) for a in _ANCHOR):
        return True
    word = re.search(r"\w", line)
    mark = word and re.compile(r"\?\s").search(line, word.start())
    return bool(mark) and ":" in line[mark.end():]


def _kind(line: str) -> str | None:
    """What a line of filler counts as; None: nothing of its own."""
    return next((k for k, x in _FILLER if x.search(line)), None)


def _compressed(lines: list[str]) -> list[str]:
    if len(lines) <= 2:
        return lines
    kinds = [_kind(x) for x in lines]
    n = Counter(kinds)
    out = []
    for k in ORDER:
        if not n[k]:
            continue
        hint = None
        if k == "LOOP":
            first = lines[kinds.index(k)]
            hint = next((m.expand(y) for x, y in _LOOPS if (m := x.search(first))), None)
        out.append(f"[{k}: {hint}]" if hint else f"[{k}: {n[k]} lines]" if n[k] > 1 else f"[{k}]")
    if not out:
        return [f"[... {len(lines)} lines ...]"]
    return [*out, f"[... {n[None]} lines ...]"] if n[None] > 2 else out


def summary_of(body: str | None, most: int = 3000) -> str:
    """A body of up to ``most`` characters as it is.  Of a longer one, lines that decide, call out, change state, fail,
    return or assert stay and runs of three or more others become tokens; if that is too long still, those lines and one
    token; if these are, their beginning.  None: empty."""
    body = body or ""
    if len(body) <= most:
        return body
    lines = [x.rstrip() for x in body.split("\n")]
    keep = [_kept(x) for x in lines]
    parts: list[str] = []
    for kept, run in groupby(zip(keep, lines), key=lambda x: x[0]):
        run = [x for _, x in run]
        parts += run if kept else _compressed(run)
    text = "\n".join(parts)
    if len(text) > most:
        rest = keep.count(False)
        text = "\n".join(x for k, x in zip(keep, lines) if k) + (f"\n[... {rest} lines of supporting code ...]" if rest else "")
    return text if len(text) <= most else text[:most] + "\n// ... truncated"


def summarize(body: Column, most: int = 3000) -> Column:
    """``summary_of`` as a column."""

    @pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield x.map(lambda b: summary_of(b, most))

    return F.when(F.length(body) <= most, body).otherwise(F.when(body.isNull(), "").otherwise(run(body)))


def name_phrase(name: Column) -> Column:
    """A descriptive name of two words or more as a phrase ("validateUserInput": "validates user input"); else null."""
    split = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(split, "_", " ")), r"\s+"), lambda x: x != "")
    first = F.get(words, F.lit(0))
    third = F.when(first.rlike("(s|sh|ch|x|z|o)$"), F.concat(first, F.lit("es"))).when(first.rlike("[^aeiou]y$"), F.regexp_replace(first, "y$", "ies")).otherwise(F.concat(first, F.lit("s")))
    verb = F.when(first.isin(*VERBS), third).otherwise(first)
    phrase = F.concat_ws(" ", verb, F.array_join(F.slice(words, 2, 1_000), " "))
    return F.when(descriptive_name(name) & (F.size(words) >= 2), phrase)


def embedding_texts(entities: DataFrame, justifications: DataFrame | None = None, most: int = 3000, variants: tuple[str, ...] = ("semantic", "code")) -> DataFrame:
    """(id, variant, key, text) of every entity but files and directories: one line each of what its kind is known by,
    of its justification (semantic variant), and its summarised body.

    Of the columns kind, name, file_path, signature, doc, parent, methods, exports, body, community_label those that are
    missing or null give no line.  The key of the code variant ends in ``::code``."""
    have = set(entities.columns)
    col = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    line = lambda label, x: F.when(F.length(x) > 0, F.concat(F.lit(label + ": "), x))
    kind, module = F.col("kind"), F.col("kind").isin("module", "namespace")
    label = F.when(module, "Module").otherwise(F.concat(F.upper(F.substring(kind, 1, 1)), F.substr(kind, F.lit(2))))
    methods, exports = col("methods", "array<string>"), col("exports", "array<string>")
    more = F.when(F.size(methods) > 15, F.concat(F.lit(" and "), (F.size(methods) - 15).cast("string"), F.lit(" more"))).otherwise("")
    of_class = kind.isin("class", "struct")
    parts = [
        F.concat(label, F.lit(": "), F.coalesce(col("name"), F.lit("unknown"))),
        line("File", col("file_path")),
        F.when(of_class, line("Extends", col("parent"))),
        F.when(of_class & (F.size(methods) > 0), F.concat(F.lit("Methods: "), F.array_join(F.slice(methods, 1, 15), ", "), more)),
        F.when(module & (F.size(exports) > 0), F.concat(F.lit("Exports: "), F.array_join(F.slice(exports, 1, 20), ", "))),
        F.when(~module, F.when(kind == "interface", line("Contract", col("signature"))).otherwise(line("Signature", col("signature")))),
        line("Documentation", col("doc")),
    ]
    meaning = [line("Community", col("community_label"))]
    x = entities.where(~kind.isin("file", "directory"))
    if justifications is not None:
        purpose = F.col("business_purpose") if "business_purpose" in justifications.columns else F.lit(None).cast("string")
        about = F.concat_ws("\n", line("Purpose", purpose), F.when(F.size("domain_concepts") > 0, F.concat(F.lit("Domain: "), F.array_join("domain_concepts", ", "))), line("Feature", F.col("feature_tag")))
        x = x.join(justifications.select(F.col("entity_id").alias("id"), about.alias("about_")), "id", "left")
        meaning = [F.when(F.length("about_") > 0, F.col("about_")), *meaning]
    body = F.when(~module & (F.length(col("body")) > 0), F.concat(F.lit("\n"), summarize(col("body"), most)))
    x = x.select("id", F.concat_ws("\n", *parts).alias("head"), F.concat_ws("\n", *meaning).alias("meaning"), body.alias("tail"))
    x = x.withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    code = F.col("variant") == "code"
    text = F.concat_ws("\n", "head", F.when(~code & (F.length("meaning") > 0), F.col("meaning")), "tail")
    return x.select("id", "variant", F.concat(F.col("id").cast("string"), F.when(code, "::code").otherwise("")).alias("key"), text.alias("text"))


def plain_key(key: Column) -> Column:
    """An embedding's key without its variant, so that variants of an entity merge."""
    return F.regexp_replace(key, "::code$", "")
