"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules judge a text by itself.  The method judges it against its host's other documents: lines are normalised
and hashed, the distinct documents that hold each line are counted per host, lines held by more than ``share`` of
the host's documents (and more than ``min_docs``) go, and a document of which more than ``max_removed`` of the
characters went is depleted and rejected.  Documents count as distinct by the hash of their whole text, for a line's
holders and for the host's size, so exact copies of one document, and only these, do not make its lines look like
boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, let, materialise, maybe_broadcast, words

WINDOW = 8
MIN_DOCS, SHARE, MAX_REMOVED = 10, 0.10, 0.7
BROADCAST_ROWS = 200_000  # boilerplate lines, of 16 bytes and the host's name each


def line_hash(line: Column) -> Column:
    """Hash of the normalised line: ASCII lower case, digit runs as 0, white space as one space, trimmed."""
    flat = F.regexp_replace(F.regexp_replace(ascii_lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.trim(flat))


def text_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _covered(wins: Column) -> Column:
    """Words in windows whose hash occurs twice or more: hashes sorted with their places, then the union of spans."""

    def spans(p: Column) -> Column:
        widths = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW)))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    def found(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), spans)

    placed = F.transform(wins, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), found))


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: the base measures, its text's hash and its lines' hashes and lengths.  Null text: empty."""
    a = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(text_col, F.lit("")).alias("t"))
    b = a.select("id", "host", "t", words(F.col("t")).alias("w"))
    c = b.select("id", "host", "t", "w", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("hs"))
    h = F.col("hs")
    wins = F.when(F.size(h) >= WINDOW, let(h, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(WINDOW)])))).otherwise(F.array().cast("array<bigint>"))
    d = c.select("id", "host", "t", "w", "n_words", wins.alias("wins"), text_lines(F.col("t")).alias("l"))
    symbols = F.length(F.array_join(F.regexp_extract_all("t", F.lit("[#*$%&|<>]+"), F.lit(0)), ""))
    return d.select(
        "id", "host", F.xxhash64("t").alias("text_hash"), "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("wins")).alias("n_repeat_words"),
        F.transform("l", lambda x: F.struct(line_hash(x).alias("h"), F.length(x).alias("c"))).alias("lines"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, share: float = SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Per row of ``docs``: id, host, text_hash, the measures, base_failed, boilerplate (line hashes to remove),
    removed_chars and kept.  A null host is a host of its own; repeated rows are judged alike; no rows give no rows."""
    rows = materialise(measures(docs, id_col, host_col, text_col).withColumn("row", F.monotonically_increasing_id()), "quality", "zstd")
    held = rows.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    often = held.groupBy("host", "h").agg(F.count_distinct("text_hash").alias("n")).where(F.col("n") > min_docs)
    sizes = rows.groupBy(F.col("host").alias("host_of")).agg(F.count_distinct("text_hash").alias("docs"))
    above = often.join(sizes, F.col("host").eqNullSafe(F.col("host_of")) & (F.col("n") > share * F.col("docs"))).select(F.col("host").alias("b_host"), F.col("h").alias("b_h"))
    above = materialise(above, "boilerplate")
    lines = rows.where(F.size("lines") > 0).select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.c").alias("c"))
    hit = lines.join(maybe_broadcast(above, above.count(), BROADCAST_ROWS), F.col("host").eqNullSafe(F.col("b_host")) & (F.col("h") == F.col("b_h")))
    gone = hit.groupBy("row").agg(F.sum("c").alias("removed_chars"), F.collect_set("h").alias("boilerplate"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.join(gone, "row", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0).cast("long")))
    return out.select("id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.coalesce("boilerplate", F.array().cast("array<bigint>")).alias("boilerplate"), "removed_chars", (~base & (F.col("removed_chars") <= max_removed * total)).alias("kept"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", length_col: str | None = "n_chars", **limits) -> DataFrame:
    """``docs`` without rejected rows; the kept rows' boilerplate lines are taken out of the text (and their length
    column follows).  All other columns stay as they are, whatever their names."""
    v = judge(docs, id_col, host_col, text_col, **limits)
    v_id, v_host, v_hash, v_lines = fresh(docs, "v_id_", "v_host_", "v_hash_", "v_lines_")
    v = v.where("kept").groupBy(F.col("id").alias(v_id), F.col("host").alias(v_host), F.col("text_hash").alias(v_hash)).agg(F.first("boilerplate").alias(v_lines))
    text = F.coalesce(F.col(text_col), F.lit(""))
    j = docs.join(v, F.col(id_col).eqNullSafe(F.col(v_id)) & F.col(host_col).eqNullSafe(F.col(v_host)) & (F.xxhash64(text) == F.col(v_hash)))
    clean = F.when(F.size(v_lines) == 0, F.col(text_col)).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col(v_lines), line_hash(x))), "\n"))
    new = {text_col: clean}
    if length_col and length_col in docs.columns:
        new[length_col] = F.when(F.size(v_lines) == 0, F.col(length_col)).otherwise(F.length(clean).cast(docs.schema[length_col].dataType))
    return j.withColumns(new).select(*docs.columns)
