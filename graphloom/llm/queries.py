"""The thin opN_ queries: whole tables in, the contracts' columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BPE = "byte_bpe_50k.json"
PII_KEY = "graphloom-demo-key"  # a deployment passes its own
# The rules of the url query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    m = mix(_read(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    v = judge(_read(spark, sf_dir, "documents"))
    return v.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_digits, near_duplicates

    d = near_duplicates(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    d = pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, found_col="found")
    return d.select("doc_id", "text", F.size("found").alias("n_replaced"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    labels = _read(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    v = judge_urls(_read(spark, sf_dir, "pages"), bad, URL_RULES)
    return v.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_rate_low")})


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scoring import cross_entropy_difference

    good = _read(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return cross_entropy_difference(_read(spark, sf_dir, "documents"), good, tokenizer_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_spans

    d = repeated_spans(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a page of two media: the mark of its source, then, under a caption that names the document, its
    own text as a payload.  Marks and payloads are one table of stored media; measures come from that table's bytes."""
    from .common import materialise
    from .media import measured, resolve, sequences, store

    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("source "), F.coalesce("source", F.lit("unknown"))).alias("mark"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown"))
    page = F.concat(
        F.lit('<p>From <img src="sha256:'), digest("mark"), F.lit('" alt="mark"> of a corpus.</p><p>Document '), number, F.lit(':</p><figure><img src="sha256:'),
        digest("text"), F.lit('"><figcaption>payload of document '), number, F.lit("</figcaption></figure><p>End.</p>"),
    )
    pages = sequences(docs.select("doc_id", page.alias("html")))
    stored = materialise(store(docs.select("text"), "text").unionAll(store(docs.select("mark").distinct(), "mark")), "media", "zstd")
    found = resolve(pages, measured(stored))
    mine = found.where(F.col("caption") == F.concat(F.lit("payload of document "), number))
    return mine.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import clustered

    c = clustered(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")
    return c.withColumnRenamed("id", "vec_id")


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    labels = _read(spark, sf_dir, "labels")
    good, toxic = (labels.where(w).select(F.col("doc_id").alias("id")) for w in ("quality = 1", "toxic = 1"))
    return audit(_read(spark, sf_dir, "documents"), good, toxic)


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curve import curve_pack

    p = curve_pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return p.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
