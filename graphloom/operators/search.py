"""Vector, keyword and token search, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scalars as s


BLOCK = 4096  # query vectors that a task holds at once
CELLS = 1 << 20  # scores that a task holds at once


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors of that length as rows; each other one, and each with a null in it, counts as a zero vector by itself."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(a), width))
    sizes = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == width)
    if len(fits) and width:
        flat = a.take(pa.array(fits)).flatten()
        rows = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), width)
        rows[np.isnan(rows).any(axis=1)] = 0
        out[fits] = rows
    return out


def _cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of every query (rows) and vector (columns); 0 for zero norms and other lengths."""
    if not v.size or not q.size or v.shape[1] != q.shape[1]:
        return np.zeros((len(q), len(v)))
    nv, nq = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
    d = np.outer(nq, nv)
    return np.divide(q @ v.T, d, out=np.zeros_like(d), where=d > 0)


def _scan(vectors: DataFrame, queries: DataFrame, k: int | None, least: float | None, block: int) -> DataFrame:
    """(q_id, id, score) of a stated set of queries against all vectors, the best ``k`` of each batch or all above
    ``least``.  Up to ``block`` queries (counted) go along with the tasks; more are dealt into blocks of that size, and
    each block meets each part of the vectors in a task of its own."""
    id_type, q_type = vectors.schema["id"].dataType.simpleString(), queries.schema["q_id"].dataType.simpleString()
    schema = f"q_id {q_type}, id {id_type}, score double"

    def pick(ids: pa.Array, vs: pa.Array, qids: pa.Array, qs: pa.Array) -> Iterator[pa.RecordBatch]:
        """Batches for some queries each, so that no more than about ``CELLS`` scores stand at a time.  All are of one schema, those
        without a row too."""
        lengths = pc.fill_null(pc.list_value_length(qs), 0).to_numpy(zero_copy_only=False)
        step = max(1, CELLS // max(1, len(ids)))
        for n in np.unique(lengths).tolist():  # queries meet the vectors of their own length
            rows, v = np.flatnonzero(lengths == n), _matrix(vs, n)
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                c = _cosines(v, _matrix(qs.take(pa.array(some)), n))
                if k is not None and c.shape[1] > k:
                    cut = np.partition(c, -k, axis=1)[:, -k]  # ties with the k-th stay, to be told apart by id
                    at, col = np.nonzero(c >= cut[:, None])
                else:
                    at, col = np.nonzero(c > least) if least is not None else np.nonzero(np.ones_like(c, bool))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(some[at])), ids.take(pa.array(col)), pa.array(c[at, col])], names=["q_id", "id", "score"])

    n = queries.count()
    if n <= block:
        held = queries.select("q_id", "q").collect()
        qids, q = pa.array([r.q_id for r in held], to_arrow_type(queries.schema["q_id"].dataType)), pa.array([r.q for r in held], pa.list_(pa.float64()))

        def run(batches):
            for b in batches:
                if len(qids) and b.num_rows:
                    yield from pick(b.column(0), b.column(1), qids, q)

        return vectors.select("id", F.col("v").cast("array<double>")).mapInArrow(run, schema)
    blocks = -(-n // block)
    parts = max(1, vectors.count() // (16 * block))
    qs = queries.withColumn("q", F.col("q").cast("array<double>")).withColumn("qb", F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    vs = vectors.withColumn("v", F.col("v").cast("array<double>")).withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").combine_chunks()
        v, q = left.column("v").combine_chunks(), right.column("q").combine_chunks()
        qids = right.column("q_id").combine_chunks()
        out = [b for s in range(0, left.num_rows, 8192) for b in pick(ids.slice(s, 8192), v.slice(s, 8192), qids, q) if b.num_rows]
        return pa.Table.from_batches(out) if out else pa.table({"q_id": right.column("q_id").slice(0, 0), "id": left.column("id").slice(0, 0), "score": pa.array([], pa.float64())})

    return vs.select("qb", "vb", "id", "v").groupBy("qb", "vb").cogroup(qs.select("qb", "vb", "q_id", "q").groupBy("qb", "vb")).applyInArrow(meet, schema)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """For each query (q_id, q) the ``k`` nearest vectors (id, v) by cosine with their rank, ties by id; exact."""
    w = W.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return _scan(vectors, queries, k, None, block).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_above(vectors: DataFrame, queries: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(q_id, id, score) of all vectors closer to a query than ``least``."""
    return _scan(vectors, queries, None, least, block)


def keyword_score(name: Column, signature: Column, query: Column) -> Column:
    """len(query) / len(name) where name or signature holds the query, else null."""
    q = F.lower(query)
    return F.when(F.contains(F.lower(name), q) | F.contains(F.lower(signature), q), F.length(query) / F.length(name))


def keyword_search(entities: DataFrame, query: str, k: int) -> DataFrame:
    score = keyword_score(F.col("name"), F.col("signature"), F.lit(query))
    return entities.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def token_index(entities: DataFrame) -> DataFrame:
    """(token, id): the inverted index of names."""
    return entities.select("id", F.explode(F.array_distinct(s.split_identifier(F.col("name")))).alias("token"))


def token_search(index: DataFrame, query: str, k: int) -> DataFrame:
    """Ids by how many of the query's tokens their name has."""
    toks = s.query_tokens(F.lit(query))
    return index.where(F.array_contains(toks, F.col("token"))).groupBy("id").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def adaptive_k(legs: DataFrame, base: int = 30) -> DataFrame:
    """(k) from ranked legs (leg, id, rank from 0): the more their first ten agree, the smaller."""
    top = legs.where("rank < 10").groupBy("leg").agg(F.collect_set("id").alias("ids"))
    a, b = top.select(F.col("leg").alias("la"), F.col("ids").alias("a")), top.select(F.col("leg").alias("lb"), F.col("ids").alias("b"))
    mean = a.join(b, F.col("la") < F.col("lb")).agg(F.avg(s.jaccard(F.col("a"), F.col("b"))).alias("j"))  # a pair of legs each
    factor = F.greatest(F.lit(0.5), F.least(F.lit(2.0), 2.0 - 1.5 * F.col("j")))
    return mean.select(F.when(F.col("j").isNull(), base).otherwise(F.floor(base * factor + 0.5)).cast("long").alias("k"))


def fuse(legs: DataFrame, names: DataFrame, k: DataFrame, query_tokens: list[str], limit: int) -> DataFrame:
    """Weighted reciprocal rank fusion of (leg, id, rank, weight): sum of weight / (k + rank + 1); a name that is one
    of the query's tokens scores at least 1; ties by name, then id."""
    scored = legs.join(F.broadcast(k), how="left").groupBy("id").agg(F.sum(F.col("weight") / (F.col("k") + F.col("rank") + 1)).alias("score"))
    boost = F.lower("name").isin(*[t.lower() for t in query_tokens])
    out = scored.join(names, "id").withColumn("score", F.when(boost, F.greatest("score", F.lit(1.0))).otherwise(F.col("score")))
    return out.orderBy(F.desc("score"), "name", "id").limit(limit)


def drift(pairs: DataFrame) -> DataFrame:
    """(…, similarity, drift) from old and new hashes and vectors (old_hash, new_hash, old_v, new_v)."""
    c = s.cosine(F.col("old_v"), F.col("new_v"))
    sim = F.when(F.col("old_hash") == F.col("new_hash"), 1.0).otherwise(c)
    kind = F.when(F.col("old_hash") == F.col("new_hash"), "stable").when(c > 0.95, "cosmetic").when(c > 0.8, "refactor").otherwise("intent_drift")
    return pairs.withColumn("similarity", sim).withColumn("drift", kind)


def quantised(vectors: DataFrame) -> DataFrame:
    """(id, codes, scale): an index of every row at a byte per component, an eighth of the vectors' size.

    Nothing is fitted, so nothing is sampled.  Graph or cell indexes miss more of unclustered vectors at any cheaper
    setting; callers measure recall against the exact search."""
    top = F.greatest(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(1e-12))
    codes = F.transform("v", lambda x: F.round(x / top * 127).cast("tinyint"))
    return vectors.select("id", codes.alias("codes"), (top / 127).alias("scale"))


def quantised_top(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, widen: int = 4) -> DataFrame:
    """The ``k`` nearest by the index: the best ``widen`` * k by codes, ranked again by their exact cosine."""
    decoded = index.select("id", F.transform("codes", lambda c: c.cast("double")).alias("v"))
    rough = cosine_top(decoded, queries, widen * k).select("q_id", "id")
    exact = rough.join(vectors.select("id", "v"), "id").join(queries, "q_id").select("q_id", "id", s.cosine(F.col("v"), F.col("q")).alias("score"))
    w = W.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
