"""Centroid clustering of integer vectors with exact results from fast float32 products.

A vector's distance to centroid c, less the part all centroids share, is |c|^2 - 2 x.c.  A float32 matrix product gives x.c
with an error of at most g |x||c|, where g bounds the rounding of the operands and of the sum in any order.  So each
centroid has an interval; those whose lower end lies above the least upper end are out.  Where more than one is left,
the distances of these are computed in exact integers and the lowest number wins ties.

A task sends one row a cluster and component on, whatever its number of vectors: sums are exact integers in limbs.  The
centroids of a round are k vectors; they travel with the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed

#: Components up to this size give squared distances within a long: 64 * (2 * 2^27)^2 = 2^62; larger ones go by Python's integers.
NARROW = 1 << 27
LIMB = 60  # bits of a partial sum that one row carries
ROWS = 4096  # vectors in one matrix product
U32 = 2.0**-24  # half a unit in the last place of float32
U64 = 2.0**-53


def integers(x: np.ndarray, scale: int) -> np.ndarray | list[list[int]]:
    """floor(scale * x), exactly: an int64 matrix where all components are narrow, else lists of Python's integers.
    ``scale`` is a power of two, so the product of doubles is exact unless it overflows."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if v.size == 0 or np.abs(v).max() <= NARROW:
        return v.astype(np.int64)
    return [[math.floor(Fraction(float(c)) * scale) for c in row] for row in x]


def screened(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), and how many rows needed exact distances.

    Both are int64 matrices of components up to NARROW and equally many columns, at most 64 for the bounds of a long."""
    d = x.shape[1]
    x32, c32 = x.astype(np.float32), centroids.astype(np.float32)
    dot = (x32 @ c32.T).astype(np.float64)
    # Operands carry one rounding each, a sum of d products at most d more on any path: (1 + u)^(d + 2) - 1.
    n = d + 4
    g = n * U32 / (1 - n * U32)
    norm_x = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    square = (centroids.astype(np.float64) ** 2).sum(1)  # below 2^60: rounded by at most d + 1 units of 2^-53
    norm_c = np.sqrt(square) * (1 + 1e-9)
    score = square[None, :] - 2 * dot
    slack = 2 * g * norm_x[:, None] * norm_c[None, :]
    slack += 4 * (d + 4) * U64 * (square[None, :] + 2 * np.abs(dot) + slack)  # the doubles' own rounding
    upper = (score + slack).min(1)
    near = score - slack <= upper[:, None]
    best = np.argmin(score, 1)
    close = np.flatnonzero(near.sum(1) > 1)
    if len(close):
        exact = np.full((len(close), len(centroids)), np.iinfo(np.int64).max)
        for k in range(len(centroids)):
            rows = np.flatnonzero(near[close, k])
            diff = x[close[rows]] - centroids[k]
            exact[rows, k] = (diff * diff).sum(1)
        best[close] = np.argmin(exact, 1)  # argmin takes the first of equals
    return best, len(close)


def assigned(vectors: np.ndarray | list, centroids: list[list[int]]) -> tuple[list[int], list[int], np.ndarray | list]:
    """Cluster and squared distance of each vector, and the vectors as given."""
    small = all(abs(c) <= NARROW for row in centroids for c in row)
    if isinstance(vectors, np.ndarray) and small and vectors.shape[1] <= 64:
        c = np.array(centroids, np.int64)
        best, _ = screened(vectors, c)
        diff = vectors - c[best]
        return best.tolist(), (diff * diff).sum(1).tolist(), vectors
    best, dist = [], []
    for row in vectors.tolist() if isinstance(vectors, np.ndarray) else vectors:
        of = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids]
        best.append(of.index(min(of)))
        dist.append(min(of))
    return best, dist, vectors


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(-1, dims)


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray | list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            yield b, integers(_matrix(b.column(b.num_columns - 1), dims), scale)


def _limbs(s: int) -> list[int]:
    """Signed digits of base 2^LIMB, lowest first; all but the last are not negative."""
    out = []
    while not -(1 << LIMB) < s < (1 << LIMB):
        out.append(s & ((1 << LIMB) - 1))
        s >>= LIMB
    return [*out, s]


def _sums(centroids: list[list[int]], dims: int, scale: int):
    """One round in one task: how many vectors each cluster has (position -1) and their sum by component."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total, count = [[0] * dims for _ in range(k)], [0] * k
        for _, vectors in _chunks(batches, dims, scale):
            best, _, _ = assigned(vectors, centroids)
            mine = np.array(best)
            for j in range(k):
                at = np.flatnonzero(mine == j)
                if len(at) == 0:
                    continue
                count[j] += len(at)
                part = vectors[at].sum(0).tolist() if isinstance(vectors, np.ndarray) else [sum(vectors[i][p] for i in at) for p in range(dims)]
                total[j] = [a + b for a, b in zip(total[j], part)]
        rows = [(j, p, i, v) for j in range(k) if count[j] for p, s in enumerate(total[j]) for i, v in enumerate(_limbs(s))]
        rows += [(j, -1, 0, count[j]) for j in range(k) if count[j]]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "pos", "limb", "value"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: str, dims: int, scale: int) -> list[list[int]]:
    """The integer vectors of the ``k`` smallest lowercase-hex sha256 of ``seed``:id, ascending; equal ids by their
    components, null ids last.  Fewer vectors give fewer centroids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    top = vectors.orderBy(key.asc_nulls_last(), "vector").limit(k).collect()
    if not top:
        return []
    v = integers(np.array([r["vector"] for r in top], np.float64), scale)
    return v.tolist() if isinstance(v, np.ndarray) else v


def usable(rows: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """Columns id and vector (doubles) of the rows whose vector has ``dims`` components, none of them null or not finite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) == dims) & finite).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("vector"))


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Lloyd's rounds in exact integers floor(scale * x): columns id, cluster and distance (squared), and the centroids.

    Vectors that are null, of another length, or hold nulls, NaN or infinities are left out.  Repeated rows count as often
    as they come; ids may be null or equal; other columns are left aside, whatever their names.  A round sends each vector
    to its nearest centroid (ties: the smaller number) and takes a cluster's floor of sum by count; an empty cluster keeps its
    centroid.  An empty table gives an empty one and no centroids.  Components beyond NARROW are exact too, by Python's
    integers; a distance beyond a long is null.  ``dims`` of at most 64 take the fast way."""
    vectors = materialise(usable(rows, id_col, vector_col, dims), "vectors", "zstd")
    centroids = first_centroids(vectors, k, seed, dims, scale)
    only = vectors.select("vector")
    for _ in range(rounds if centroids else 0):
        part = only.mapInArrow(_sums(centroids, dims, scale), "cluster int, pos int, limb int, value long")
        # At most k * (dims + 1) * limbs rows come to the driver, however many tasks there are.
        total = part.groupBy("cluster", "pos", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        sums: dict[tuple[int, int], int] = {}
        for r in total:
            at = (r["cluster"], r["pos"])
            sums[at] = sums.get(at, 0) + (int(r["value"]) << (LIMB * r["limb"]))
        centroids = [[sums[j, p] // sums[j, -1] for p in range(dims)] if (j, -1) in sums else c for j, c in enumerate(centroids)]

    @trimmed
    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v in _chunks(batches, dims, scale):
            best, dist, _ = assigned(v, centroids)
            dist = [x if x < 1 << 63 else None for x in dist]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(dist, pa.int64())], names=["id", "cluster", "distance"])

    id_type = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(last, f"id {id_type}, cluster int, distance long"), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(rows: DataFrame, **how) -> DataFrame:
    """``cluster`` with each row's cluster_inertia, the inertia of all and the centroid_sha256: sums of distances, null
    where one of them is null or the sum is beyond a long."""
    found, centroids = cluster(rows, **how)
    found = materialise(found, "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("*") - F.count("distance")).alias("lost")).collect()
    most = Decimal((1 << 63) - 1)
    of = {r["cluster"]: None if r["lost"] or r["s"] > most else int(r["s"]) for r in sums}
    whole = None if None in of.values() or sum(of.values()) > most else sum(of.values())
    spark = rows.sparkSession
    table = [(j, of.get(j), whole, digest(c)) for j, c in enumerate(centroids)]
    per = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
