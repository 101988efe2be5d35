"""Packing along a space-filling curve: like documents share sequences, and no sequence is padded.

A document's token ids are hashed into buckets; the vector of the square roots of its counts, of length one, is projected to a few
dimensions by a fixed matrix of signs.  Each dimension is spread evenly by the normal curve of its mean and deviation over
all documents, cut into cells, and the cell's place on the Hilbert curve is the document's key.  Rows are range-sorted by
key and row number, so copies spread over partitions, and each partition's ids, end to end, are cut into sequences of the
capacity.  What is left at a partition's end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed
from .wordends import word_ends

BUCKETS = 256  # of the hashed document vectors
DIMS = 4
BITS = 15  # of a dimension: DIMS * BITS < 63
FIXED = 1 << 20  # projections are whole multiples of 1/FIXED, so sums over all documents are exact
CHUNK = 4096  # texts encoded at once
CHUNK_BYTES = 32 << 20  # unless these bytes are fewer texts


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Whole numbers hashed to 64 bits: multiplications and shifts of the splitmix64 generator."""
    z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signs(dims: int = DIMS, buckets: int = BUCKETS) -> np.ndarray:
    """The projection: +1 or -1 by hash of bucket and dimension."""
    b = _mixed(np.arange(buckets * dims), 7) & np.uint64(1)
    return (b.astype(np.float64) * 2 - 1).reshape(buckets, dims)


def projections(ids: np.ndarray, cuts: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Fixed-point projections of documents whose ids stand end to end; document k's from cuts[k] to cuts[k + 1].
    A document without ids is at the origin."""
    n = len(cuts) - 1
    bucket = (_mixed(np.arange(65536 if ids.dtype.itemsize == 2 else int(ids.max(initial=0)) + 1), 3) % np.uint64(BUCKETS)).astype(np.int64)
    doc = np.repeat(np.arange(n) * BUCKETS, np.diff(cuts))
    v = np.sqrt(np.bincount(doc + bucket[ids], minlength=n * BUCKETS).reshape(n, BUCKETS))
    length = np.sqrt((v * v).sum(1))
    p = (v @ signs(dims)) / np.where(length > 0, length, 1)[:, None]
    return np.rint(p * FIXED).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells (n x dims, each from 0 to 2^bits - 1), below 2^(dims * bits).

    The cells' bits are brought into the curve's order as Skilling describes ("Programming the Hilbert curve", 2004):
    from the highest bit down, each set bit mirrors the lower bits of the first axis and each clear bit swaps them with it;
    then the Gray code is undone and the axes' bits are interleaved."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in range(dims):
            up = (x[axis] >> b) & 1 == 1
            differ = np.where(up, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(up, low, differ)
            x[axis] ^= differ
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((x[axis] >> b) & 1)
    return key


def cells(points: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Points to cells: each dimension spread evenly by a logistic stand-in for its normal curve; deviation 0: one cell."""
    z = ((points - mean) / np.where(deviation > 0, deviation, 1)).clip(-30, 30)
    return np.minimum((1 / (1 + np.exp(-1.702 * z)) * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def encoded(docs: DataFrame, path: str, separator: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, row (a number of its own for each row), tokens (how many, with the separator), ids (their bytes) and point."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = word_ends(path)
        row = TaskContext.get().partitionId() << 40
        sep = np.array([separator], enc.dtype)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                b = batch.slice(at, CHUNK)
                while b.num_rows > 1 and b.get_total_buffer_size() and b.nbytes > CHUNK_BYTES:
                    b = b.slice(0, b.num_rows // 2)
                at += b.num_rows
                n = b.num_rows
                raw = enc.encode(b.column(1))
                cuts = np.frombuffer(raw.buffers()[1], "<i4", n + 1) // enc.dtype.itemsize if raw.buffers()[1] else np.zeros(n + 1, np.int64)
                ids = np.frombuffer(raw.buffers()[2], enc.dtype, cuts[-1]) if cuts[-1] else np.zeros(0, enc.dtype)
                points = projections(ids, cuts)
                full = np.insert(ids, cuts[1:], sep[0])
                ends = cuts + np.arange(n + 1)
                col = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * enc.dtype.itemsize).astype("<i4")), pa.py_buffer(full)])
                point = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), points.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(row + np.arange(n)), pa.array(np.diff(ends).astype(np.int64)), col, point], names=["id", "row", "tokens", "ids", "point"])
                row += n

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, row long, tokens long, ids binary, point array<long>")


def keyed(points: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """``points`` with their ``key`` on the curve, from the mean and deviation of each dimension over all rows."""
    p = [F.col("point")[k].cast("decimal(38,0)") for k in range(dims)]
    # Exact sums of whole numbers, one row: the same whatever the order of adding.
    s = points.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(p)], *[F.sum(F.col("point")[k] * F.col("point")[k].cast("decimal(19,0)")).alias(f"q{k}") for k in range(dims)]).first()
    n = max(s["n"], 1)
    mean = np.array([float(s[f"s{k}"] or 0) / n for k in range(dims)])
    square = np.array([float(s[f"q{k}"] or 0) / n for k in range(dims)])
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))

    @F.pandas_udf("long")
    def key(point):
        import pandas as pd

        return pd.Series(hilbert(cells(np.stack(point.to_numpy()), mean, deviation, bits), bits))

    return points.withColumn("key", key("point"))


def _cut(start: int, capacity: int, total: int, tail: bool) -> list[int]:
    """Where sequences end among ``total`` ids laid end to end, from ``start`` on; with ``tail`` the rest at powers of two."""
    ends = list(range(start + capacity, total + 1, capacity))
    at = ends[-1] if ends else start
    while tail and at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    return ends


def pack_along(items: DataFrame, width: int, capacity: int = 2048) -> DataFrame:
    """Sorted partitions of (id, row, tokens, ids) cut into pieces: columns id, row, start, length, ids_crc32, doc_tokens,
    sequence_id and offset.  ``width``: bytes of an id.  A task holds an Arrow batch and less than one sequence."""
    id_type = items.schema["id"].dataType.simpleString()
    names = ["id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        dtype = np.dtype(f"<u{width}")
        seq = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # id, row, tokens, ids, first id not yet placed: the documents of the unfinished sequence
        waiting = 0

        def pieces(tail: bool) -> pa.RecordBatch:
            nonlocal held, waiting, seq
            out = {n: [] for n in names}
            ends = _cut(0, capacity, waiting, tail)
            k, begin, at = 0, 0, 0  # the sequence being filled, where it begins, and the ids placed so far
            rest = []
            for doc, row, tokens, ids, done in held:
                b = memoryview(ids)
                while done < tokens and k < len(ends):
                    take = min(tokens - done, ends[k] - at)
                    out["id"].append(doc)
                    out["row"].append(row)
                    out["start"].append(done)
                    out["length"].append(take)
                    out["ids_crc32"].append(zlib.crc32(np.frombuffer(b[done * width : (done + take) * width], dtype).astype("<u4").tobytes()))
                    out["doc_tokens"].append(tokens)
                    out["sequence_id"].append(seq + k)
                    out["offset"].append(at - begin)
                    done += take
                    at += take
                    if at == ends[k]:
                        k, begin = k + 1, at
                if done < tokens:
                    rest.append((doc, row, tokens, ids, done))
            held, waiting, seq = rest, waiting - at, seq + k
            return pa.RecordBatch.from_arrays([pa.array(out["id"], id_arrow), *[pa.array(out[n], pa.int64()) for n in names[1:]]], names=names)

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                rows = list(zip(*[b.column(k).to_pylist() for k in range(4)], [0] * b.num_rows))
                held += rows
                waiting += sum(r[2] for r in rows)
                yield pieces(False)
        if held:
            yield pieces(True)

    schema = f"id {id_type}, " + ", ".join(f"{n} long" for n in names[1:])
    return items.select("id", "row", "tokens", "ids").mapInArrow(run, schema)


def curve_pack(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ids and ``separator``, each id in exactly one piece, documents in the curve's order end to end.

    Sequences hold ``capacity`` ids but for the last few of each partition, which hold powers of two.  Columns as in
    ``pack_along``, with the row's ``key``.  Null and empty texts are the separator alone.  Repeated rows and equal or null ids
    are documents of their own; an empty table gives an empty one; other columns are left aside, whatever their names.
    The result is written down: a second reading, or a lost executor, sees the same sequences."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    found = materialise(encoded(docs, path, separator, id_col, text_col), "tokens", "zstd")
    points = keyed(found)
    width = word_ends(path).dtype.itemsize
    ordered = points.select("id", "row", "tokens", "ids", "key").repartitionByRange(F.col("key"), F.col("row")).sortWithinPartitions("key", "row")
    return materialise(pack_along(ordered, width, capacity), "packed", "zstd")
