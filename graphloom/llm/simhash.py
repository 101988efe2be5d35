"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Equal fingerprints are one node from the start.  Nodes are dealt out by bands: of ``radius + 1`` bands of bits, two
fingerprints within the radius share at least one, so no link is lost.  Within buckets, sorted by population count,
tiles are compared with exclusive-or and bit counts, and tile pairs whose population counts differ by more than the
radius are skipped.  A bucket too large for one task is cut into tiles by population count and hash, and each
pair of its tiles is a task of its own: exact, and bounded.  Tasks emit spanning links only, never all pairs.
Components come from alternating large-star and small-star rounds over links, materialised in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import lineage
from .common import fresh, materialise, trimmed

BUCKET = 8192  # fingerprints of one band bucket compared within one task
TILE, SMALL = 256, 64  # fingerprints of a tile: of crowded buckets, of many buckets in turn


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of whole-text word shingles, repeats included; no word: 0."""
    import xxhash

    w = (text or "").encode().lower().split()  # bytes: A-Z only are lowered, ASCII white space only splits
    if not w:
        return 0
    if len(w) < width:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, extra: bool = False) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's bits as a signed long) of every row; ``extra`` adds text_hash."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps: list[int] = []
            for at in range(0, b.num_rows, 256):
                fps += [fingerprint(t, width, seed) for t in b.column(1).slice(at, 256).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype="<u8").view(np.int64))], names=[id_col, "fp"])
            if extra:
                yield pa.RecordBatch.from_arrays([*out.columns, b.column(2)], names=[id_col, "fp", "text_hash"])
            else:
                yield out

    more = [F.xxhash64(F.coalesce(text_col, F.lit("")))] if extra else []
    return docs.select(id_col, text_col, *more).mapInArrow(run, f"`{id_col}` {id_type}, fp long" + ", text_hash long" * extra)


def spanning_links(fps: np.ndarray, radius: int, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all of ``fps`` (unsigned, sorted by population count) that the radius connects.

    ``left``: only pairs of one before and one from that place on are compared."""
    pops = np.bitwise_count(fps)
    label = np.arange(len(fps))
    ends = [(0, len(fps))] if left is None else [(0, left), (left, len(fps))]
    for s, e in [ends[0]]:
        for i in range(s, e, TILE):
            i2 = min(i + TILE, e)
            js = range(i, e, TILE) if left is None else range(ends[1][0], ends[1][1], TILE)
            for j in js:
                j2 = min(j + TILE, ends[-1][1])
                if int(pops[j:j2].min()) - int(pops[i:i2].max()) > radius or int(pops[i:i2].min()) - int(pops[j:j2].max()) > radius:
                    continue
                a, b = np.nonzero(np.bitwise_count(fps[i:i2, None] ^ fps[None, j:j2]) <= radius)
                label = _joined(label, a + i, b + j)
    while (label[label] != label).any():
        label = label[label]
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def tile_links(run: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect, within each run of equal ``run`` (numbers from 0, ascending), what the radius connects.

    Rows stand by run and population count and are cut into tiles of ``SMALL`` rows.  Tiles meet themselves and the
    tiles after them while both hold rows of one run whose population counts lie within the radius."""
    order = np.lexsort((np.bitwise_count(fps), run))
    n, m = len(order), -(-len(order) // SMALL)
    x, r = np.zeros(m * SMALL, np.uint64), np.full(m * SMALL, -1, np.int64)
    x[:n], r[:n] = fps[order], run[order]
    label = np.arange(n)
    x, r = x.reshape(m, SMALL), r.reshape(m, SMALL)
    pops = np.bitwise_count(x).astype(np.int64)
    for d in range(m):
        i = np.arange(m - d)
        if d:
            i = i[(r[i, -1] == r[i + d, 0]) & (pops[i + d, 0] - pops[i, -1] <= radius)]
            if not len(i):
                break
        for s in range(0, len(i), 256):
            p = i[s : s + 256]
            near = (np.bitwise_count(x[p][:, :, None] ^ x[p + d][:, None, :]) <= radius) & (r[p][:, :, None] == r[p + d][:, None, :])
            t, a, b = np.nonzero(near)
            a, b = p[t] * SMALL + a, (p[t] + d) * SMALL + b
            some = (a < b) & (b < n)
            label = _joined(label, a[some], b[some])
    while (label[label] != label).any():
        label = label[label]
    at = np.flatnonzero(label != np.arange(n))
    fps = fps[order]
    return fps[at], fps[label[at]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): the smallest label of each end, until both agree."""
    while len(a):
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        label = label[label]
    return label


def _bucket_links(band: np.ndarray, key: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal (band, key)."""
    new = np.ones(len(fps), bool)
    new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
    return tile_links(np.cumsum(new) - 1, fps, radius)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_links(nodes: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct ``fp`` of ``nodes`` that connect whatever differs in ``radius`` bits or fewer."""
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    bands = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << (e - s)) - 1)).alias("key")) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    rows = nodes.select("fp", F.explode(F.array(*bands)).alias("x")).select("x.band", "x.key", "fp")
    hot = materialise(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "hot")

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 4 * bucket:
                continue
            t = pa.Table.from_batches(held)
            band, key = t.column("band").to_numpy(), t.column("key").to_numpy()
            cut = int(np.flatnonzero((band != band[-1]) | (key != key[-1]))[-1]) + 1 if (band[0], key[0]) != (band[-1], key[-1]) else 0
            if cut:
                yield _links(*_bucket_links(band[:cut], key[:cut], t.column("fp").to_numpy()[:cut].view(np.uint64), radius))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield _links(*_bucket_links(t.column("band").to_numpy(), t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64), radius))

    if not hot.head(1):
        return rows.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(compare, "a long, b long")
    plain = rows.join(hot.select("band", "key"), ["band", "key"], "left_anti").repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(compare, "a long, b long")
    # Tiles of a large bucket: by population count, then by hash into as many as its share needs.
    big = rows.join(hot.select("band", "key"), ["band", "key"]).withColumn("pop", F.bit_count("fp"))
    per = materialise(big.groupBy("band", "key", "pop").agg(F.ceil(F.count("*") / (bucket // 2)).cast("int").alias("m")), "tiles")
    tiles = big.join(per, ["band", "key", "pop"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    other = per.select("band", "key", F.col("pop").alias("pop2"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("sub2"))
    pairs = tiles.join(other, ["band", "key"]).where(F.abs(F.col("pop") - F.col("pop2")) <= radius)
    me, you = F.struct("pop", "sub"), F.struct(F.col("pop2").alias("pop"), F.col("sub2").alias("sub"))
    pairs = pairs.select("band", "key", F.least(me, you).alias("p"), F.greatest(me, you).alias("q"), (me <= you).alias("first"), "fp")
    pairs = pairs.select("band", "key", F.col("p.pop").alias("p1"), F.col("p.sub").alias("s1"), F.col("q.pop").alias("p2"), F.col("q.sub").alias("s2"), "first", "fp")

    @trimmed
    def tile_pair(t):
        fps, first = t.column("fp").to_numpy().view(np.uint64), t.column("first").to_numpy(zero_copy_only=False)
        one = (t.column("p1")[0].as_py(), t.column("s1")[0].as_py()) == (t.column("p2")[0].as_py(), t.column("s2")[0].as_py())
        a, b = spanning_links(fps, radius) if one else spanning_links(np.concatenate([fps[first], fps[~first]]), radius, int(first.sum()))
        return pa.Table.from_batches([_links(a, b)])

    return plain.unionAll(pairs.groupBy("band", "key", "p1", "s1", "p2", "s2").applyInArrow(tile_pair, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): alternating stars until nothing changes.

    Each round leaves the components as they are and hangs nodes on ever smaller neighbours; root: the smallest node."""
    e = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    state = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "large")
        lineage.release(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "small")
        lineage.release(large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v"), F.col("v")).distinct())
        state = now


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Per row: ``id_col``, fp and component_id, the smallest id of all rows that links of ``radius`` bits reach.

    Null text is an empty one (fingerprint zero).  Repeated rows fall into one component.  Null ids never name one."""
    fps = materialise(fingerprints(docs, id_col, text_col, width, seed), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(near_links(nodes, radius))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(placed.join(names, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, whole: the one with the smallest id (null ids last), of several texts with that id the
    one of the smallest fingerprint and hash, of repeated rows one.  Components never share a row, whatever their ids."""
    fps = fingerprints(docs, id_col, text_col, extra=True)
    fps = materialise(fps.withColumnsRenamed({id_col: "id"}), "simhash")
    roots = components(near_links(materialise(fps.select("fp").distinct(), "nodes"), radius))
    placed = fps.join(roots, F.col("fp") == F.col("node"), "left").select("id", "fp", "text_hash", F.coalesce("root", "fp").alias("root"))
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "text_hash")).alias("first"))
    return _only(docs, kept.select("first.id", "first.text_hash"), id_col, text_col)


def _only(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each (id, text_hash) of ``kept``."""
    hashed, kept_id, kept_hash = fresh(docs, "text_hash_", "kept_id_", "kept_hash_")
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    kept = kept.toDF(kept_id, kept_hash)
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(hashed) == F.col(kept_hash))
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, hashed]).drop(hashed)


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near copies by shingle similarity.  The links of a fixed small radius find what is all but equal; texts whose shingle
# sets overlap by ``similarity`` lie further apart in bits than bands of a fingerprint can promise.  So tiles are made
# of rows that share a band of min-hashes, are compared by exclusive-or and bit counts within a wide radius, and give a
# minimum spanning forest of links, nearest first; each link is then checked exactly on the whole shingle sets.

BANDS, ROWS = 16, 4  # a pair of similarity 0.8 shares a band with probability 0.9998, one of 0.9 with 1 - 1e-7
WIDE = 32  # bits: far above the distances of texts at similarity 0.8, short ones too (mean ten, seen up to thirty)
_MULTIPLIERS = np.random.default_rng(20).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; fewer words than ``width``: one of all of them."""
    import xxhash

    w = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*(w[k:] for k in range(width)))) if len(w) >= width else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8")


def text_node(text: str | None) -> int:
    """A hash of the lower-cased words: the same for copies."""
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()), 7)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, text_hash, node, fp, bands) of every row; text_hash: of the text as it is (null: empty); node: a hash of the
    lower-cased words, the same for copies."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            nodes, fps, bands = [], [], []
            for at in range(0, b.num_rows, 256):
                for t in b.column(1).slice(at, 256).to_pylist():
                    h = shingles(t, width)
                    ones = np.zeros(64, np.int64)
                    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
                    for s in range(0, len(h), 4096):
                        part = h[s : s + 4096]
                        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                        low = np.minimum(low, (part[:, None] * _MULTIPLIERS[None, :]).min(axis=0))
                    fps.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
                    raw = low.astype("<u8").tobytes()
                    bands.append([xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)])
                    nodes.append(text_node(t))
            flat = np.array(bands, np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(fps, np.int64)), lists], names=["id", "text_hash", "node", "fp", "bands"])

    return docs.select(id_col, text_col, F.xxhash64(F.coalesce(text_col, F.lit("")))).mapInArrow(run, f"id {id_type}, text_hash long, node long, fp long, bands array<long>")


def spanning_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a minimum spanning forest over the links within ``radius``: each group joins its nearest other
    group, round by round, over tiles sorted by population count."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    x, n = fps[order], len(fps)
    pops = np.bitwise_count(x).astype(np.int64)
    label = np.arange(n)
    out_a, out_b = [], []
    while True:
        best, mate = np.full(n, radius + 1), np.zeros(n, np.int64)
        for i in range(0, n, TILE):
            for j in range(0, n, TILE):
                if pops[j : j + TILE].min() - pops[i : i + TILE].max() > radius or pops[i : i + TILE].min() - pops[j : j + TILE].max() > radius:
                    continue
                d = np.bitwise_count(x[i : i + TILE, None] ^ x[None, j : j + TILE]).astype(np.int64)
                d[label[i : i + TILE, None] == label[None, j : j + TILE]] = radius + 1
                at = d.argmin(axis=1)
                low = d[np.arange(len(at)), at]
                nearer = np.flatnonzero(low < best[i : i + TILE])
                best[i + nearer], mate[i + nearer] = low[nearer], at[nearer] + j
        have = np.flatnonzero(best <= radius)
        if not len(have):
            break
        pick = have[np.lexsort((have, best[have], label[have]))]
        pick = pick[np.r_[True, label[pick][1:] != label[pick][:-1]]]  # the nearest of each group
        a, b = np.minimum(pick, mate[pick]), np.maximum(pick, mate[pick])
        a, b = np.unique(np.stack([a, b], 1), axis=0).T
        out_a.append(order[a])
        out_b.append(order[b])
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            top = np.arange(n)
            np.minimum.at(top, label[a], low)
            np.minimum.at(top, label[b], low)
            label = top[label]
            if (label == before).all():
                break
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _forest_links(key: np.ndarray, node: np.ndarray, fps: np.ndarray, radius: int) -> pa.RecordBatch:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a_out, b_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    two = starts[sizes == 2]
    two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius] if len(two) else two
    a_out.append(node[two])
    b_out.append(node[two + 1] if len(two) else node[two])
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        a, b = spanning_forest(fps[s : s + n], radius)
        a_out.append(node[s + a])
        b_out.append(node[s + b])
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def similar_links(nodes: DataFrame, radius: int = WIDE, bucket: int = BUCKET) -> DataFrame:
    """Distinct candidate links (a, b) between ``nodes`` (node, fp, bands).

    A band that more than ``bucket`` nodes share is cut into tiles, of which each pair is a task: the forests of all
    pairs hold the forest of the whole."""
    rows = nodes.select("node", "fp", F.explode("bands").alias("key"))
    big = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "big")

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 4 * bucket:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut:
                yield _forest_links(key[:cut], t.column("node").to_numpy()[:cut], t.column("fp").to_numpy()[:cut].view(np.uint64), radius)
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield _forest_links(t.column("key").to_numpy(), t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64), radius)

    deal = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    if not big.head(1):
        return deal(rows).distinct()
    crowd = rows.join(big.select("key"), "key").withColumn("pop", F.bit_count("fp"))
    per = materialise(crowd.groupBy("key", "pop").agg(F.ceil(F.count("*") / (bucket // 2)).cast("int").alias("m")), "tiles")
    tiles = crowd.join(per, ["key", "pop"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    other = per.select("key", F.col("pop").alias("pop2"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("sub2"))
    pairs = tiles.join(other, "key").where(F.abs(F.col("pop") - F.col("pop2")) <= radius)
    me, you = F.struct("pop", "sub"), F.struct(F.col("pop2").alias("pop"), F.col("sub2").alias("sub"))
    pairs = pairs.select("key", F.least(me, you).alias("p"), F.greatest(me, you).alias("q"), "node", "fp")

    @trimmed
    def tile_pair(t):
        node, fps = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        return pa.Table.from_batches([_forest_links(np.zeros(len(node), np.int64), node, fps, radius)])

    exact = pairs.select("key", "p.pop", "p.sub", F.col("q.pop").alias("pop2"), F.col("q.sub").alias("sub2"), "node", "fp").groupBy("key", "pop", "sub", "pop2", "sub2").applyInArrow(tile_pair, "a long, b long")
    return deal(rows.join(big.select("key"), "key", "left_anti")).unionAll(exact).where("a <> b").distinct()


GROUP, SHINGLES = 1024, 2_000_000  # texts of one candidate group compared within one task, and their shingles


def exact_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) of ``similarity`` or more that connect whatever such links connect.  Sets are bits over the shingles
    that two of them share; a text is compared only with texts it is not connected to yet."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    known, inv, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    width = -(-int((times > 1).sum()) // 64) * 8
    bits = np.zeros((n, max(width, 8)), np.uint8)
    at = 0
    for i, x in enumerate(sets):
        mine = inv[at : at + len(x)]
        at += len(x)
        mine = place[mine[times[mine] > 1]]
        np.bitwise_or.at(bits[i], mine >> 3, (1 << (mine & 7)).astype(np.uint8))
    rows = bits.view(np.uint64)
    label, out = np.arange(n), []
    for i in range(n - 1):
        rest = np.flatnonzero(label != label[i])
        rest = rest[rest > i]
        for s in range(0, len(rest), 256):
            part = rest[s : s + 256]
            both = np.bitwise_count(rows[part] & rows[i]).sum(axis=1, dtype=np.int64)
            for j in part[both >= similarity * (sizes[part] + sizes[i] - both)].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _exact(groups: DataFrame, similarity: float, group: int) -> DataFrame:
    """Links (a, b) among the members (root, node, s) of each candidate group; a group above ``group`` texts or
    ``SHINGLES`` shingles is cut into tiles, and each pair of its tiles is a task."""
    share = F.greatest(F.count("*") / group, F.sum(F.size("s")) / SHINGLES)
    big = materialise(groups.groupBy("root").agg(share.alias("share")).where("share > 1").select("root", F.ceil(F.col("share") * 2).cast("int").alias("m")), "large")

    def linked(t: pa.Table) -> pa.RecordBatch:
        node = t.column("node").to_numpy()
        sets = [np.asarray(x) for x in t.column("s").combine_chunks().to_numpy(zero_copy_only=False)]
        ij = exact_links(sets, similarity) if len(sets) > 1 else []
        a, b = node[[i for i, _ in ij]], node[[j for _, j in ij]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    @trimmed
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            root = t.column("root").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(root)) + 1]
            for s, e in zip(cuts, cuts[1:]):
                yield linked(t.slice(s, e - s))
            held = t.slice(cuts[-1])
        if held is not None:
            yield linked(held)

    deal = lambda df: df.repartition("root").sortWithinPartitions("root").mapInArrow(runs, "a long, b long")
    if not big.head(1):
        return deal(groups)
    x = groups.join(big, "root").withColumn("t", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("root", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), "node", "s")
    tiles = x.groupBy("root", "t1", "t2").applyInArrow(lambda t: pa.Table.from_batches([linked(t)]), "a long, b long")
    return deal(groups.join(big.select("root"), "root", "left_anti")).unionAll(tiles)


def _placed(docs: DataFrame, similarity: float, width: int, id_col: str, text_col: str, radius: int, bucket: int, group: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and (node, least, root): each node's smallest id and the component it is in."""
    rows = materialise(sketches(docs, id_col, text_col, width), "sketches")
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("lead")
    nodes = rows.groupBy("node").agg(lead, F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.select("node", F.col("lead.id").alias("least"), F.col("lead.text_hash").alias("hash"), "fp", "bands"), "nodes")
    links = materialise(similar_links(nodes, radius, bucket), "candidates")
    ends = links.select(F.col("a").alias("end_")).unionAll(links.select("b")).distinct()
    ends = materialise(ends.join(nodes.select(F.col("node").alias("end_"), "least", "hash"), "end_"), "ends")

    @trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # of repeated rows a task hashes one
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                new = {n: t for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if n not in known}
                got = [t for n, t in new.items() if n == np.array([text_node(t)], np.uint64).view(np.int64)[0]]
                nodes_ = np.array([text_node(t) for t in got], np.uint64).view(np.int64)
                known.update(nodes_.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(nodes_), pa.array([np.unique(shingles(t, width)).view(np.int64) for t in got], pa.list_(pa.int64()))], names=["node", "s"])

    # The rows of each candidate text that are its first by id and hash; other texts of that id have other hashes.
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("t_"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h_"))
    texts = texts.join(ends, F.col("id_").eqNullSafe(F.col("least")) & (F.col("h_") == F.col("hash"))).select("end_", "t_")
    s = texts.mapInArrow(sets, "node long, s array<long>").dropDuplicates(["node"])
    groups = components(links).join(s, "node").select("root", "node", "s")
    true = _exact(materialise(groups, "groups", "zstd"), similarity, group)
    roots = components(true)
    placed = nodes.select("node", "least").join(roots.withColumnRenamed("node", "r_"), F.col("node") == F.col("r_"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return rows, materialise(placed, "placed")


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", radius: int = WIDE, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """Per row: id, node (equal for copies, letter case and white space aside) and component_id, the smallest id of all
    rows that links of ``similarity`` (Jaccard, over sets of ``width``-word shingles) reach.

    Null and empty texts are copies of each other.  Texts shorter than ``width`` words link only to copies."""
    rows, placed = _placed(docs, similarity, width, id_col, text_col, radius, bucket, group)
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("id", "node").join(placed.join(names, "root").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "node", "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, whole: the one with the smallest id (null ids last), of several texts
    with that id the one of the smallest node and hash, of repeated rows one.  Components never share a row, whatever
    their ids."""
    rows, placed = _placed(docs, similarity, width, id_col, text_col, WIDE, BUCKET, GROUP)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node", "text_hash")
    firsts = rows.groupBy("node").agg(F.min(order).alias("first"))
    kept = firsts.join(placed.select("node", "root"), "node").groupBy("root").agg(F.min("first").alias("first"))
    return _only(docs, kept.select("first.id", "first.text_hash"), id_col, text_col)
