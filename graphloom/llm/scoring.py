"""Cross-entropy difference: target and background n-gram models over one vocabulary.

Both models are token bigram models with the same vocabulary (the public tokenizer's ids), the same smoothing and the
same order; the target model counts the target documents, the background model counts all documents.  A document's
score is its mean per-token loss under the target model minus that under the background model: low means target-like.
A document's own counts are left out of each model that holds them, so training documents are scored like others.

Counts are exact and cover every document: each block counts its n-grams, shards add the blocks' counts up and send
each block the totals of its own n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import materialise, maybe_broadcast, trimmed
from .tokens import encoder

MU_BIGRAM, ALPHA = 5.0, 0.1
BROADCAST_TARGETS = 200_000  # ids; some 80 bytes each once broadcast
COUNTS = B.sums(1, "<u4", lambda keys: B.mix64(keys.astype(np.uint64)))


def _keys(ids: np.ndarray, starts: np.ndarray, bos: int) -> tuple[np.ndarray, np.ndarray]:
    """Unigram keys (the id) and bigram keys ((id before + 1) * 65536 + id); ``bos`` stands before a document."""
    before = np.empty(len(ids), np.uint32)
    before[1:] = ids[:-1]
    before[starts[starts < len(ids)]] = bos
    return ids.astype(np.uint32), (before + np.uint32(1)) * np.uint32(65536) + ids


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 50257, bos: int = 50256, mu: float = MU_BIGRAM, alpha: float = ALPHA, block_bytes: int = B.BLOCK_BYTES, fan: int = B.FAN, bundle: int = B.BUNDLE, shards: int | None = None) -> DataFrame:
    """Per row: id, n_tokens, target_loss, background_loss and score.  ``target_ids``: the ids of target documents.

    Integer ids; ids that are no integers count as null.  Null or empty text has no tokens and null losses.  Without
    target documents the target model is uniform.  Repeated rows count as often as they occur."""
    ids = target_ids.select(F.expr(f"try_cast(`{target_ids.columns[0]}` as bigint)").alias("t_id_")).where("t_id_ is not null").distinct()
    ids = materialise(ids, "targets")
    marked = docs.select(F.expr(f"try_cast(`{id_col}` as bigint)").alias("id"), F.col(text_col).alias("text"))
    marked = marked.join(maybe_broadcast(ids.withColumn("t_", F.lit(True)), ids.count(), BROADCAST_TARGETS), F.col("id") == F.col("t_id_"), "left").select("id", "text", F.coalesce("t_", F.lit(False)).alias("target"))
    if vocabulary > 65_536:
        raise ValueError("token ids are kept in 16 bits: at most 65536 of them")
    shards = shards or B.shards_for(docs, text_col)
    _, groups = B.depth_and_fan(shards, fan)

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for docs_ in B.gather(batches, lambda r: len(r[1] or ""), block_bytes):
            block, seq = (pid << 24) + seq, seq + 1
            raw = []
            for at in range(0, len(docs_), 256):
                raw += enc.encode_many([r[1] for r in docs_[at : at + 256]])
            tok = np.frombuffer(b"".join(raw), "<u4").astype(np.uint32)
            sizes = np.array([len(x) // 4 for x in raw], np.int64)
            starts = np.cumsum(sizes) - sizes
            of = np.repeat(np.array([r[2] for r in docs_], bool), sizes)
            _, bi = _keys(tok, starts, bos)
            bi_keys, bi_n = np.unique(bi, return_counts=True)
            hit, hit_n = np.unique(bi[of], return_counts=True)
            bi_target = np.zeros(len(bi_keys), np.int64)
            bi_target[np.searchsorted(bi_keys, hit)] = hit_n
            uni_n, uni_target = (np.bincount(x, minlength=vocabulary) for x in (tok, tok[of]))
            words = np.flatnonzero(uni_n)
            keys = np.concatenate([words.astype(np.uint32), bi_keys])  # ids lie below any bigram's key
            all_n, target_n = np.concatenate([uni_n[words], bi_n]), np.concatenate([uni_target[words], bi_target])
            meta = np.array([[-1 if r[0] is None else r[0], r[0] is None, r[2], n] for r, n in zip(docs_, sizes)], "<i8")
            out = [(block, 0, -1, B.pack(tok.astype("<u2")), B.pack(meta), np.array([len(tok), int(of.sum())], "<i8").tobytes())]
            yield B.rows(out + COUNTS.send(block, [keys, all_n, target_n], groups))

    held = materialise(marked.mapInArrow(count, B.ROW), "ngrams")
    total, target_total = (x or 0 for x in held.where("kind = 0").select("c").agg(F.sum(_le(F.col("c"), 0)), F.sum(_le(F.col("c"), 8))).first())

    @trimmed
    def score(t: pa.Table) -> pa.Table:
        got = B.cells(t)
        own = next(r for r in got if r["kind"] == 0)
        tok, meta = B.unpack(own["a"], "<u2").astype(np.uint32), B.unpack(own["b"], "<i8").reshape(-1, 4)
        sizes = meta[:, 3]
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        starts = np.cumsum(sizes) - sizes
        uni, bi = _keys(tok, starts, bos)
        keys = np.concatenate([np.unique(uni), np.unique(bi)])  # as the block sent them
        counts = [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]  # target, background
        answers = {r["shard"]: COUNTS.given(r) for r in got if r["kind"] == -COUNTS.kind}
        for s, p in COUNTS.order(keys, groups):
            counts[1][p], counts[0][p] = answers[s]
        pairs, times = np.unique((doc << np.uint64(32)) | bi, return_counts=True)
        of, key = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        singles, own_uni = np.unique((doc << np.uint64(32)) | uni, return_counts=True)

        def own_count(w: np.ndarray) -> np.ndarray:
            x = (of.astype(np.uint64) << np.uint64(32)) | w
            at = np.minimum(np.searchsorted(singles, x), max(len(singles) - 1, 0))
            return np.where(singles[at] == x, own_uni[at], 0)

        losses = []
        word, before = key & np.uint32(0xFFFF), (key >> np.uint32(16)) - np.uint32(1)
        if len(pairs):
            at_bi, at_word = np.searchsorted(keys, key), np.searchsorted(keys, word)
            at_before = np.minimum(np.searchsorted(keys, before), len(keys) - 1)
            has_before = keys[at_before] == before
            own_word, own_before = own_count(word), own_count(before)
        for k, (c, whole) in enumerate(zip(counts, (target_total, total))):
            if not len(pairs):
                losses.append(np.zeros(len(sizes)))
                continue
            mine = meta[of, 2] if k == 0 else np.ones(len(of), np.int64)
            c2 = np.maximum(c[at_bi] - mine * times, 0)
            c1 = np.maximum(c[at_word] - mine * own_word, 0)
            cb = np.maximum(np.where(has_before, c[at_before], 0) - mine * own_before, c2)
            size = np.maximum(whole - mine * sizes[of], 0)
            p1 = (c1 + alpha) / (size + alpha * vocabulary)
            losses.append(np.bincount(of, -np.log((c2 + mu * p1) / (cb + mu)) * times, minlength=len(sizes)))
        some = sizes > 0
        per = [np.where(some, x / np.maximum(sizes, 1), 0) for x in losses]
        none = ~some
        return pa.table({
            id_col: pa.array(meta[:, 0], mask=meta[:, 1] == 1), "n_tokens": pa.array(sizes),
            "target_loss": pa.array(per[0], mask=none), "background_loss": pa.array(per[1], mask=none), "score": pa.array(per[0] - per[1], mask=none),
        })

    both = held.where("kind = 0").unionAll(COUNTS.ask(held, shards, fan, bundle))
    return both.groupBy("block").applyInArrow(score, f"`{id_col}` long, n_tokens long, target_loss double, background_loss double, score double")


def _le(c, at: int):
    """A little-endian unsigned 64-bit integer in a binary column."""
    hexed = F.hex(c)
    return F.conv(F.concat(*[F.substring(hexed, 2 * (at + 7 - k) + 1, 2) for k in range(8)]), 16, 10).cast("long")
