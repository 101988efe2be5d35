"""Pluggable model calls with deterministic stand-ins: the engine itself never calls a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 32


def hash_vectors(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Unit vectors of hashed words: equal texts, equal vectors."""
    import xxhash

    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dims] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], np.ndarray] | None = None, batch: int = 250) -> DataFrame:
    """(id, embedding) by ``model`` in batches; without one, hashed words."""
    call = model or hash_vectors

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), batch):
                q = p.iloc[at : at + batch]
                yield pd.DataFrame({"id": q["id"], "embedding": list(np.asarray(call(q[text_col].tolist()), dtype=float))})

    return df.select("id", text_col).mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, embedding array<double>")


def process_batches(df: DataFrame, call: Callable[[list[str]], list[str]], text_col: str, size: int = 8, rounds: int = 2, fatal: int = 5) -> DataFrame:
    """(id, result) by a batch call that may fail: a failing batch is halved up to ``rounds`` times, single failures
    give null, and after ``fatal`` single failures in a task the call is not tried again there."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0

        def solve(texts: list[str], left: int) -> list[str | None]:
            nonlocal failed
            if failed >= fatal:
                return [None] * len(texts)
            try:
                return list(call(texts))
            except Exception:
                if len(texts) > 1 and left > 0:
                    half = len(texts) // 2
                    return solve(texts[:half], left - 1) + solve(texts[half:], left - 1)
                if len(texts) == 1:
                    failed += 1
                    return [None]
                return [x for t in texts for x in solve([t], 0)]

        for p in parts:
            for at in range(0, len(p), size):
                q = p.iloc[at : at + size]
                yield pd.DataFrame({"id": q["id"], "result": solve(q[text_col].tolist(), rounds)})

    return df.select("id", text_col).mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, result string")


def rerank(df: DataFrame, score: Column | None = None, k: int = 10) -> DataFrame:
    """Rows in order of a second score (none: the first one's), best ``k``."""
    return df.withColumn("rerank_score", score if score is not None else F.col("score")).orderBy(F.desc("rerank_score"), "id").limit(k)
