"""What the corpus operators share: materialising, word rules, checked broadcasts."""

from __future__ import annotations

import ctypes
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import lineage

# Fixed values of the corpus contracts: a word is a run without space, tab, \n, \v, \f or \r.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"


def materialise(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, lost executors recompute
    nothing above, and later reads of one plan see the same rows in the same files."""
    return lineage.materialise(df, tag, codec)


def maybe_broadcast(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Hint a broadcast only if the counted ``rows`` are within ``max_rows``; else leave the shuffled join."""
    return F.broadcast(df) if rows <= max_rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, letter case aside."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_RE), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though ``body`` uses it often or inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _trim() -> None:
    """Give freed memory back to the system: Python workers stay idle for a while, beside the next stage's work."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back is not None:
        back(0)


def trimmed(f):
    """A function of one Arrow table or of an iterator of batches that leaves no freed memory behind."""
    import inspect

    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def stream(batches):
            yield from f(batches)
            _trim()

        return stream

    @functools.wraps(f)
    def table(t):
        out = f(t)
        _trim()
        return out

    return table
