"""Best-fit packing of pieces into sequences: hierarchical residual packing.

Each partition packs its own pieces best-fit, longest first, and emits the bins that are (nearly) full.  What is
underfull goes up a tree: a node takes the underfull bins of up to ``fan`` nodes below it as items, packs them
best-fit again, emits what is now full, and hands on the rest.  A node hands on at most ``keep`` bins, the emptiest
ones, and emits the others as sequences: so no task's input grows with the corpus, and no piece is ever dropped.

That bound costs no sequence while a node gets at most ``keep`` bins that are at most half full.  Best fit leaves one
such bin a node, as two of them would fit together, so ``fan`` of them meet.  All other bins are more than half full
and only a bin at most half full can join them; where one fits into any bin, it fits into the emptiest ones, and these
are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed
from .tokens import token_pieces

CHUNK = 1_000_000  # items that one leaf of the tree packs at once


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing for whole sizes of 1..capacity: the bin and offset of each item, and each bin's fill.

    Open bins stand in stacks by free space; a bit mask of the stacks in use finds the tightest one that fits."""
    n = len(sizes)
    bins, offs, free = np.empty(n, np.int64), np.empty(n, np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if m := mask >> s:
            gap = s + (m & -m).bit_length() - 1
            b = stacks[gap].pop()
            if not stacks[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, len(free)
            free.append(capacity)
        bins[i], offs[i] = b, capacity - gap
        free[b] = left = gap - s
        if left:
            stacks[left].append(b)
            mask |= 1 << left
    return bins, offs, capacity - np.asarray(free, np.int64)


def _packed(cols: list, names: list[str], bins: np.ndarray, offs: np.ndarray, fills: np.ndarray, node: int, base: int, capacity: int, near: int, keep: int) -> pa.RecordBatch:
    """Rows with their bin of this round; ``done`` for the bins that leave the tree here."""
    leave = fills >= capacity - near
    rest = np.flatnonzero(~leave)
    if len(rest) > keep:
        leave[rest[np.argsort(fills[rest], kind="stable")[keep:]]] = True
    out = [*cols, pa.array(base + bins), pa.array(offs), pa.array(fills[bins]), pa.array(np.full(len(bins), node)), pa.array(leave[bins])]
    return pa.RecordBatch.from_arrays(out, names=[*names, "bin", "offset", "fill", "node", "done"])


def _merger(names: list[str], turn: int, capacity: int, near: int, keep: int):
    """A round for one node: its underfull bins are the items, and their rows move along."""

    def merge(table):
        t = table.combine_chunks()
        cols = {n: t.column(n).to_numpy() for n in ("bin", "offset", "fill", "up")}
        _, first, inv = np.unique(cols["bin"], return_index=True, return_inverse=True)
        b, o, f = best_fit(cols["fill"][first], capacity)
        node = int(cols["up"][0])
        rows = [t.column(n).combine_chunks() for n in names]
        return pa.Table.from_batches([_packed(rows, names, b[inv], o[inv] + cols["offset"], f, node, (turn << 58) + (node << 22), capacity, near, keep)])

    return merge


def pack(items: DataFrame, capacity: int, size_col: str = "length", near: int = 0, fan: int = 16, keep: int = 20_000) -> DataFrame:
    """All rows of ``items`` (whole sizes from 1 to ``capacity``) with ``sequence_id`` and their gapless ``offset``.

    ``near``: a bin with at most that much free space counts as full.  An empty table gives an empty table; repeated
    rows are items of their own; column names other than bin, offset, fill, node, done and sequence_id are kept."""
    from pyspark import TaskContext

    names = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", bin long, offset long, fill long, node long, done boolean"
    at = names.index(size_col)

    @trimmed
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, chunk, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def emit() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            b, o, f = best_fit(t.column(at).to_numpy(), capacity)
            return _packed([c.combine_chunks() for c in t.columns], names, b, o, f, pid, (pid << 36) + (chunk << 22), capacity, near, keep)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield emit()
                held, rows, chunk = [], 0, chunk + 1
        if rows:
            yield emit()

    level = materialise(items.mapInArrow(leaves, schema), "pack0")
    done = [level.where("done")]
    top = level.agg(F.max("node")).first()[0] or 0
    turn = 0
    while top > 0 or turn == 0:
        turn += 1

        rest = level.where("not done").withColumn("up", F.expr(f"node div {fan}"))
        level = materialise(rest.groupBy("up").applyInArrow(_merger(names, turn, capacity, near, keep), schema), f"pack{turn}")
        done.append(level.where("done"))
        top //= fan
    done.append(level.where("not done"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select(*names, F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, **how) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place in a sequence (see ``token_pieces`` and ``pack``).
    Any columns besides the id and the text are left aside, whatever their names."""
    pieces = token_pieces(docs, tokenizer_path, capacity, separator, id_col, text_col, keep_ids)
    return pack(materialise(pieces, "pieces"), capacity, **how)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces packed with ``keep_ids``; a sequence is bounded by the capacity."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))
