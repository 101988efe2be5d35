"""Ranking, latest-per-key, pages and ordered walks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegerType, StructField, StructType


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order (Spark prunes by rank before the shuffle)."""
    return df.withColumn("rn_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn_") <= n).drop("rn_")


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key as one aggregate: no sort, partial results before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("row_")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"row_.{c}").alias(c) for c in rest])


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Offset page with the count of all rows, both from one plan over the same input."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), how="left")


def keyset(df: DataFrame, at: str, tie: str, cursor: Column, limit: int) -> DataFrame:
    """Rows strictly older than the cursor, newest first, one more than asked for to tell whether more follow."""
    return df.where(F.col(at) < cursor).orderBy(F.desc(at), F.desc(tie)).limit(limit + 1)


def carry_forward(df: DataFrame, keys: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """The last non-null value of ``col`` so far."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(col, ignorenulls=True).over(w))


def ordered_fold(df: DataFrame, keys: list[str], order: list, start: Callable, step: Callable, inputs: list[str], out: str, out_type: DataType) -> DataFrame:
    """``df`` with a column of what a fold in order says of each row: ``state, value = step(state, *inputs)``, from
    ``start()`` at a key's first row.

    Rows come sorted and pass through one by one, so a task holds one Arrow batch and one state, however many rows its
    key has.  Null keys are one key; the order has to be total for reruns to agree."""
    names, flag, kind = df.columns, "first_", to_arrow_type(out_type)
    while flag in names:
        flag += "_"
    flagged = df.withColumn(flag, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for b in batches:
            values = []
            for first, *xs in zip(b.column(flag).to_pylist(), *[b.column(c).to_pylist() for c in inputs]):
                state, v = step(start() if first else state, *xs)
                values.append(v)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(values, kind)], names=[*names, out])

    return flagged.mapInArrow(run, StructType([*df.schema.fields, StructField(out, out_type)]))


def token_batches(df: DataFrame, keys: list[str], order: str, cost: str, budget: int, most: int = 8) -> DataFrame:
    """Greedy batches in order: a row opens a new batch if it would break the budget or the batch holds ``most`` rows.
    A null cost counts as nothing; rows of one order are told apart by their cost."""

    def step(state: tuple, c) -> tuple[tuple, int]:
        b, used, n = state
        c = c or 0
        if n and (used + c > budget or n >= most):
            b, used, n = b + 1, 0, 0
        return (b, used + c, n + 1), b

    return ordered_fold(df.select(*keys, order, cost), keys, [order, cost], lambda: (0, 0, 0), step, [cost], "batch", IntegerType())
