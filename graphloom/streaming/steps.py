"""Pipelines that go on where they stopped: each step's rows are a table, a finished table is read and not computed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Step = tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]


def _committed(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run_steps(spark: SparkSession, folder: str, run_id: str, steps: Sequence[Step]) -> tuple[DataFrame | None, DataFrame]:
    """The last step's rows and the record of the run (ordinal, step, status: done or resumed).

    Each step takes (spark, the rows of the step before) and its result is written to ``folder``/run/step.  A run with the
    same id skips steps whose table was committed, so a lost driver repeats one step; a step that was written in part is
    written again.  Names must differ; no step, no rows."""
    names = [n for n, _ in steps]
    if len(set(names)) != len(names):
        raise ValueError("steps of one name")
    rows, record = None, []
    for k, (name, step) in enumerate(steps):
        path = f"{folder}/{run_id}/{k:02d}-{name}"
        done = _committed(spark, path)
        if not done:
            step(spark, rows).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        record.append((k, name, "resumed" if done else "done"))
    return rows, spark.createDataFrame(record, "ordinal int, step string, status string")
