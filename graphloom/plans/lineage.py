"""Cutting lineage: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: list[str] = []  # folders that stand, in the order of writing
_runs: ContextVar[tuple[list[str], ...]] = ContextVar("runs", default=())  # the lists of the runs around this code


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset, a folder of our own if all runs on this machine, as in
    tests; on a cluster that is an error, as executors could not see it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            conf = given.get()
        elif spark.sparkContext.master.startswith("local"):
            conf = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffles of what runs within as soon as it has run; by itself it waits for the driver's garbage collector."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet and read back: iterations stay short plans, and lost executors repeat nothing above.  The
    shuffles behind it are deleted once it stands."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.option("compression", codec).parquet(path)
    _written.append(path)
    for run in _runs.get():
        run.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def materialise_telling(df: DataFrame, tag: str, **told: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates of the rows written, from the same job: whether a round changed anything."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(n) for n, c in told.items()]), tag)
    return out, seen.get


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.remove(path)


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote and that no plan will read again; other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path in _written:
            _delete(t.sparkSession, path)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """A run: the tables that code within it writes, for ``release_run``.  Other threads' tables are not among them."""
    mine: list[str] = []
    token = _runs.set((*_runs.get(), mine))
    try:
        yield mine
    finally:
        _runs.reset(token)


def release_run(spark: SparkSession, run: list[str], keep: DataFrame | None = None) -> None:
    """Delete what stands of a run's tables, but for ``keep``: the result that came of them."""
    for path in run:
        if path in _written and path != getattr(keep, "_written_at", None):
            _delete(spark, path)
