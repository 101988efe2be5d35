"""Time-based operators.  Each takes a DataFrame that may be a table or a stream with a watermark on its time column,
except where it says that it keeps state (stream) or folds rows in order (table)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from ..operators.windows import ordered_fold


def event_stream(spark: SparkSession, path: str, schema, watermark: str = "10 minutes", at: str = "ts") -> DataFrame:
    """A folder of Parquet files as a stream; later files may bring rows up to ``watermark`` late."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(at, watermark)


def debounce(signals: DataFrame, keys: list[str], at: str, payload: list[str], quiet: str = "60 seconds", tie: str | None = None) -> DataFrame:
    """One row per burst of signals less than ``quiet`` apart: the latest payload by event time, and the burst's ends.

    Out-of-order signals fold into their burst by event time."""
    order = F.struct(at, tie) if tie else F.col(at)
    g = signals.groupBy(*keys, F.session_window(at, quiet).alias("w_")).agg(F.count("*").alias("signals"), F.max_by(F.struct(*payload), order).alias("p_"))
    return g.select(*keys, F.col("w_.start").alias("first_at"), F.col("w_.end").alias("fires_at"), "signals", *[F.col(f"p_.{c}").alias(c) for c in payload])


def sliding_usage(events: DataFrame, keys: list[str], at: str, cost: str, seconds: int = 60) -> DataFrame:
    """(table) Requests and cost in the ``seconds`` up to each event, itself included."""
    w = W.partitionBy(*keys).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("requests", F.count("*").over(w)).withColumn("used", F.sum(cost).over(w))


def fixed_window_table(events: DataFrame, keys: list[str], at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """(table) The limiter whose window opens with a key's first event and closes ``seconds`` later: each event with
    its number in the window and whether it is allowed.  An event without a time belongs to the window that is open."""

    def step(state: tuple, t: float | None) -> tuple[tuple, int]:
        opened, n = state
        if n == 0 or (t is not None and (opened is None or t - opened >= seconds)):
            opened, n = t, 0
        return (opened, n + 1), n + 1

    x = events.select(*keys, tie, F.col(at).cast("timestamp").cast("double").alias("t_"))
    x = ordered_fold(x, keys, ["t_", tie], lambda: (None, 0), step, ["t_"], "number", IntegerType())
    return x.select(*keys, tie, "number", (F.col("number") <= limit).alias("allowed"))


def fixed_window_stream(events: DataFrame, key: str, at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """(stream) The same limiter with its window's start and count as state; state ends with the window."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values([at, tie])
        out = []
        for t, i in zip(rows[at].astype("int64") / 1e9 if rows[at].dtype.kind != "M" else rows[at].astype("datetime64[ns]").astype("int64") / 1e9, rows[tie]):
            if opened is None or t - opened >= seconds:
                opened, n = t, 0
            n += 1
            out.append((k[0], i, n, n <= limit))
        state.update((opened, n))
        state.setTimeoutTimestamp(max(int((opened + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, tie, "number", "allowed"])

    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, `{tie}` {events.schema[tie].dataType.simpleString()}, number int, allowed boolean"
    return events.groupBy(key).applyInPandasWithState(run, schema, "opened double, n int", "append", GroupStateTimeout.EventTimeTimeout)


def breaker(events: DataFrame, keys: list[str], at: str, tie: str, threshold: int = 4, window: int = 600, cooldown: int = 300) -> DataFrame:
    """(table) Broken events that trip the breaker (more than ``threshold`` in a window), and until when it stays open."""
    n = fixed_window_table(events, keys, at, tie, threshold, window).where("not allowed")
    back = n.join(events.select(*keys, tie, at), [*keys, tie])
    return back.select(*keys, tie, "number", (F.col(at).cast("timestamp").cast("double") + cooldown).cast("long").alias("open_until"))


def alive(rows: DataFrame, at: str, as_of: Column, ttl: str) -> DataFrame:
    """Rows whose time to live has not passed at ``as_of``."""
    return rows.where(F.col(at) >= as_of - F.expr(f"interval {ttl}"))


def first_seen(events: DataFrame, keys: str | list[str], order: list[str] | None = None) -> DataFrame:
    """Each key once: of a stream, what comes first, once within the watermark; of a table, the row of least ``order``
    (ties: least in all columns; no order given: all columns in turn)."""
    keys = [keys] if isinstance(keys, str) else keys
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark(keys)
    first = events.groupBy(*keys).agg(F.min(F.struct(*(order or []), F.struct(*events.columns).alias("row_")))["row_"].alias("row_"))
    return first.select("row_.*")


def changes(rows: DataFrame, keys: list[str], order: list[str], compared: list[str]) -> DataFrame:
    """(table) Rows that differ from the one before them of their key; the first always counts."""
    w = W.partitionBy(*keys).orderBy(*order)
    now, before = F.struct(*compared), F.lag(F.struct(*compared)).over(w)
    return rows.withColumn("b_", before).where(F.col("b_").isNull() | ~F.col("b_").eqNullSafe(now)).drop("b_")


def rolling_counts(events: DataFrame, keys: list[str], at: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts per window of event time, tumbling or sliding."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.groupBy(w.alias("w_"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w_.start").alias("start"), "n")


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that is there now, in batches handed to ``each``; a second call goes on where the first ended."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changed_files(prior: DataFrame, batch: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``prior`` with the rows of changed files (``files``: file_path; else the batch's own) replaced by ``batch``.  A file
    that changed and has no row in the batch loses all of its rows."""
    files = (batch if files is None else files).select("file_path").distinct()
    return prior.join(files, "file_path", "left_anti").unionByName(batch)


class IndexStore:
    """An entity store by file that batches of a change feed keep up to date.

    Files are dealt into ``buckets`` by hash.  A batch reads and writes only the buckets of its files, as
    ``v=<batch>/bucket=<b>``; ``manifest/<batch>`` then names the version of every bucket, so readers see all of a batch or
    nothing.  Versions that neither the last manifest nor the one before it names are deleted.

    A batch holds the rows of changed files.  A row whose columns but file_path are all null stands for a file that was
    deleted or emptied: its old rows go."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches that were written whole, rising; only the last two remain."""
        base = self._path(f"{self.path}/manifest")
        if not self.fs.exists(base):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in self.fs.listStatus(base)]
        return sorted(int(n) for n, p in names if n.isdigit() and self.fs.exists(self._path(p, "_SUCCESS")))

    def versions(self, batch: int) -> dict[int, int]:
        """The version of each bucket that has one; at most ``buckets`` rows."""
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/{batch}").collect()}

    def _rows(self, versions: dict[int, int], buckets: list[int]) -> DataFrame:
        places = [f"{self.path}/v={versions[b]}/bucket={b}" for b in buckets if b in versions]
        places = [p for p in places if self.fs.exists(self._path(p))]  # a bucket whose last row went has no folder
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows as of the last batch."""
        done = self.batches()
        return self._rows(self.versions(done[-1]), list(range(self.buckets))) if done else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, number: int, whole: DataFrame | None = None) -> list[int]:
        """Take ``batch`` in; ``whole``, where given, replaces the store's rows altogether.  Returns the buckets written;
        none where the batch was taken in before."""
        done = self.batches()
        if number in done or (done and number < done[-1]):
            return []
        old = self.versions(done[-1]) if done else {}
        if whole is None:
            files = batch.select("file_path").distinct()
            touched = sorted(r["b"] for r in files.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
            rows = batch.where(reduce(or_, [F.col(c).isNotNull() for c in batch.columns if c != "file_path"]))
            out = changed_files(self._rows(old, touched), rows, files)
        else:
            touched, out = list(range(self.buckets)), whole
        out.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={number}")
        now = old | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        self._clean(now, old, done[:-1])
        return touched

    def _clean(self, now: dict[int, int], before: dict[int, int], manifests: list[int]) -> None:
        for n in manifests:
            self.fs.delete(self._path(f"{self.path}/manifest/{n}"), True)
        used = {(v, b) for x in (now, before) for b, v in x.items()}
        for s in self.fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if not name.startswith("v="):
                continue
            version = int(name[2:])
            parts = [p.getPath() for p in self.fs.listStatus(s.getPath()) if p.getPath().getName().startswith("bucket=")]
            stale = [p for p in parts if (version, int(p.getName()[7:])) not in used]
            if len(stale) == len(parts) and version not in now.values():
                self.fs.delete(s.getPath(), True)
            else:
                for p in stale:
                    self.fs.delete(p, True)


def incremental_index(store: str, schema: str, full_scan: Callable[[SparkSession], DataFrame] | None = None, full_above: int = 200, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps an ``IndexStore``.  With more than ``full_above`` changed files ``full_scan``, where given,
    indexes everything anew; rows of files that did not change are never dropped otherwise.  A batch that was taken in is
    not taken in again."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        many = full_scan is not None and batch.select("file_path").distinct().limit(full_above + 1).count() > full_above
        IndexStore(spark, store, schema, buckets).apply(batch, number, full_scan(spark) if many else None)

    return each
