"""Stateful stream operators with timers: state goes when event time has passed it, not when its key is seen again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Breaker(StatefulProcessor):
    """A key's window as state: when it opened and how many broken events it holds.  A timer at its end removes it."""

    def __init__(self, key: str, at: str, tie: str, threshold: int, window: int, cooldown: int):
        self.names, self.threshold, self.window, self.cooldown = (key, at, tie), threshold, window, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "opened double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, at, tie = self.names
        opened, n = self.state.get() if self.state.exists() else (None, 0)
        before = opened
        events = pd.concat(list(rows))
        events = events.assign(**{at: events[at].astype("datetime64[ns]")}).sort_values([at, tie])
        out = []
        for t, i in zip(events[at].astype("int64") / 1e9, events[tie]):
            if opened is None or t - opened >= self.window:
                opened, n = t, 0
            n += 1
            if n > self.threshold:
                out.append((key[0], i, n, int(t + self.cooldown)))
        self.state.update((opened, n))
        if opened != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(opened))
        yield pd.DataFrame(out, columns=[name, tie, "number", "open_until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass

    def _end(self, opened: float) -> int:
        return int((opened + self.window) * 1000)


def breaker_stream(events: DataFrame, key: str, at: str, tie: str, threshold: int = 4, window: int = 600, cooldown: int = 300) -> DataFrame:
    """(stream) The rows of ``operators.breaker`` as their events come: which broken events trip a key's breaker, and until when it
    stays open.

    Events of a key count in the order of their time within a batch; what comes behind the watermark is dropped by the
    stream's own rule.  A batch holds one key's rows of that batch in one task.  Timers need the session's state store to
    be ``ROCKSDB``."""
    kind = lambda c: events.schema[c].dataType.simpleString()
    return events.groupBy(key).transformWithStateInPandas(
        Breaker(key, at, tie, threshold, window, cooldown), f"`{key}` {kind(key)}, `{tie}` {kind(tie)}, number int, open_until long", "Append", "EventTime")
