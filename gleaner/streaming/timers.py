"""Keyed state with timers: debouncing and first events of streams that wait for no other key.

Both need Spark's RocksDB state store (see STORE). Times come from the events; what fires a run is the clock of the worker.
"""

from __future__ import annotations

import time as clock
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_RUN = "first long, last long, n long"


class _Debounce(StatefulProcessor):
    """Per key one open run: its first and last event (microseconds) and their number, and one timer."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _RUN)

    def _told(self, key: tuple, runs: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(runs), "first_at": [a for a, _, _ in runs], "fires_at": [b + self.gap for _, b, _ in runs], "n": [n for *_, n in runs]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended, held = [], self.run.get() if self.run.exists() else None
        for at in sorted(t for pdf in rows for t in pdf["at"].tolist()):
            if held and held[0] - self.gap <= at <= held[1] + self.gap:
                held = (min(held[0], at), max(held[1], at), held[2] + 1)
            else:
                if held:
                    ended.append(tuple(held))
                held = (at, at, 1)
        self.run.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(clock.time() * 1000) + -(-self.gap // 1000))
        if ended:
            yield self._told(key, ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            yield self._told(key, [tuple(self.run.get())])
            self.run.clear()

    def close(self) -> None:
        pass


class _First(StatefulProcessor):
    """Per key its first event, until it is forgotten."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(t for pdf in rows for t in pdf["at"].tolist())
        if not self.seen.exists():
            self.seen.update((first,))
            self.handle.registerTimer(int(clock.time() * 1000) + self.forget_ms)
            yield pd.DataFrame({"key": [key[0]], "at": [first]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame({"key": [], "at": []})

    def close(self) -> None:
        pass


def _keyed(events: DataFrame, key: str, time: str) -> DataFrame:
    return events.where(F.col(time).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))


def debounced_at_once(events: DataFrame, key: str, time: str, gap_ms: int = 350) -> DataFrame:
    """key, first_at, fires_at and n of each run, as sessions.debounced, from a stream: a run is given gap_ms after its last event came, by
    the clock, without an event of another key, and its state goes with it. Events without a time are left out."""
    rows = _keyed(events, key, time)
    kind = rows.schema["key"].dataType.simpleString()
    runs = rows.groupBy("key").transformWithStateInPandas(_Debounce(gap_ms * 1000), f"key {kind}, first_at long, fires_at long, n long", "Append", "ProcessingTime")
    return runs.select(F.col("key").alias(key), F.timestamp_micros("first_at").alias("first_at"), F.timestamp_micros("fires_at").alias("fires_at"), "n")


def first_events_at_once(events: DataFrame, key: str, time: str, forget_ms: int = 3_600_000) -> DataFrame:
    """key and the time of the first event to come of each key, at once; a key is forgotten forget_ms later, by the clock, so state stays bounded."""
    rows = _keyed(events, key, time)
    kind = rows.schema["key"].dataType.simpleString()
    first = rows.groupBy("key").transformWithStateInPandas(_First(forget_ms), f"key {kind}, at long", "Append", "ProcessingTime")
    return first.select(F.col("key").alias(key), F.timestamp_micros("at").alias(time))
