"""Observations taken in the order of a schedule, as a stream with an ordered buffer and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["key", "tick_ms", "at_ms", "id", "seq", "late"]


@contextmanager
def timed_state(spark: SparkSession):
    """State with timers is kept in RocksDB; the session's own provider is set again afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Schedule(StatefulProcessor):
    """Holds what is due until event time has passed its tick, then gives it in order, numbered per key.

    A key has one state, the rows that wait (tick, time, id as 64-bit integers) beside the number of those given, and one
    timer, at its earliest tick; a timer gives every tick that is over. So state is read and written once a trigger
    and key, however many ticks there are.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("due", "n bigint, due binary")

    def _held(self) -> tuple[int, np.ndarray]:
        n, due = self.state.get() or (0, b"")
        return n, np.frombuffer(due, np.int64).reshape(-1, 3)

    def _give(self, key: tuple, rows: np.ndarray, n: int, late: bool) -> pd.DataFrame:
        tick, at, ids = rows[np.lexsort(rows.T[::-1])].T
        return pd.DataFrame({"key": key[0], "tick_ms": tick, "at_ms": at, "id": ids, "seq": np.arange(n + 1, n + len(rows) + 1), "late": late}, columns=COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [pdf.loc[pdf["id"].notna(), ["tick_ms", "at_ms", "id"]].to_numpy(np.int64) for pdf in rows]
        new = np.concatenate(new) if new else np.empty((0, 3), np.int64)
        if not len(new):
            return
        n, held = self._held()
        over = new[:, 0] <= timerValues.getCurrentWatermarkInMs()
        if over.any():  # their tick is over: at once, marked
            yield self._give(key, new[over], n, True)
        waits = np.concatenate([held, new[~over]])
        self.state.update((n + int(over.sum()), waits.tobytes()))
        before, first = (x[:, 0].min() if len(x) else None for x in (held, waits))
        if before != first:
            self.handle.registerTimer(int(first))
            if before is not None:
                self.handle.deleteTimer(int(before))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, held = self._held()
        over = held[:, 0] <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if over.any():
            yield self._give(key, held[over], n, False)
        waits = held[~over]
        self.state.update((n + int(over.sum()), waits.tobytes()))
        if len(waits):
            self.handle.registerTimer(int(waits[:, 0].min()))

    def close(self) -> None:
        pass


def scheduled(stream: DataFrame, key: str, time: str, id_col: str, tick_ms: F.Column, late: str) -> DataFrame:
    """(key, tick_ms, at_ms, id, seq, late): every observation once, at the tick (milliseconds since 1970, at or after its time) by
    which it is taken, in order of time and id, numbered per key as they are taken.

    Whatever the order in which rows arrive, a tick's rows wait until event time has passed the tick by `late`. A row
    that comes when event time has passed its own time by more than that is left out, as the watermark does (the query's
    progress counts them); one whose tick is just over is given at once and marked late. A row without an id only
    moves time. Start the query inside timed_state().
    """
    rows = stream.select(F.col(key).alias("key"), F.col(time).alias("_t"), F.unix_millis(F.col(time)).alias("at_ms"), F.col(id_col).cast("long").alias("id"), tick_ms.cast("long").alias("tick_ms")).withWatermark("_t", late)
    kind = f"key {stream.schema[key].dataType.simpleString()}, tick_ms long, at_ms long, id long, seq long, late boolean"
    return rows.groupBy("key").transformWithStateInPandas(Schedule(), kind, "append", "eventTime")
