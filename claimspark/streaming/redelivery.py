"""Redelivery with a clock: an item that isn't done in time comes back by itself, and in the end is dead."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUT = "id string, outcome string, attempt long, at_ms long"
_STATE = StructType([StructField("status", StringType()), StructField("attempt", LongType()), StructField("timer", LongType())])


class Redelivery(StatefulProcessor):
    """An item is delivered when it first comes. Unless it is done within ``lease_ms`` it is delivered again; after ``most`` lapses it is dead.

    Timers of the processing clock do that, without any further message. Repeated items change nothing, a late ``done`` of a dead
    one neither. The memory of items that are done or dead goes after ``forget_ms``.
    """

    def __init__(self, lease_ms: int, most: int, forget_ms: int) -> None:
        self.lease_ms, self.most, self.forget_ms = lease_ms, most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)
        self.closed = handle.getValueState("closed", StructType([StructField("status", StringType())]), ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = any(bool(frame["done"].any()) for frame in rows)
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.closed.exists():
            return
        held = self.open.get() if self.open.exists() else None
        if done:
            if held:
                self.handle.deleteTimer(held[2])
                self.open.clear()
            self.closed.update(("done",))
            yield self._row(key, "done", held[1] if held else 0, now)
        elif held is None:
            yield self._deliver(key, 1, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        if not self.open.exists():
            return
        _, attempt, _ = self.open.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        if attempt >= self.most:
            self.open.clear()
            self.closed.update(("dead",))
            yield self._row(key, "dead", attempt, now)
        else:
            yield self._deliver(key, attempt + 1, now)

    def _deliver(self, key: Any, attempt: int, now: int) -> pd.DataFrame:
        self.handle.registerTimer(now + self.lease_ms)
        self.open.update(("delivered", attempt, now + self.lease_ms))
        return self._row(key, "delivered", attempt, now)

    def _row(self, key: Any, outcome: str, attempt: int, now: int) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "outcome": [outcome], "attempt": [attempt], "at_ms": [now]})

    def close(self) -> None:
        pass


def redelivered(events: DataFrame, lease_ms: int = 20 * 60_000, most: int = 3, forget_ms: int = 24 * 3_600_000) -> DataFrame:
    """(id, outcome, attempt, at_ms) of a stream (id, done): delivered, done or dead."""
    return events.select("id", "done").groupBy("id").transformWithStateInPandas(Redelivery(lease_ms, most, forget_ms), OUT, "append", "ProcessingTime")
