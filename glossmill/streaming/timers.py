"""Timeouts of runs with typed state and event-time timers.

The same outcomes as ``status.detect_timeouts``, on Spark's arbitrary stateful processing of the second generation: a
run has one value state and one timer at a time. A timer at the deadline settles a silent run, a later one forgets a
settled run, so the state holds only runs that are open or were settled within ``forget_seconds`` of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glossmill.functions.status import TERMINAL
from glossmill.streaming.status import OUTCOME, TIMEOUT_MESSAGE, TIMEOUT_SECONDS, WATERMARK

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "first long, settled boolean"


def _processor(seconds: int, forget_seconds: int, terminal: list[str]) -> StatefulProcessor:
    """Made inside a function, so that it travels with the query by value and executors need no copy of the package."""

    class RunClock(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.run = handle.getValueState("run", STATE)

        def _rows(self, run: str, status: str, millis: int, message: str | None) -> pd.DataFrame:
            at = pd.Timestamp(millis, unit="ms")
            return pd.DataFrame({"run": [run], "status": [status], "at": [at], "message": [message]})

        def _move_timer(self, millis: int) -> None:
            for known in list(self.handle.listTimers()):
                self.handle.deleteTimer(known)
            self.handle.registerTimer(millis)

        def _settle(self, first: int, watermark: int) -> None:
            self.run.update((first, True))
            self._move_timer(max(first + (seconds + forget_seconds) * 1000, watermark + 1))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            before = self.run.get() if self.run.exists() else None
            known, settled = (before[0], before[1]) if before is not None else (None, False)
            first, ended = known, None
            # One batch of rows at a time: only the earliest update and the earliest terminal status are kept.
            for frame in rows:
                at = pd.to_datetime(frame["at"], utc=True)
                dated = at.notna()
                millis = ((at - pd.Timestamp(0, tz="UTC")) // pd.Timedelta(milliseconds=1))[dated].astype("int64")
                if not len(millis):
                    continue
                first = int(millis.min()) if first is None else min(first, int(millis.min()))
                final = frame["status"][dated].isin(terminal)
                if final.any():
                    earliest = int(millis[final].min())
                    found = (earliest, frame["status"][dated][final & (millis == earliest)].min())
                    ended = found if ended is None else min(ended, found)
            if settled or first is None:
                return
            watermark = timerValues.getCurrentWatermarkInMs()
            deadline = first + seconds * 1000
            if ended is not None and ended[0] <= deadline:
                self._settle(first, watermark)
                yield self._rows(key[0], ended[1], ended[0], None)
            elif deadline <= watermark:
                self._settle(first, watermark)
                yield self._rows(key[0], "error", deadline, TIMEOUT_MESSAGE)
            elif first != known:
                self.run.update((first, False))
                self._move_timer(deadline)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if not self.run.exists():
                return
            first, settled = self.run.get()
            if settled:
                self.run.clear()
            else:
                self._settle(first, timerValues.getCurrentWatermarkInMs())
                yield self._rows(key[0], "error", first + seconds * 1000, TIMEOUT_MESSAGE)

        def close(self) -> None:
            pass

    return RunClock()


def watch_timeouts(
    updates: DataFrame, seconds: int = TIMEOUT_SECONDS, watermark: str = WATERMARK, forget_seconds: int = 86_400
) -> DataFrame:
    """Streaming form of ``run_timeouts`` over (run, status, at), append mode, with event-time timers.

    The first update of a run starts its clock; an update that turns out earlier moves the timer. A run that is settled
    stays marked for ``forget_seconds`` of event time, so that a late update does not settle it twice. Rows without a
    time are ignored. The session needs the RocksDB state store, which alone keeps timers.
    """
    store = updates.sparkSession.conf.get(STORE)
    if store != ROCKSDB:
        raise ValueError(f"timers need {STORE}={ROCKSDB}; it is {store}")
    watched = updates.select("run", "status", "at").withWatermark("at", watermark)
    clock = _processor(seconds, forget_seconds, list(TERMINAL))
    return watched.groupBy("run").transformWithStateInPandas(clock, OUTCOME, "Append", "EventTime")
