"""Status feeds: latest state per run, and runs that never finish."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glossmill.functions.status import TERMINAL

TIMEOUT_SECONDS = 7200
WATERMARK = "2 hours"
TIMEOUT_MESSAGE = "Timeout waiting for completion"
OUTCOME = "run string, status string, at timestamp, message string"


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def latest_state(updates: DataFrame, time: str = "updated_at", columns: list[str] | None = None) -> DataFrame:
    """Last reported state per run, with a flag for finished runs. Works on batches and on streams.

    Of several updates at one time the one with the largest values counts, compared in column order over the columns
    that have an order (maps and variants have none). A stream runs in update or complete mode; its state is one row per run.
    """
    names = columns or [c for c in updates.columns if c not in ("run", time)]
    last = F.max_by(F.struct(*names), F.struct(time, *[n for n in names if _ordered(updates.schema[n].dataType)]))
    latest = updates.groupBy("run").agg(F.max(time).alias(time), last.alias("_last"))
    flat = latest.select("run", time, "_last.*")
    return flat.withColumn("finished", F.col("phase").isin(TERMINAL)) if "phase" in names else flat


watch_status = latest_state


def _terminal() -> Column:
    return F.col("status").isin(TERMINAL)


def run_timeouts(updates: DataFrame, as_of: datetime | Column | None = None, seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """Outcome per run: its terminal status, or ``error`` when none came within the limit.

    The clock starts with the first update. Runs that still have time at ``as_of`` are left out; without
    ``as_of`` the wait is taken as over.
    """
    first = updates.groupBy("run").agg(
        F.min("at").alias("_first"),
        F.min(F.when(_terminal(), F.col("at"))).alias("_end"),
        F.min_by("status", F.when(_terminal(), F.struct("at", "status"))).alias("_status"),
    )
    deadline = F.timestamp_micros(F.unix_micros("_first") + F.lit(seconds * 1_000_000))
    timed = first.withColumn("_deadline", deadline)
    finished = F.coalesce(F.col("_end") <= F.col("_deadline"), F.lit(False))
    if as_of is not None:
        moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
        timed = timed.where(finished | (F.col("_deadline") <= moment))
    return timed.select(
        "run",
        F.when(finished, F.col("_status")).otherwise(F.lit("error")).alias("status"),
        F.when(finished, F.col("_end")).otherwise(F.col("_deadline")).alias("at"),
        F.when(~finished, F.lit(TIMEOUT_MESSAGE)).alias("message"),
    )


def detect_timeouts(
    updates: DataFrame, seconds: int = TIMEOUT_SECONDS, watermark: str = WATERMARK, forget_seconds: int = 86_400
) -> DataFrame:
    """Streaming form of ``run_timeouts`` over (run, status, at), append mode.

    State per run is the time of its first update and a mark for runs that are settled. The mark stays
    for ``forget_seconds`` of event time, so a late update does not settle a run twice. Event time moves
    with the feed: a silent run times out once other updates push the watermark past its deadline.
    """

    def settle(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = key[0]

        def rows(status: str, millis: int, message: str | None) -> pd.DataFrame:
            at = pd.Timestamp(millis, unit="ms")
            return pd.DataFrame({"run": [run], "status": [status], "at": [at], "message": [message]})

        def mark(first: int) -> None:
            state.update((first, True))
            state.setTimeoutTimestamp(max(first + (seconds + forget_seconds) * 1000, state.getCurrentWatermarkMs() + 1))

        if state.hasTimedOut:
            first, settled = state.get
            if settled:
                state.remove()
            else:
                mark(first)
                yield rows("error", first + seconds * 1000, TIMEOUT_MESSAGE)
            return
        # One batch of rows at a time: only the earliest update and the earliest terminal status are kept.
        first, settled = state.get if state.exists else (None, False)
        ended: tuple[int, str] | None = None
        for frame in batches:
            at = pd.to_datetime(frame["at"], utc=True)
            millis = (at - pd.Timestamp(0, tz="UTC")) // pd.Timedelta(milliseconds=1)
            first = int(millis.min()) if first is None else min(first, int(millis.min()))
            final = frame["status"].isin(TERMINAL)
            if final.any():
                earliest = int(millis[final].min())
                found = (earliest, frame["status"][final & (millis == earliest)].min())
                ended = found if ended is None else min(ended, found)
        if settled or first is None:
            return
        deadline = first + seconds * 1000
        if ended and ended[0] <= deadline:
            mark(first)
            yield rows(ended[1], ended[0], None)
        elif deadline <= state.getCurrentWatermarkMs():
            mark(first)
            yield rows("error", deadline, TIMEOUT_MESSAGE)
        else:
            state.update((first, False))
            state.setTimeoutTimestamp(deadline)

    watched = updates.select("run", "status", "at").withWatermark("at", watermark)
    return watched.groupBy("run").applyInPandasWithState(
        settle, OUTCOME, "first long, settled boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


