"""Late rows: what the watermark drops, counted per query and operator.

Spark drops rows behind the watermark in its stateful operators and says how many in the progress of each batch. The
listener adds these numbers up. Operators that see single rows (``unique_entries``, ``detect_timeouts``) count rows; an
aggregation counts groups, as rows of a group are combined before they reach the state. To count rows exactly, put
``unique_entries`` before an aggregation.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

LATE = "query string, run_id string, batch_id long, operator int, kind string, late_rows long"


class LateRows(StreamingQueryListener):
    """Dropped rows of all queries of a session since it was added; a batch that is reported twice counts once."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._dropped: dict[tuple[str, str, int, int], tuple[str, int]] = {}
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        with self._lock:
            for k, state in enumerate(progress.get("stateOperators", [])):
                key = (progress.get("name") or progress["id"], progress["runId"], progress["batchId"], k)
                self._dropped[key] = (state.get("operatorName", ""), state.get("numRowsDroppedByWatermark", 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))

    def rows(self) -> list[tuple]:
        with self._lock:
            return [(*key, kind, dropped) for key, (kind, dropped) in sorted(self._dropped.items())]

    def totals(self) -> dict[str, int]:
        """Dropped rows per query name (its id where it has none)."""
        out: dict[str, int] = {}
        for query, *_, dropped in self.rows():
            out[query] = out.get(query, 0) + dropped
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per query, batch and stateful operator."""
        return spark.createDataFrame(self.rows(), LATE)

    def write(self, spark: SparkSession, path: str) -> None:
        """Adds the operators' counts to a table; batches without late rows are left out."""
        self.table(spark).where("late_rows > 0").write.mode("append").parquet(path)

    def ended(self, run_id: str) -> bool:
        """Whether the end of a query run has been reported, and with it all its batches."""
        with self._lock:
            return str(run_id) in self._ended


@contextmanager
def late_rows(spark: SparkSession) -> Iterator[LateRows]:
    """Counts late rows of all queries while the block runs."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
