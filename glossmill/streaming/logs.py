"""Log feeds: filters and counts over a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.runs import filter_logs, log_counts


def unique_entries(entries: DataFrame, keys: list[str], time: str = "ts", watermark: str = "2 hours") -> DataFrame:
    """Entries without repeats that arrive within the watermark. State is bounded by the watermark."""
    return entries.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def live_errors(entries: DataFrame, stream: str = "all") -> DataFrame:
    """Error lines as they come in; needs no state."""
    return filter_logs(entries, stream, errors=True)


def live_counts(
    entries: DataFrame,
    by: list[str],
    errors: bool = False,
    window: str | None = None,
    time: str = "ts",
    watermark: str | None = "2 hours",
) -> DataFrame:
    """Entries per group and, with ``window``, per time window, after the error filter.

    With a window the state ends at the watermark and late entries are dropped; Spark reports their
    number in the query progress. Pass ``watermark=None`` for entries that have a watermark already,
    such as those of ``unique_entries``. The same call works on a batch.
    """
    kept = filter_logs(entries, errors=errors)
    if window is None:
        return log_counts(kept, by)
    if watermark is not None:
        kept = kept.withWatermark(time, watermark)
    counts = log_counts(kept.withColumn("window", F.window(time, window)), [*by, "window"])
    return counts.select(*by, F.col("window.start").alias("window_start"), "entries", "stdout", "stderr")
