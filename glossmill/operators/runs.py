"""Run history: listings, searches, comparisons, logs, checkpoints and clean-up plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import as_column
from glossmill.functions.numbers import minutes_text, signed_text, to_fixed
from glossmill.functions.scores import CHRF_NAMES, combined_score, first_nonzero
from glossmill.functions.status import is_error_line
from glossmill.operators.keyed import top_per_key

# The phase behind each status filter of the listing.
PHASE_OF_STATUS = {"completed": "completed", "running": "training", "failed": "failed"}

# Path fragments of files that can go, and of files that always stay.
DELETE_FRAGMENTS = [
    "hf_cache/", ".config/", "sample_data/", "__pycache__/", ".ipynb_checkpoints/",
    ".local/", ".cache/", "pip_packages/", ".jupyter/",
]
KEEP_FRAGMENTS = ["output/model/", "metrics.json", "status.json", "training_log.json", "mlflow_metadata.json"]
CHECKPOINT_FRAGMENT = "checkpoints/"
CHECKPOINT_NUMBER = r"checkpoint-(\d+)"


def list_runs(
    df: DataFrame, status: str = "all", limit: int = 20, limit_first: bool = False, missing: str = "null"
) -> DataFrame:
    """Runs with their scores, latest update first, runs without an update last.

    ``df`` has run, phase, metrics (a map), updated_at and duration_seconds. By default the filter comes
    before the limit; ``limit_first`` looks at the first runs by name only.
    """
    if limit_first:
        df = df.orderBy("run").limit(limit)
    if status != "all":
        df = df.where(F.col("phase") == PHASE_OF_STATUS[status])
    bleu = F.try_element_at("metrics", F.lit("bleu"))
    chrf = first_nonzero("metrics", CHRF_NAMES)
    listed = df.select(
        "run",
        F.coalesce("phase", F.lit("unknown")).alias("phase"),
        bleu.alias("bleu"),
        chrf.alias("chrf"),
        combined_score(bleu, chrf, missing).alias("combined"),
        minutes_text("duration_seconds").alias("duration"),
        "updated_at",
    )
    return listed.orderBy(F.col("updated_at").desc_nulls_last(), "run").limit(limit)


def name_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose name contains a text, whatever the case."""
    return df.where(F.lower(column).contains(part.lower()))


def running(df: DataFrame, column: str = "status") -> DataFrame:
    return df.where(F.col(column).isin("running", "queued"))


def pending(df: DataFrame, limit: int, order: list[Column | str]) -> DataFrame:
    """The first pending submissions."""
    return df.where(F.col("status") == "pending").orderBy(*order).limit(limit)


def filter_logs(df: DataFrame, stream: str = "all", errors: bool = False) -> DataFrame:
    """Log entries of one stream, or error lines only, or both."""
    if stream != "all":
        df = df.where(F.col("stream_name") == stream)
    return df.where(is_error_line("data")) if errors else df


def log_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Entries per group: all, stdout and stderr."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("stream_name") == "stdout").alias("stdout"),
        F.count_if(F.col("stream_name") == "stderr").alias("stderr"),
    )


def log_tail(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The last ``n`` entries per log, in their original order."""
    last = top_per_key(df, by, [F.col(c).desc() for c in order], n)
    return last.orderBy(*by, *order)


def search_runs(
    df: DataFrame, tags: dict[str, str] | None = None, params: dict[str, str] | None = None, limit: int = 100
) -> DataFrame:
    """Runs whose tags and parameters have the given values, latest start first."""
    for column, wanted in (("tags", tags or {}), ("params", params or {})):
        for key, value in wanted.items():
            df = df.where(F.try_element_at(column, F.lit(key)) == value)
    return df.orderBy(F.col("start_time").desc_nulls_last(), "run_id").limit(limit)


def older_than(df: DataFrame, days: float, as_of: datetime | Column, column: str = "updated_at") -> DataFrame:
    """Runs not updated for ``days`` days; a run of unknown age is taken too."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = (F.unix_micros(moment.cast("timestamp")) - F.unix_micros(F.col(column).cast("timestamp"))) / 86_400_000_000
    return df.where(F.col(column).isNull() | (age >= days))


def gate_completed(df: DataFrame, column: str = "phase") -> tuple[DataFrame, DataFrame]:
    """Completed runs, and the others with the reason why they were left out."""
    done = F.coalesce(F.col(column) == "completed", F.lit(False))
    reason = F.concat(F.lit("not completed: "), F.coalesce(F.col(column), F.lit("no status")))
    return df.where(done), df.where(~done).withColumn("reason", reason)


def compare_metrics(current: DataFrame, baseline: DataFrame, on: list[str], digits: int = 2) -> DataFrame:
    """Value, baseline, delta and percent per metric that both sides have."""
    base = baseline.select(*on, F.col("value").alias("baseline"))
    joined = current.select(*on, "value").join(base, on)
    delta = F.col("value") - F.col("baseline")
    percent = 100 * delta / F.nullif(F.col("baseline"), F.lit(0.0))
    with_numbers = joined.withColumns({"delta": delta, "percent": percent})
    text = F.concat(signed_text("delta", digits), F.coalesce(F.concat(F.lit(" ("), to_fixed("percent", 1), F.lit("%)")), F.lit("")))
    return with_numbers.withColumn("change", text)


def pivot_params(df: DataFrame, run: str, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """One row per run with a column per listed key. The key list is explicit, so nothing is scanned twice."""
    wanted = df.where(F.col(key).isin(keys))
    columns = [F.max(F.when(F.col(key) == k, F.col(value))).alias(k) for k in keys]
    return wanted.groupBy(run).agg(*columns)


def checkpoint_number(c: Column | str) -> Column:
    """Step number in a checkpoint path, 0 where there is none."""
    found = F.nullif(F.regexp_extract(as_column(c), CHECKPOINT_NUMBER, 1), F.lit(""))
    return F.coalesce(found.try_cast("bigint"), F.lit(0))


def checkpoints(files: DataFrame) -> DataFrame:
    return files.where(F.col("rel_path").contains("checkpoint-")).withColumn("step", checkpoint_number("rel_path"))


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """The checkpoint path with the highest number per run."""
    last = F.max_by("rel_path", F.struct("step", "rel_path"))
    return checkpoints(files).groupBy("run").agg(last.alias("rel_path"), F.max("step").alias("step"))


def stale_checkpoints(files: DataFrame, keep: int = 2) -> DataFrame:
    """All checkpoint files below the ``keep`` highest steps of their run.

    Only the kept steps are ranked. The rest is found by comparing with the lowest kept step, so the
    many files of one run are never sorted in one task.
    """
    found = checkpoints(files)
    kept = top_per_key(found.select("run", "step").distinct(), ["run"], [F.col("step").desc()], keep)
    lowest = kept.groupBy("run").agg(F.min("step").alias("_lowest"))
    return found.join(lowest, "run").where(F.col("step") < F.col("_lowest")).drop("_lowest")


def retention_actions(files: DataFrame, keep_checkpoints: bool = False) -> DataFrame:
    """``keep``, ``delete`` or NULL per file; keeping wins, and unknown files get no action."""

    def any_of(fragments: list[str]) -> Column:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.col("rel_path").contains(fragment)
        return hit

    doomed = DELETE_FRAGMENTS if keep_checkpoints else [*DELETE_FRAGMENTS, CHECKPOINT_FRAGMENT]
    action = F.when(any_of(KEEP_FRAGMENTS), F.lit("keep")).when(any_of(doomed), F.lit("delete"))
    return files.withColumn("action", action)


def retention_plan(files: DataFrame, keep_checkpoints: bool = False) -> DataFrame:
    """Files deleted, kept and bytes saved per run, and their total in a row without a run.

    The total adds up the per-run rows, so the file list is read and expanded once.
    """
    marked = retention_actions(files, keep_checkpoints)
    gone = F.col("action") == "delete"
    per_run = marked.groupBy("run").agg(
        F.count_if(gone).alias("deleted"),
        F.count_if(F.col("action") == "keep").alias("kept"),
        F.sum(F.when(gone, F.col("bytes")).otherwise(F.lit(0))).alias("saved_bytes"),
    )
    return per_run.rollup("run").agg(*[F.sum(c).alias(c) for c in ("deleted", "kept", "saved_bytes")])
