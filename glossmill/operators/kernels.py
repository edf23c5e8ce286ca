"""Version histories of kernels and models, submissions and their boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.keyed import collect_paged, latest_per_key, lookup, top_per_key


def kernel_summary(versions: DataFrame) -> DataFrame:
    """One row per kernel: current version, its strategy, last run and last known status."""
    recent = F.struct("timestamp", "version")
    return versions.groupBy("kernel").agg(
        F.max("version").alias("current_version"),
        F.max_by("strategy", recent).alias("strategy"),
        F.max("timestamp").alias("last_run"),
        F.max_by("status", F.when(F.col("status").isNotNull(), recent)).alias("last_status"),
    )


def latest_kernel(versions: DataFrame) -> DataFrame:
    """The newest record of each kernel."""
    return latest_per_key(versions, ["kernel"], [F.col("version").desc()])


def kernel_history(versions: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Versions nested per kernel in ascending order, one row per (kernel, page)."""
    columns = [c for c in versions.columns if c not in ("kernel", "version")]
    item = F.struct("version", *columns)
    return collect_paged(versions, ["kernel"], item, ["version"], "versions", page_size)


def kernel_versions(history: DataFrame) -> DataFrame:
    """The nested form back as one row per version."""
    return history.select("kernel", F.inline("versions"))


def apply_status(versions: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set status and run id of (kernel, version) rows, and the last status per updated kernel.

    Of several updates to one version the latest counts. A missing run id keeps the old one.
    """
    newest = latest_per_key(updates, ["kernel", "version"], [F.col("updated_at").desc()])
    fresh = newest.select("kernel", "version", F.col("status").alias("_status"), F.col("run_id").alias("_run"))
    changed = versions.join(fresh, ["kernel", "version"], "left")
    result = changed.withColumns({"status": F.coalesce("_status", "status"), "run_id": F.coalesce("_run", "run_id")})
    last = latest_per_key(updates, ["kernel"], [F.col("updated_at").desc(), F.col("version").desc()])
    return result.drop("_status", "_run"), last.select("kernel", F.col("status").alias("last_status"))


def recent_submissions(submissions: DataFrame, n: int = 5, by: str = "competition") -> DataFrame:
    """The last ``n`` submissions per competition, newest first."""
    newest = [F.col("timestamp").desc(), F.col("id").desc()]
    return top_per_key(submissions, [by], newest, n).orderBy(by, *newest)


def scoreboard(models: DataFrame, submissions: DataFrame, competitions: DataFrame) -> DataFrame:
    """Per competition: models by status, submissions, best score in the competition's direction.

    Both sides are aggregated before they meet, so the joins see one row per competition.
    """
    by_status = models.groupBy("competition").agg(
        F.count(F.lit(1)).alias("models"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "testing", "archived")],
    )
    scores = submissions.groupBy("competition").agg(
        F.count(F.lit(1)).alias("submissions"),
        F.max("public_score").alias("_max"),
        F.min("public_score").alias("_min"),
    )
    best = F.when(F.col("metric_direction") == "minimize", F.col("_min")).otherwise(F.col("_max"))
    board = competitions.join(by_status, "competition", "left").join(scores, "competition", "left")
    counts = ["models", "active", "testing", "archived", "submissions"]
    return board.withColumn("best_score", best).drop("_min", "_max").na.fill(0, counts)


def models_nested(versions: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Registered models with their sorted versions in pages, a map of each page's aliases to versions, and totals per model."""
    item = F.struct("version", "status", "run_id", "alias")
    nested = collect_paged(versions, ["name"], item, ["version"], "versions", page_size)
    named = F.filter("versions", lambda v: v["alias"].isNotNull())
    pairs = F.transform(named, lambda v: F.struct(v["alias"].alias("key"), v["version"].alias("value")))
    totals = versions.groupBy("name").agg(F.count(F.lit(1)).alias("n_versions"), F.count("alias").alias("n_aliases"))
    return lookup(nested.withColumn("aliases", F.map_from_entries(pairs)), totals, ["name"])
