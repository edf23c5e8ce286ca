"""Corpus metrics as sums of per-row statistics, with any statistics function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_statistics(df: DataFrame, statistics: Column, width: int, by: list[str] | None = None) -> DataFrame:
    """Element-wise sums of an integer array per group: columns ``s0`` … after the group columns.

    Only the sums are shuffled, one row per group and task, so a group of any size is fine.
    """
    by = by or []
    rows = df.select(*by, statistics.alias("_s"))
    sums = [F.coalesce(F.sum(F.get("_s", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(width)]
    return rows.groupBy(*by).agg(*sums)


def score(df: DataFrame, statistics: Column, width: int, formula, by: list[str] | None = None) -> DataFrame:
    """A user's metric: per-row ``statistics``, summed by Spark, then ``formula(s0, s1, …)``.

    ``formula`` takes ``width`` Columns and returns the result Columns.
    """
    sums = sum_statistics(df, statistics, width, by)
    return sums.select(*(by or []), *formula(*[F.col(f"s{i}") for i in range(width)]))
