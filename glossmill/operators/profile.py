"""Column profiles and corpus quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, non-null, null and distinct counts, minimum and maximum of numbers.

    Everything but the exact distinct count comes from a single aggregation. ``approx`` takes the
    distinct count from a sketch in that same pass (2 % typical error). The exact count groups by
    (column, value), which drops repeated values before the shuffle and spreads the rest evenly.
    """
    fields = df.schema.fields
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        column = F.col(f"`{field.name}`")
        aggregates.append(F.count(column).alias(f"n{i}"))
        if isinstance(field.dataType, NUMERIC):
            aggregates.append(F.min(column).cast("double").alias(f"lo{i}"))
            aggregates.append(F.max(column).cast("double").alias(f"hi{i}"))
        if approx:
            aggregates.append(F.approx_count_distinct(column, 0.02).alias(f"d{i}"))
    wide = df.agg(*aggregates)
    missing = F.lit(None).cast("double")
    rows = []
    for i, field in enumerate(fields):
        numeric = isinstance(field.dataType, NUMERIC)
        entry = [
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col(f"n{i}").alias("non_null"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            (F.col(f"lo{i}") if numeric else missing).alias("min"),
            (F.col(f"hi{i}") if numeric else missing).alias("max"),
        ]
        if approx:
            entry.append(F.col(f"d{i}").alias("distinct_values"))
        rows.append(F.struct(*entry))
    table = wide.select(F.inline(F.array(*rows)))
    if approx:
        return table
    return table.join(distinct_counts(df), "position", "left").na.fill(0, ["distinct_values"])


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact number of different values per column position."""

    def value(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = column + F.lit(0.0)  # makes -0.0 the same value as 0.0
        return column.cast("string")

    values = [F.struct(F.lit(i).alias("position"), value(field).alias("value")) for i, field in enumerate(df.schema.fields)]
    pairs = df.select(F.inline(F.array(*values))).where(F.col("value").isNotNull()).distinct()
    return pairs.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_values"))


def pair_quality(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Missing sides, mean lengths in characters, rows and rows left after cleaning: one row."""
    left, right = F.col(source), F.col(target)
    return df.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(left.isNull()).alias("null_sources"),
        F.count_if(right.isNull()).alias("null_targets"),
        F.avg(F.length(left)).alias("mean_source_chars"),
        F.avg(F.length(right)).alias("mean_target_chars"),
        F.count_if(left.isNotNull() & right.isNotNull()).alias("clean_pairs"),
    )


def avg_record_size(df: DataFrame, n: int = 1000, order: list[str] | None = None) -> DataFrame:
    """Mean size of the first ``n`` records, in characters of JSON, and how many there were."""
    first = df.orderBy(*order).limit(n) if order else df.limit(n)
    size = F.length(F.to_json(F.struct("*")))
    return first.agg(F.count(F.lit(1)).alias("records"), F.avg(size).alias("mean_chars"))
