"""Column names and column types of text tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import SPACES, strip
from glossmill.functions.numbers import (
    INFINITY_PREFIX, INTEGER, NUMBER, NUMBER_PREFIX, parse_prefix_integer, parse_prefix_number,
)

SAFE_DIGITS = 18  # integers of this length fit in 64 bits, so no cast has to be tried


def sanitize_name(name: str) -> str:
    """A column name of word characters: brackets go, punctuation and blanks become one underscore."""
    text = re.sub(r"[\[\](){}]", "", name.strip())
    text = re.sub(r"[;:,./\\'\"\s_]+", "_", text)
    text = re.sub(r"^_|_$", "", text)
    if re.match(r"[0-9]", text):
        text = f"_{text}"
    return text or "column"


def sanitize_names(names: list[str]) -> list[str]:
    """Sanitized names; a name that is taken gets the first free suffix ``_1``, ``_2``, …"""
    taken: set[str] = set()
    result = []
    for name in names:
        base = sanitize_name(name)
        unique, suffix = base, 0
        while unique in taken:
            suffix += 1
            unique = f"{base}_{suffix}"
        taken.add(unique)
        result.append(unique)
    return result


def name_mapping(spark: SparkSession, original: list[str], sanitized: list[str]) -> DataFrame:
    """The columns whose name changed."""
    changed = [(new, old.strip()) for new, old in zip(sanitized, original) if new != old.strip()]
    return spark.createDataFrame(changed, "sanitized_name string, original_name string")


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = sanitize_names(df.columns)
    return df.toDF(*names), name_mapping(df.sparkSession, df.columns, names)


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def cell_kind(c: Column, compat: str = "strict") -> Column:
    """0 for a blank cell, 1 for an integer, 2 for another number, 3 for any other text."""
    margin = f"[{SPACES}]*"

    def whole(pattern: str) -> Column:
        return c.rlike(f"^{margin}(?:{pattern}){margin}$")

    integer = whole(INTEGER)
    if compat == "strict":
        integer = integer & ((F.length(c) <= SAFE_DIGITS) | strip(c).try_cast("bigint").isNotNull())
        number = whole(NUMBER)
    else:
        number = c.rlike(f"^{margin}(?:{NUMBER_PREFIX}|{INFINITY_PREFIX})")
    return F.when(c.isNull() | whole(""), 0).when(integer, 1).when(number, 2).otherwise(3)


def type_report(df: DataFrame, sample: int | None = None, compat: str = "strict") -> DataFrame:
    """One row per text column with its type: ``INTEGER``, ``REAL`` or ``TEXT``.

    ``strict`` tests every value as a whole, ``prefix`` accepts any text with a leading number. All rows
    are looked at, unless the caller asks for a ``sample`` of that many rows. A column's type is its highest cell kind, so one
    maximum per column is all that is aggregated.
    """
    rows = df if sample is None else df.limit(sample)
    wide = rows.agg(*[F.max(cell_kind(F.col(f"`{name}`"), compat)).alias(name) for name in df.columns])

    def entry(position: int, name: str) -> Column:
        kind = F.when(F.col(f"`{name}`") == 1, "INTEGER").when(F.col(f"`{name}`") == 2, "REAL").otherwise("TEXT")
        return F.struct(F.lit(position).alias("position"), F.lit(name).alias("column_name"), kind.alias("type"))

    return wide.select(F.inline(F.array(*[entry(i, name) for i, name in enumerate(df.columns)])))


def cast_columns(df: DataFrame, types: dict[str, str], compat: str = "strict") -> DataFrame:
    """Cast text columns to the reported types. Cells that do not fit become NULL."""

    def cast(name: str) -> Column:
        value = blank_to_null(F.col(f"`{name}`"))
        kind = types.get(name, "TEXT")
        if kind == "INTEGER":
            value = parse_prefix_integer(value) if compat == "prefix" else value.try_cast("bigint")
        elif kind == "REAL":
            value = parse_prefix_number(value) if compat == "prefix" else value.try_cast("double")
        return value.alias(name)

    return df.select(*[cast(name) for name in df.columns])


def infer_types(df: DataFrame, sample: int | None = None, compat: str = "strict") -> DataFrame:
    """Text columns with their inferred types. The type report (one row per column) is collected."""
    report = type_report(df, sample, compat).collect()
    return cast_columns(df, {row["column_name"]: row["type"] for row in report}, compat)
