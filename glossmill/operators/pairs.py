"""Sentence pairs: find the two sides, clean, look at them, align predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fragments that mark a source or a target column.
SOURCE_FRAGMENTS = ["source", "src", "input"]
TARGET_FRAGMENTS = ["target", "tgt", "output", "english"]


def detect_pair_columns(columns: list[str]) -> tuple[str, str]:
    """Source and target column by name; the last match wins, else the first two columns serve."""

    def last(fragments: list[str], blocked: list[str]) -> str | None:
        hits = [
            c for c in columns
            if any(f in c.lower() for f in fragments) and not any(f in c.lower() for f in blocked)
        ]
        return hits[-1] if hits else None

    source, target = last(SOURCE_FRAGMENTS, []), last(TARGET_FRAGMENTS, SOURCE_FRAGMENTS)
    if source is None or target is None:
        if len(columns) < 2:
            raise ValueError(f"need a source and a target column, have {columns}")
        return columns[0], columns[1]
    return source, target


def to_pairs(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The two detected sides as ``source`` and ``target``, after the columns to keep."""
    keep = keep or []
    source, target = detect_pair_columns([c for c in df.columns if c not in keep])
    return df.select(*keep, F.col(source).alias("source"), F.col(target).alias("target"))


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns; names that the table lacks are ignored."""
    return df.withColumnsRenamed(mapping)


def clean_pairs(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return df.dropna(subset=[source, target])


def select_limit(df: DataFrame, columns: list[str], n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows of some columns, in a stated order."""
    return df.orderBy(*order).limit(n).select(*columns)


def preview(df: DataFrame, columns: list[str], n: int = 5, width: int = 80, order: list[str] | None = None) -> DataFrame:
    """The first rows with long texts cut for display."""
    first = df.orderBy(*order).limit(n) if order else df.limit(n)
    return first.withColumns({c: F.substring(c, 1, width) for c in columns})


def run_sql(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """A SQL query over the given tables, each named in braces: ``SELECT … FROM {pairs}``."""
    if not tables:
        raise ValueError("no tables given")
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(text, **tables)


def align(hypotheses: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    """Hypothesis next to its reference, matched by key and never by position."""
    return hypotheses.join(references, on)
