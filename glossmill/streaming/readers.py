"""Streaming readers for folders of csv, json and Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}


def stream_any(
    spark: SparkSession, folder: str, schema: StructType | str, kind: str, files_per_trigger: int | None = None
) -> DataFrame:
    """New files of a folder as a stream. The schema is always given: a stream never infers it."""
    reader = spark.readStream.schema(schema).format(FORMATS[kind])
    if FORMATS[kind] == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", '"')
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)
