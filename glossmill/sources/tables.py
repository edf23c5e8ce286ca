"""Stored tables: write with metadata, ingest a folder, count, merge and fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glossmill.sources.readers import base_name, list_files, read_table_csv


def save_table(df: DataFrame, path: str, source: str, created_at: str, mode: str = "errorifexists") -> DataFrame:
    """Write a table as Parquet, with its metadata in ``<path>/_metadata``. Returns the metadata.

    Rows are counted while they are written, so the data is read once.
    """
    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    rows = [
        ("source_file", source),
        ("created_at", created_at),
        ("row_count", str(seen.get["rows"])),
        ("table_name", base_name(path)),
    ]
    metadata = df.sparkSession.createDataFrame(rows, "key string, value string")
    metadata.coalesce(1).write.mode("overwrite").parquet(f"{path}/_metadata")
    return metadata


def ingest_dir(
    spark: SparkSession, folder: str, target: str, created_at: str, compat: str = "strict"
) -> DataFrame:
    """Every CSV of a folder as a typed table below ``target``; returns rows per table."""
    files = [path for path in list_files(spark, f"{folder}/*") if path.lower().endswith(".csv")]
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    counts = []
    for path in files:
        name = base_name(path)[: -len(".csv")]
        table = read_table_csv(spark, path, typed=True, compat=compat)
        metadata = save_table(table, f"{target}/{name}", path, created_at)
        counts.append(metadata.where("key = 'row_count'").select(F.lit(name).alias("table_name"), F.col("value").cast("bigint").alias("row_count")))
    return reduce(DataFrame.unionByName, counts)


def user_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables whose name does not start with an underscore."""
    return {name: df for name, df in tables.items() if not name.startswith("_")}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table. Counting is pushed to the files' own row counts where they have them."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in user_tables(tables).items()
    ]
    return reduce(DataFrame.unionByName, counts)


def table_columns(tables: dict[str, DataFrame]) -> dict[str, list[tuple[str, str, int]]]:
    """Name, type and position of the columns of each table."""
    return {
        name: [(field.name, field.dataType.simpleString(), i) for i, field in enumerate(df.schema)]
        for name, df in user_tables(tables).items()
    }


def merge_tables(stores: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Append tables of the same name over several stores; columns that one side lacks are NULL."""
    merged: dict[str, DataFrame] = {}
    for store in stores:
        for name, df in user_tables(store).items():
            known = merged.get(name)
            merged[name] = df if known is None else known.unionByName(df, allowMissingColumns=True)
    return merged


def file_checksum(spark: SparkSession, pattern: str) -> DataFrame:
    """SHA-256 of each file. A file is one value here: for large tables use ``table_fingerprint``."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies the content of a table, whatever the order of its rows.

    Count, XOR and sum of a 64-bit row hash; one pass, nothing but three numbers is shuffled.
    """
    row_hash = F.xxhash64(*[F.col(f"`{name}`") for name in df.columns])
    hashed = df.select(row_hash.alias("h"))
    total = F.sum(F.col("h").cast("decimal(20,0)"))
    return hashed.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("h").alias("hash_xor"),
        F.pmod(total, F.lit(2**61).cast("decimal(20,0)")).cast("bigint").alias("hash_sum"),
    )
