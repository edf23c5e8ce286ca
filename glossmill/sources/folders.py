"""Many CSV files of many schemas in few jobs: files of one header are scanned together, whatever their number."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.sources.readers import list_files
from glossmill.sources.schema import blank_to_null, cast_columns, cell_kind, sanitize_names

KINDS = {0: "TEXT", 1: "INTEGER", 2: "REAL", 3: "TEXT"}
DDL = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double"}
METADATA = "table_name string, key string, path string, partition string, columns string, row_count long, source_folder string, created_at string"


def _key(path: Column) -> Column:
    """The file's name without its extension, as Spark writes it in ``_metadata`` (special characters escaped)."""
    return F.regexp_extract(path, r"(?i)([^/]+)\.csv$", 1)


def headers(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The first line that is not blank, per file: one job over all files, which looks at the first split of each."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where((F.col("at") == 0) & (F.trim("value") != "")).withColumn("place", F.monotonically_increasing_id())
    found = first.groupBy(_key(F.col("path")).alias("key")).agg(F.min_by("value", "place").alias("header"))
    return {row.key: row.header for row in found.collect()}  # a line per file


def _scan(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    """Rows of all files of one header as trimmed texts, with the key of their file."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    raw = spark.read.schema(schema).option("quote", '"').option("escape", '"').csv(files, header=True, enforceSchema=True)
    return raw.select(_key(F.col("_metadata.file_path")).alias(_unused("_key", names)), *[blank_to_null(F.col(f"`{c}`")).alias(c) for c in names])


def _unused(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def ingest_folder(spark: SparkSession, folder: str, target: str, created_at: str, compat: str = "strict") -> DataFrame:
    """Every CSV of a folder as a typed table below ``target``; returns the tables' metadata, also kept in ``_metadata``.

    One job reads the headers, one per header counts rows and finds the type of every column of every file, and one per
    (header, types) writes all its files, partitioned by table. A table's types come from all rows of its own file. A
    file without a header or a data row, and two files of one name, are refused before anything is written.
    """
    files = [path for path in list_files(spark, f"{folder}/*") if path.lower().endswith(".csv")]
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    uri = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    keys = {path: uri(path).toUri().toString().rsplit("/", 1)[-1][: -len(".csv")] for path in files}
    if len(set(keys.values())) < len(files):
        raise ValueError(f"{folder} has several files of one name")
    by_header: dict[str, list[str]] = {}
    found = headers(spark, files)
    for path in files:
        by_header.setdefault(found.get(keys[path], ""), []).append(path)
    if "" in by_header:
        raise ValueError(f"no header in {by_header['']}")

    plans: dict[tuple, list[tuple[str, int]]] = {}
    for header, paths in by_header.items():
        names = sanitize_names(next(csv.reader([header])))
        rows = _scan(spark, paths, names)
        key = rows.columns[0]
        kinds = [F.max(cell_kind(F.col(f"`{c}`"), compat)).alias(f"k{i}") for i, c in enumerate(names)]
        counted = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"), *kinds).collect()  # a row per file
        empty = {keys[p] for p in paths} - {r.key for r in counted}
        if empty:
            raise ValueError(f"no data row in {sorted(empty)}")
        for r in counted:
            plans.setdefault((tuple(names), tuple(KINDS[r[f"k{i}"]] for i in range(len(names)))), []).append((r.key, r.rows))

    by_key = {key: path for path, key in keys.items()}
    metadata = []
    for number, ((names, types), tables) in enumerate(sorted(plans.items())):
        rows = _scan(spark, [by_key[key] for key, _ in tables], list(names))
        key, partition = rows.columns[0], _unused("table_name", list(names))
        typed = cast_columns(rows, {**dict(zip(names, types)), key: "TEXT"}, compat)
        place = f"{target}/schema-{number:05d}"
        typed.withColumnRenamed(key, partition).write.mode("errorifexists").partitionBy(partition).parquet(place)
        columns = ", ".join(f"`{c}` {DDL[t]}" for c, t in zip(names, types))
        metadata += [(unquote(k), k, place, partition, columns, n, folder, created_at) for k, n in tables]
    result = spark.createDataFrame(metadata, METADATA)
    result.coalesce(1).write.mode("overwrite").parquet(f"{target}/_metadata")
    return result


def ingested(spark: SparkSession, target: str, table: str) -> DataFrame:
    """One table of an ingested folder; only its own files are read."""
    row = spark.read.schema(METADATA).parquet(f"{target}/_metadata").where(F.col("table_name") == table).first()
    if row is None:
        raise LookupError(f"no table {table} in {target}")
    # The schema is given, so that names such as 007 stay texts.
    rows = spark.read.schema(f"{row.columns}, `{row.partition}` string").parquet(row.path)
    return rows.where(F.col(f"`{row.partition}`") == row.key).drop(row.partition)
