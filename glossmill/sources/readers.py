"""Batch readers. Listing touches file names only; contents are always read by executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.status import normalise_status
from glossmill.functions.numbers import parse_prefix_number
from glossmill.sources.schema import blank_to_null, infer_types, name_mapping, sanitize_names

METRICS = "map<string,double>"
STATUS = (
    "phase string, progress double, currentEpoch int, totalEpochs int, lastCheckpoint string, "
    "updated_at timestamp, duration_seconds double, metrics map<string,double>, error string"
)
LOG_ENTRY = "struct<stream_name:string,time:double,data:string>"
SUBMISSION_COLUMNS = ["fileName", "date", "description", "status", "publicScore", "privateScore"]


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def list_tree(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths below a folder, at any depth, that end in ``suffix``, relative to the folder and sorted."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = files.makeQualified(root).toString().rstrip("/") + "/"
    found, listing = [], files.listFiles(root, True)
    while listing.hasNext():
        path = listing.next().getPath().toString()
        if path.endswith(suffix):
            found.append(path.removeprefix(base))
    return sorted(found)


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The names in the header line, as written."""
    reader = spark.read.option("quote", '"').option("escape", '"')
    first = reader.csv(path, header=False).first()
    if first is None:
        raise ValueError(f"{path}: a CSV file needs a header and a data row")
    return ["" if name is None else name for name in first]


def read_table_csv(spark: SparkSession, path: str, typed: bool = False, compat: str = "strict") -> DataFrame:
    """A CSV with header as text columns: cells trimmed, empty cells NULL, names sanitized.

    Every line is one record. ``typed`` also infers the column types.
    """
    names = sanitize_names(csv_header(spark, path))
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    reader = spark.read.schema(schema).option("quote", '"').option("escape", '"')
    raw = reader.csv(path, header=True, enforceSchema=True)
    if raw.isEmpty():
        raise ValueError(f"{path}: a CSV file needs a header and a data row")
    table = raw.select(*[blank_to_null(F.col(name)).alias(name) for name in names])
    return infer_types(table, compat=compat) if typed else table


def csv_name_mapping(spark: SparkSession, path: str) -> DataFrame:
    header = csv_header(spark, path)
    return name_mapping(spark, header, sanitize_names(header))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file extension: csv, json or jsonl, else Parquet."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, quote='"', escape='"')
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files, each by its extension; columns are matched by name, and a file without one has NULL there."""
    parts = [read_any(spark, path).withColumn("source_path", F.lit(path)) for path in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_first(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """All files of the first pattern of the list that matches any."""
    for pattern in patterns:
        found = list_files(spark, pattern)
        if found:
            return read_all(spark, found)
    raise FileNotFoundError(f"no data found in {patterns}")


def split_paths(paths: list[str], need_train: bool = True) -> dict[str, list[str]]:
    """Train, validation and test files by name; without a train file the first file stands in."""

    def named(words: list[str]) -> list[str]:
        return [p for p in paths if any(word in p.lower() for word in words)]

    train = named(["train"])
    if not train:
        if need_train or not paths:
            raise FileNotFoundError("no training data file found")
        train = paths[:1]
    return {"train": train, "validation": named(["val", "dev"]), "test": named(["test"])}


def read_splits(spark: SparkSession, folder: str, fallback: bool = True) -> dict[str, DataFrame | None]:
    """The train, validation and test tables of a folder; a missing one is None."""
    chosen = split_paths(list_tree(spark, folder, ".csv"), need_train=not fallback)
    return {part: read_all(spark, [f"{folder}/{path}" for path in paths]).drop("source_path") if paths else None for part, paths in chosen.items()}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of a text file with an ascending ``line_id``."""
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines.where(F.trim("text") != "").select(F.monotonically_increasing_id().alias("line_id"), "text")


def _whole_files(spark: SparkSession, folder: str, name: str, depth: str = "*") -> DataFrame:
    """Small files, one row each, with the name of the run folder that holds them."""
    pattern = f"{folder}/{depth}/{name}"
    if not list_files(spark, pattern):
        return spark.createDataFrame([], "value string, run string")
    files = spark.read.text(pattern, wholetext=True)
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return files.select("value", run.alias("run"))


def read_run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics per run folder: ``metrics.json``, else ``eval_results.json``; broken files give NULL."""

    def parsed(name: str, column: str) -> DataFrame:
        files = _whole_files(spark, folder, name)
        return files.select("run", F.from_json("value", METRICS).alias(column))

    main, spare = parsed("metrics.json", "main"), parsed("eval_results.json", "spare")
    both = main.join(spare, "run", "full_outer")
    return both.select("run", F.coalesce("main", "spare").alias("metrics"))


def read_run_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status per run folder; a broken file, or one without a phase, has phase ``unknown``."""
    files = _whole_files(spark, folder, "status.json")
    status = files.select("run", F.from_json("value", STATUS).alias("s")).select("run", "s.*")
    phase = F.coalesce(F.nullif(F.col("phase"), F.lit("")), F.lit("unknown"))
    return status.withColumn("phase", phase)


def log_entries(value: F.Column) -> F.Column:
    """The entries of a whole log text: a JSON array, else the lines that parse alone, else one JSON object."""
    whole = F.from_json(value, f"array<{LOG_ENTRY}>")
    body = F.regexp_replace(F.regexp_replace(value, r"^\[", ""), r"\]$", "")
    lines = F.transform(F.split(body, "\n"), lambda line: F.from_json(bare_log_line(line), LOG_ENTRY))
    good = F.filter(lines, lambda entry: entry["stream_name"].isNotNull() | entry["data"].isNotNull())
    parsed = F.coalesce(F.filter(whole, lambda entry: entry["stream_name"].isNotNull() | entry["data"].isNotNull()), F.array())
    array = F.ltrim(value).startswith("[") & (F.size(parsed) > 0)
    return F.when(array | (F.size(good) == 0), parsed).otherwise(good)


def bare_log_line(line: F.Column) -> F.Column:
    """One log line without the brackets and commas of the array around it."""
    return F.regexp_replace(F.trim(line), r"^[\[,]+\s*|\s*[\],]+$", "")


def read_logs(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Log entries of all ``<run>/*.log`` files.

    The default reads each file as one JSON text. ``lines=True`` reads line by line, so that a log of
    any size is split over tasks; it needs one entry per line, which is how kernels write them.
    """
    pattern = f"{folder}/*/*.log"
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run")
    if lines:
        entry = F.from_json(bare_log_line(F.col("value")), LOG_ENTRY)
        rows = spark.read.text(pattern).select(run, F.monotonically_increasing_id().alias("seq"), entry.alias("e"))
        return rows.where("e.stream_name is not null or e.data is not null").select("run", "seq", "e.*")
    files = spark.read.text(pattern, wholetext=True).select(run, log_entries(F.col("value")).alias("entries"))
    return files.select("run", F.posexplode("entries").alias("seq", "e")).select("run", "seq", "e.*")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """A submissions CSV: rows with at least four fields, normalised status, optional scores."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in SUBMISSION_COLUMNS])
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, quote='"', escape='"')
    kept = raw.where(F.col("status").isNotNull())
    return kept.select(
        "fileName",
        "date",
        F.coalesce("description", F.lit("")).alias("description"),
        normalise_status("status", "submission").alias("status"),
        parse_prefix_number("publicScore").alias("publicScore"),
        parse_prefix_number("privateScore").alias("privateScore"),
    )


def explode_json_map(df: DataFrame, column: str, value_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """A JSON object column as (key, value) rows, and the rows whose JSON is not an object."""
    parsed = df.withColumn("_map", F.from_json(F.col(column), f"map<string,{value_type}>"))
    others = [c for c in df.columns if c != column]
    good = parsed.where(F.col("_map").isNotNull()).select(*others, F.explode("_map").alias("key", "value"))
    return good, parsed.where(F.col("_map").isNull() & F.col(column).isNotNull()).drop("_map")
