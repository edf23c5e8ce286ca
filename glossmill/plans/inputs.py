"""Inputs derived from the given tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.session import dealt

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of the documents, dealt over tasks if the session asks for it."""
    return dealt(table(spark, folder, "documents").select(*columns))


def stamp(c: Column | str) -> Column:
    return F.date_format(c, STAMP)


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as references, each with a hypothesis that an edit rule derives from it."""
    documents = texts(spark, folder, "doc_id", "lang", "text")
    text, turn = F.col("text"), F.col("doc_id") % 4
    hypothesis = (
        F.when(turn == 0, F.lower(text))
        .when(turn == 1, F.regexp_replace(text, r"^[^ ]* ", ""))
        .when(turn == 2, F.replace(F.replace(text, F.lit(" the "), F.lit(" a ")), F.lit(" de "), F.lit(" du ")))
        .otherwise(text)
    )
    return documents.select("doc_id", "lang", hypothesis.alias("hypothesis"), text.alias("reference"))


SQL_DOCUMENT_PAIRS = """
pairs AS (
  SELECT doc_id, lang, text AS reference,
    CASE doc_id % 4 WHEN 0 THEN lower(text)
      WHEN 1 THEN regexp_replace(text, '^[^ ]* ', '')
      WHEN 2 THEN replace(replace(text, ' the ', ' a '), ' de ', ' du ')
      ELSE text END AS hypothesis
  FROM documents)
"""


def line_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document as a pair; one line in two has its first two words swapped and one word dropped."""
    documents = texts(spark, folder, "doc_id", "lang", "text")
    lines = documents.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "reference"))
    swapped = F.regexp_replace(F.regexp_replace("reference", r"^([^ ]+) ([^ ]+) ", "$2 $1 "), r" [^ ]+$", "")
    hypothesis = F.when((F.col("doc_id") + F.col("line")) % 2 == 0, swapped).otherwise(F.col("reference"))
    return lines.select("doc_id", "lang", "line", hypothesis.alias("hypothesis"), "reference")


def dataset_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as data sets to register: a customer's orders by date are the versions of one data set."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("set-"), F.col("o_custkey").cast("string")).alias("name"),
        F.when(F.col("o_orderpriority").startswith("1"), "kaggle").when(F.col("o_orderpriority").startswith("2"), "etl").otherwise("derived").alias("source_type"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("size"),
    )


def dataset_versions(spark: SparkSession, folder: str) -> DataFrame:
    from glossmill.operators.registry import assign_versions

    return assign_versions(dataset_rows(spark, folder), None, ["created_at", "id"])


SQL_VERSIONS = """
versions AS (
  SELECT o_orderkey AS id, 'set-' || CAST(o_custkey AS VARCHAR) AS name,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'kaggle' WHEN o_orderpriority LIKE '2%' THEN 'etl' ELSE 'derived' END AS source_type,
    o_orderdate AS created_at, o_totalprice AS size,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version
  FROM orders)
"""


def run_links(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as links from a dataset version (order) to a run (supplier)."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("dataset_version_id"),
        F.concat(F.lit("run-"), F.col("l_suppkey").cast("string")).alias("run_id"),
        F.when(F.col("l_returnflag") == "A", "training").when(F.col("l_returnflag") == "N", "evaluation").otherwise("inference").alias("link_type"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_linenumber").alias("line"),
    )


SQL_LINKS = """
links AS (
  SELECT l_orderkey AS dataset_version_id, 'run-' || CAST(l_suppkey AS VARCHAR) AS run_id,
    CASE l_returnflag WHEN 'A' THEN 'training' WHEN 'N' THEN 'evaluation' ELSE 'inference' END AS link_type,
    l_shipdate AS created_at, l_linenumber AS line
  FROM lineitem)
"""


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trials: the supplier is the study, the order key the trial number."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("study"),
        F.when(F.col("l_suppkey") % 2 == 0, "MAXIMIZE").otherwise("MINIMIZE").alias("direction"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_linestatus") == "F", "COMPLETE").otherwise("PRUNED").alias("state"),
        F.create_map(
            F.lit("discount"), F.col("l_discount").cast("string"), F.lit("tax"), F.col("l_tax").cast("string")
        ).alias("params"),
    )


SQL_TRIALS = """
trials AS (
  SELECT l_suppkey AS study, CASE WHEN l_suppkey % 2 = 0 THEN 'MAXIMIZE' ELSE 'MINIMIZE' END AS direction,
    l_orderkey * 10 + l_linenumber AS number, l_extendedprice AS value,
    CASE WHEN l_linestatus = 'F' THEN 'COMPLETE' ELSE 'PRUNED' END AS state,
    l_discount AS discount, l_tax AS tax
  FROM lineitem)
"""


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Events as metric points: the user is the run, the event type the metric."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("key"),
        "value",
        F.col("ts").alias("at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("step"),
        "event_id",
    )


def run_status(spark: SparkSession, folder: str) -> DataFrame:
    """One status row per user: phase of the last event, best values as scores."""
    events = table(spark, folder, "events")
    phase = (
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "training").otherwise("evaluating")
    )

    def best(kind: str) -> Column:
        return F.max(F.when(F.col("event_type") == kind, F.col("value")))

    grouped = events.groupBy(F.col("user_id").alias("run")).agg(
        F.max_by(phase, F.struct("ts", "event_id")).alias("phase"),
        best("click").alias("bleu"),
        best("view").alias("chrf"),
        F.max("ts").alias("updated_at"),
        F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_last"),
        F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_first"),
    )
    return grouped.select(
        "run",
        "phase",
        F.create_map(F.lit("bleu"), F.col("bleu"), F.lit("chrf_pp"), F.col("chrf")).alias("metrics"),
        "updated_at",
        ((F.col("_last") - F.col("_first")) / 1_000_000).alias("duration_seconds"),
    )


SQL_STATUS = """
status AS (
  SELECT user_id AS run,
    arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'training' ELSE 'evaluating' END,
      (ts, event_id)) AS phase,
    max(CASE WHEN event_type = 'click' THEN value END) AS bleu,
    max(CASE WHEN event_type = 'view' THEN value END) AS chrf,
    max(ts) AS updated_at,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_seconds
  FROM events GROUP BY user_id)
"""


def status_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Events as status updates: a purchase completes the run, everything else keeps it running."""
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise("running")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("run"), status.alias("status"), F.col("ts").alias("at"), "event_id"
    )


LOG_LINES = [
    "an ERROR in step", "Exception caught", "Traceback (most recent call last)", "download failed", "---> 12 run()", "RuntimeError: out of memory",
    "ValueError: shape", "TypeError: none", "AttributeError: fit", "ImportError: peft", "ModuleNotFoundError: x", "epoch done", "warning: slow disk", "loss 0.25", "--> next",
]


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as log entries of the user's run, some with words of an error; error events go to stderr."""
    line = F.element_at(F.array(*[F.lit(x) for x in LOG_LINES]), (F.col("event_id") % len(LOG_LINES) + 1).cast("int"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream_name"),
        F.concat(line, F.lit(" "), F.col("props")).alias("data"),
        F.col("ts").alias("ts"),
    )


SQL_LOGS = f"""
logs AS (
  SELECT user_id AS run, event_id AS seq, CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream_name,
    list_extract({LOG_LINES}, CAST(event_id % {len(LOG_LINES)} + 1 AS INTEGER)) || ' ' || props AS data, ts
  FROM events)
"""


def kernel_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as kernel versions: one kernel per customer."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("kernel"),
        F.col("o_orderkey").alias("version"),
        status.alias("status"),
        F.col("o_orderdate").alias("timestamp"),
        F.substring("o_orderpriority", 3, 20).alias("strategy"),
        F.lit(None).cast("string").alias("run_id"),
    )


SQL_KERNELS = """
kernels AS (
  SELECT o_custkey AS kernel, o_orderkey AS version,
    CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' END AS status,
    o_orderdate AS timestamp, substr(o_orderpriority, 3, 20) AS strategy
  FROM orders)
"""


def artifact_files(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as files of the customer's run: checkpoints, models, caches and others."""
    key = F.col("o_orderkey").cast("string")
    path = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("checkpoints/checkpoint-"), key, F.lit("/weights.bin")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("output/model/part-"), key))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("hf_cache/blob-"), key))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("checkpoints/checkpoint-"), key, F.lit("/metrics.json")))
        .otherwise(F.concat(F.lit("notes/"), key))
    )
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("run"), path.alias("rel_path"), F.floor("o_totalprice").alias("bytes")
    )


SQL_FILES = """
files AS (
  SELECT o_custkey AS run, CAST(floor(o_totalprice) AS BIGINT) AS bytes,
    CASE o_orderkey % 5
      WHEN 0 THEN 'checkpoints/checkpoint-' || CAST(o_orderkey AS VARCHAR) || '/weights.bin'
      WHEN 1 THEN 'output/model/part-' || CAST(o_orderkey AS VARCHAR)
      WHEN 2 THEN 'hf_cache/blob-' || CAST(o_orderkey AS VARCHAR)
      WHEN 3 THEN 'checkpoints/checkpoint-' || CAST(o_orderkey AS VARCHAR) || '/metrics.json'
      ELSE 'notes/' || CAST(o_orderkey AS VARCHAR) END AS rel_path
  FROM orders)
"""
