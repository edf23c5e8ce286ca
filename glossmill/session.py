"""Session helpers: one for local runs, one for the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "glossmill", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own session."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``checkpoint()`` writes to.

    The session's own setting wins. A temporary folder is made only in local mode; on a cluster a
    missing setting is an error, because executors cannot read the driver's local disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="glossmill-checkpoint-")
    context.setCheckpointDir(wanted)
    return wanted


DEAL = "spark.glossmill.deal"


def dealt(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt in turn over ``parts`` tasks, else over as many as the session's ``spark.glossmill.deal`` says.

    Without either the rows stay where the scan puts them, which is right for tables of many files or row groups. Dealing
    pays where a few large row groups would keep all but a few tasks idle; it moves every row once, so cut the columns first.
    """
    wanted = parts or int(df.sparkSession.conf.get(DEAL, None) or 0)
    return df.repartition(wanted) if wanted else df


ROWS_PER_TASK = 250_000


@contextmanager
def tasks_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what runs inside have tasks of about ``ROWS_PER_TASK`` of ``rows``, so that no task's memory grows with the input.

    Spark does not merge their partitions; small inputs have no more than the session's partitions or its cores. Only what is
    materialised inside is run so.
    """
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.shuffle.partitions": str(max(1, least, -(-rows // ROWS_PER_TASK))), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that iterations keep a short lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
