"""What the operators share on the Spark side: reading a table, learning splits, stored intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.session import ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")).cast("string")) % parts


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate result in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# The folders that the innermost ``only`` has to delete.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it is done, not when its garbage is collected."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and Spark knows the true size of the result."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if _scratch.get() is not None:
        _scratch.get().append(path)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``build``, whose own stored tables are deleted once the result is written."""
    folders: list[str] = []
    token = _scratch.set(folders)
    try:
        made = build()
    finally:
        _scratch.reset(token)
    result = stored(made, name)
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result
