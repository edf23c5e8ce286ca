"""Per-key building blocks that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SIZE = 10_000


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key.

    Up to the session's ``spark.sql.optimizer.windowGroupLimitThreshold``, Spark keeps at most ``n`` rows per key and
    task before the shuffle, so a hot key stays small.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``table``, whose keys are unique. NULL keys match each other."""
    renamed = table.withColumnsRenamed({key: f"_key_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_key_{key}")) for key in keys]
    return df.join(renamed, same, "left").drop(*[f"_key_{key}" for key in keys])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def collect_paged(df: DataFrame, keys: list[str], item: Column, order: list[str], out: str = "items", page_size: int = PAGE_SIZE) -> DataFrame:
    """Sorted lists of ``item`` per key, in pages of ``page_size`` rows: (keys, page, items), whatever the size of a key.

    Pages are cut by position in the given order, page 0 first, so no list is longer than a page and all rows are kept.
    NULL items are left out, their key stays.
    """
    numbered = sequence_per_key(df, keys, order, "_place")
    page = F.floor((F.col("_place") - 1) / page_size).cast("int")
    return numbered.withColumn("page", page).groupBy(*keys, "page").agg(F.array_sort(F.collect_list(item)).alias(out))


def _plain(df: DataFrame, name: str) -> Column:
    """A key column as Arrow can compare it: numbers, texts and times as they are, the rest as text."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (column + 0.0).cast("string")  # NaN equals NaN here, and -0.0 equals 0.0
    return F.to_json(F.struct(column)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)) else column


def _begins(batch: pa.RecordBatch, keys: list[int], last: list) -> np.ndarray:
    """Whether each row's key differs from the row before; ``last`` is the key before the batch."""
    fresh = np.zeros(batch.num_rows, bool)
    for k, before in zip(keys, last):
        column = batch.column(k)
        null, values = column.is_null().to_numpy(zero_copy_only=False), pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
        fresh[1:] |= values.to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
        fresh[0] |= column[0].as_py() != before
    return fresh


def sequence_per_key(df: DataFrame, keys: list[str], order: list[str], out: str = "sequence") -> DataFrame:
    """1, 2, 3, … within each key in ascending order of the given columns, NULL first, without a whole key in one task.

    Rows are dealt by ranges of the whole (key, order) tuple, whose splitters Spark takes from a sample, so that a hot
    key is cut wherever its rows differ in any column of the order. Each task counts along its sorted rows; only the key
    that a task begins with can have begun in an earlier one, and the rows it has there are added (two rows a task).
    Nothing runs before the result is asked for; the input is read once for the sample and once for the rows, and both
    branches below read one exchange, which holds because the Python step keeps its columns from being pruned.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorting = [F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]]
    compared = [f"_same_{k}" for k in range(len(keys))]
    ranged = df.withColumns({name: _plain(df, key) for name, key in zip(compared, keys)}).repartitionByRange(parts, *sorting).sortWithinPartitions(*sorting).withColumn("_task", F.spark_partition_id())
    at = [ranged.columns.index(name) for name in compared]
    names, width = [*df.columns, "_task", "_place", "_first", "_edge"], len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, first, held = [None] * len(at), 0, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = _begins(batch, at, last)
            if held is None:
                begins[0] = True
            starts = np.flatnonzero(begins)
            group = np.cumsum(begins) - 1  # -1: the group of the batch before goes on
            place = np.arange(n) - np.where(group >= 0, starts[np.maximum(group, 0)] if len(starts) else 0, -count) + 1
            own = (group < (1 if held is None else 0)) & first
            edge = np.zeros(n, bool)
            edge[:-1] = own[:-1] & ~own[1:]
            if held is not None:  # the row before ends the first group if a new one begins here
                yield _marked(held, names, ends=first and begins[0])
            made = pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(width)), batch.column(batch.num_columns - 1), pa.array(place), pa.array(own), pa.array(edge)], names
            )
            yield made.slice(0, n - 1)
            held, last, count, first = made.slice(n - 1), [batch.column(k)[n - 1].as_py() for k in at], int(place[-1]), bool(own[-1])
        if held is not None:
            yield _marked(held, names, ends=True)

    schema = T.StructType([*df.schema.fields]).add("_task", T.IntegerType()).add("_place", T.LongType()).add("_first", T.BooleanType()).add("_edge", T.BooleanType())
    rows = ranged.mapInArrow(run, schema)
    # The first and the last key of every task with their rows there: what earlier tasks have of the same key.
    earlier = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_edge").select(*[f"`{k}`" for k in keys], "_task", "_place", "_first")
    before = ends.withColumn("_before", F.sum("_place").over(earlier)).where("_first and _before is not null")
    joined = rows.join(before.select(F.col("_task"), "_first", "_before"), ["_task", "_first"], "left")
    return joined.select(*[f"`{c}`" for c in df.columns], (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(out))


def _marked(row: pa.RecordBatch, names: list[str], ends: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([bool(ends)])], names)
