"""Connected components of a link table: contraction inside tasks, then alternating stars, every round in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.tables import stored

TASK_LINKS = 1 << 20


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) of every vertex that is not the smallest itself."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = ends[: len(u)], ends[len(u) :], np.arange(len(ids))
    while len(a):
        least = np.minimum(label[a], label[b])
        for side in (a, b):  # roots are linked, and paths cut short until none is left
            np.minimum.at(label, label[side], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    more = np.flatnonzero(label != np.arange(len(ids)))
    return ids[more], ids[label[more]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """A star for each component of the links of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_labels(*(np.concatenate(x) for x in zip(*held)))], ["u", "v"])

    return edges.select("u", "v").coalesce(tasks).mapInArrow(run, "u bigint, v bigint")


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one link at most to a smaller one, which itself has none: then all components are stars."""
    ends = F.array(F.struct(F.col("u").alias("vertex"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("vertex"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = edges.select(F.inline(ends)).groupBy("vertex").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component) for every id that is not the smallest of its component; ids without a row are their own.

    ``links`` holds undirected links of integer ids; null ends, loops and repeated links are ignored. Tasks of about
    ``TASK_LINKS`` links find the components of their own first; where one task has all, nothing is left. Rounds then
    grow with the logarithm of the longest chain. A vertex with very many links is combined before each shuffle and its
    join may be split by the engine, so no task needs all of them.
    """
    usable = F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))
    edges = stored(links.where(usable).select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v")), "links")
    tasks = -(-edges.count() // TASK_LINKS)
    edges = stored(_contracted(edges, max(tasks, 1)), "stars")
    while tasks > 1 and not _stars(edges):
        edges = stored(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
