"""Parent chains of dataset versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import cut, tasks_for


def leaves(df: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Rows that are nobody's parent."""
    parents = df.where(F.col(parent).isNotNull()).select(F.col(parent).alias(key)).distinct()
    return df.join(parents, key, "left_anti").select(key)


def lineage(df: DataFrame, key: str = "id", parent: str = "parent_id", starts: DataFrame | None = None) -> DataFrame:
    """Every start row with its ancestors: (start, depth, node), depth 0 being the start itself.

    Starts default to the leaves. Jumps double in length each round, so a chain of depth d takes
    log2(d) rounds, and each result row is made and stored once. Nodes leave the jump table when they
    pass the root, which also takes the children of a popular root out of the joins. Without a cycle
    the table shrinks in every round, as the nodes next to those that left are the next to leave; when
    it does not, what is left leads into a cycle, which is an error.

    ``df`` is computed once, and the tasks of every step follow the rows that it joins.
    """
    spark = df.sparkSession
    df = cut(df.select(key, parent))
    rows = df.count()
    with tasks_for(spark, rows):
        jumps = cut(df.where(F.col(parent).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("above")))
        first = (leaves(df, key, parent) if starts is None else starts.select(key)).select(F.col(key).alias("start"))
        known = cut(first.select("start", F.lit(0).cast("long").alias("depth"), F.col("start").alias("node")))
    stride, left, found = 1, jumps.count(), known.count()
    while left:
        with tasks_for(spark, max(rows, found)):
            further = cut(known.join(jumps, "node").select("start", (F.col("depth") + stride).alias("depth"), F.col("above").alias("node")))
            known = known.unionByName(further)
            second = jumps.select(F.col("node").alias("above"), F.col("above").alias("far"))
            jumps = cut(jumps.join(second, "above").select("node", F.col("far").alias("above")))
        stride *= 2
        found += further.count()
        before, left = left, jumps.count()
        if left >= before:
            raise ValueError(f"{left} rows lead into a cycle of parents")
    with tasks_for(spark, max(rows, found)):
        return cut(known.join(df.select(F.col(key).alias("node")), "node", "left_semi").select("start", "depth", "node"))


def lineage_text(chains: DataFrame, label: str, page_size: int = 10_000) -> DataFrame:
    """One text per start and page of ``page_size`` steps, ``a:3 <- a:2 <- a:1``; page 0 begins at the start."""
    pages = chains.withColumn("page", F.floor(F.col("depth") / page_size))
    ordered = F.array_sort(F.collect_list(F.struct("depth", F.col(label).alias("label"))))
    return pages.groupBy("start", "page").agg(F.array_join(F.transform(ordered, lambda e: e["label"]), " <- ").alias("lineage"))


