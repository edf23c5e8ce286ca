"""Splits, folds, shards and shuffles that depend on a key's hash alone, so they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 1_000_000


def bucket_of(keys: list[str], buckets: int, seed: int) -> Column:
    """A number below ``buckets`` from the first 48 bits of the MD5 of seed and keys, so other engines can repeat it."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % buckets


def split_by_hash(df: DataFrame, keys: list[str], fraction: float = 0.1, seed: int = 42, out: str = "part") -> DataFrame:
    """Marks each row ``validation`` (the given fraction) or ``train``; no shuffle."""
    held_out = bucket_of(keys, STEPS, seed) < int(round(fraction * STEPS))
    return df.withColumn(out, F.when(held_out, F.lit("validation")).otherwise(F.lit("train")))


def assign_folds(df: DataFrame, keys: list[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, bucket_of(keys, k, seed).cast("int"))


def cap_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` evaluation rows in a stated order."""
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """All rows in a random order that the seed fixes."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def shard(df: DataFrame, keys: list[str], rank: int, world: int, seed: int = 42) -> DataFrame:
    """The rows of one worker out of ``world``; the shards are disjoint and cover everything."""
    if not 0 <= rank < world:
        raise ValueError(f"rank {rank} is not below world size {world}")
    return df.where(bucket_of(keys, world, seed) == rank)


def with_shard(df: DataFrame, keys: list[str], world: int, seed: int = 42, out: str = "shard") -> DataFrame:
    return df.withColumn(out, bucket_of(keys, world, seed).cast("int"))
