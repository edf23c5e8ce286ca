"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size: a start and a stride, both from the
shard's name. Shards take turns; at its turn a shard claims the first slot of its order that is still free. The full
table gives each shard the same number of slots but for one, and most slots keep their shard when a shard joins or
leaves. A row's place is the shard of slot ``hash(key) mod slots``: one look-up in a broadcast table, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=salt).digest(), "big")


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (its index) of every slot. Names must differ, there may not be more of them than slots."""
    if not _prime(slots):
        raise ValueError(f"the number of slots must be prime, not {slots}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most one per slot")
    place = [_number(s, b"start") % slots for s in shards]
    stride = [_number(s, b"stride") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + stride[k]) % slots
            owner[place[k]] = k
            left -= 1
            if not left:
                return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    owner = fill_table(shards, slots)
    schema = T.StructType([T.StructField("slot", T.IntegerType(), False), T.StructField("shard", T.StringType(), False)])
    return spark.createDataFrame([(slot, shards[k]) for slot, k in enumerate(owner)], schema)


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row.

    Equal keys share a shard; a null key part hashes as null, so null keys share one too; empty texts are keys like any
    other; repeated rows go together; an empty table stays empty. Existing columns with the two output names are
    replaced. The broadcast table has ``slots`` rows, whatever the data.
    """
    columns = [df[f"`{c}`"] for c in df.columns if c.lower() not in (slot.lower(), shard.lower())]
    hashed = df.select(*columns, F.pmod(F.xxhash64(*[df[f"`{k}`"] for k in keys]), F.lit(slots)).cast("int").alias(slot))
    table = lookup_table(df.sparkSession, shards, slots).withColumnsRenamed({"slot": slot, "shard": shard})
    return hashed.join(F.broadcast(table), slot, "inner").select(*[F.col(f"`{c}`") for c in hashed.columns], shard)


def write_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], path: str, slots: int = SLOTS, rows_per_file: int = 1_000_000) -> None:
    """One folder ``shard=…`` per shard. Rows move by slot, so that a shard's rows spread over many tasks and none holds a whole shard."""
    placed = place(df, keys, shards, slots)
    placed.repartition("slot").drop("slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
