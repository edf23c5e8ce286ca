"""Prefix trie of conversations by whole-sequence collapse.

A turn is known by the MD5 of its role and text, a sequence of turns by two 64-bit sums (exclusive or) over hashes of
(place, turn), which combine before a shuffle and run along a conversation. Identical conversations are collapsed to one
weighted sequence with the list of those that end there. Every prefix of every distinct sequence is a row (sequence,
depth, key); the keys of the prefixes one turn shorter are the proper prefixes, and sequences that an anti-join finds
among them are no leaves. Grouping the rows by key, with the weights of their sequences, gives the nodes.

Sums over subtrees need no row per pair of ancestor and descendant: every node belongs to the smallest leaf below it, so
that a leaf owns the lower end of its path. The sum of a subtree is that of all its leaves' own nodes, less what its own
leaf owns above it.

Nothing gathers a conversation, a common prefix or a group of copies in one task: turns are numbered by ranges, sums
along a conversation run in blocks of ``BLOCK`` turns, list pieces hold the members of at most 256 consecutive ids, and
counts are combined before each shuffle. A digest of a list is one chain of bytes by definition; its pieces stream
through one task in order, without being held.

Defined cases: rows without a conversation are left out; null roles and texts count as empty; turns of one conversation
with equal place come in the order of their MD5; a conversation without turns ends at the root; an empty table has no
root and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.tables import only, stored
from glossmill.operators.keyed import sequence_per_key

BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["a", "b", "depth"]


def marked(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, id, words): turns numbered from 1 in the order of ``turn`` (null first), with the MD5 of role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    both = F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary")))
    rows = turns.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), both.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    return sequence_per_key(rows, ["conv_id"], ["turn", "id"], "depth").select("conv_id", "depth", "id", "words")


def with_heads_of(turns: DataFrame, other: Column, length: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's first turns, and all their ids: the first ``length`` turns, at most
    ``longest``, of conversation ``other`` (fewer if it has fewer), then the own ones after their first ``length``."""
    start = F.array_sort(F.collect_list(F.struct("depth", "id", "words")))
    heads = turns.where(F.col("depth") <= longest).groupBy(F.col("conv_id").alias("other")).agg(start.alias("head"))
    ids = turns.where("depth = 1").select("conv_id")
    numbered = lambda df: df.withColumns({"other": other, "length": length.cast("long")}).join(heads.hint("merge"), "other", "left")
    taken = F.slice("head", F.lit(1), F.col("length").cast("int"))
    given = numbered(ids).select("conv_id", F.inline(taken))
    shift = F.col("length") - F.least("length", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")))
    own = numbered(turns).where("depth > length").select("conv_id", (F.col("depth") - shift).alias("depth"), "id", "words")
    return given.unionByName(own), ids


def _hashes() -> dict[str, Column]:
    return {"own_a": F.xxhash64("depth", "id"), "own_b": F.xxhash64("id", F.lit(11), "depth")}


def _running(df: DataFrame, key: str, sums: dict[str, tuple], before: bool) -> DataFrame:
    """Sums along each key by depth, up to a row or up to the row before; ``sums`` is out: (function, column).

    Rows are summed within blocks of depths, and the totals of the earlier blocks of the key are added.
    """
    cut = df.withColumn("_block", F.floor((F.col("depth") - 1) / BLOCK))
    inside = Window.partitionBy(key, "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "_block").agg(*[f(c).alias(f"_{out}") for out, (f, c) in sums.items()])
    shifts = totals.select(key, "_block", *[f(f"_{out}").over(earlier).alias(f"_{out}") for out, (f, _) in sums.items()]).where("_block > 0")
    rows = cut.withColumns({out: F.coalesce(f(c).over(inside), F.lit(0)) for out, (f, c) in sums.items()}).join(shifts.hint("merge"), [key, "_block"], "left")
    both = {out: F.coalesce(F.col(f"_{out}"), F.lit(0)) for out in sums}
    added = {out: F.col(out).bitwiseXOR(x) if sums[out][0] is F.bit_xor else F.col(out) + x for out, x in both.items()}
    return rows.withColumns(added).drop("_block", *[f"_{out}" for out in sums])


def collapse(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identical conversations as one: (a, b, depth, rep, weight), the smallest id standing for all, and the list pieces
    (a, b, depth, part, ids) of the conversations that end there, in ascending order."""
    none = F.lit(0).cast("long")
    rows = turns.select("conv_id", *[c.alias(n[-1]) for n, c in _hashes().items()], F.lit(1).cast("long").alias("depth"))
    whole = rows.unionByName(ids.select("conv_id", none.alias("a"), none.alias("b"), none.alias("depth"))).groupBy("conv_id")
    ends = stored(whole.agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("depth").alias("depth")), "conversation-ends")
    sequences = ends.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    return stored(sequences, "sequences"), ends.groupBy(*KEY, F.shiftright("conv_id", 8).alias("part")).agg(listed.alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256) of the comma-joined lists; a list streams through one task, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in last), pa.array([state.hexdigest()])], [*KEY, "ends_sha256"])
        for batch in batches:
            done: list[pa.RecordBatch] = []
            for *key, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if key != last:
                    if state is not None:
                        done.append(row())
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield row()

    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "part", "ids")
    return ordered.mapInArrow(run, "a bigint, b bigint, depth bigint, ends_sha256 string")


def _paths(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """(rep, depth, a, b, parent's a and b, words, weight): every prefix of every distinct sequence, the root aside."""
    rows = turns.withColumnRenamed("conv_id", "rep").join(sequences.select("rep", "weight").hint("merge"), "rep").withColumns(_hashes())
    run = _running(rows, "rep", {"a": (F.bit_xor, "own_a"), "b": (F.bit_xor, "own_b")}, before=False)
    return run.select("rep", *KEY, F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"), "words", "weight")


def _built(turns: DataFrame, ids: DataFrame) -> DataFrame:
    turns = stored(turns, "marked-turns")
    sequences, pieces = collapse(turns, ids)
    paths = stored(_paths(turns, sequences), "paths")
    shorter = paths.select(F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")).distinct()
    leaves = stored(sequences.join(shorter.hint("merge"), KEY, "left_anti").select("rep", F.lit(True).alias("leaf")), "leaves")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = sequences.select("rep", zero.alias("depth"), zero.alias("a"), zero.alias("b"), null.alias("up_a"), null.alias("up_b"), zero.alias("words"), "weight")
    rows = stored(paths.unionByName(roots).join(leaves.hint("merge"), "rep", "left"), "prefixes")
    nodes = rows.groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("rep"))).alias("owner"),
        F.max("words").alias("words"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
    )
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    owned = nodes.groupBy(F.col("owner").alias("rep")).agg(F.sum("saved").alias("saved"))
    below = rows.where("leaf").join(owned.hint("merge"), "rep").groupBy(*KEY).agg(F.sum("saved").alias("below"))
    above = _running(nodes.select("owner", *KEY, "saved"), "owner", {"above": (F.sum, "saved")}, before=True)
    sums = below.join(above.select(*KEY, "above").hint("merge"), KEY).select(*KEY, (F.col("below") - F.col("above")).alias("saved_tokens"))
    up = [F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")]
    inner = nodes.where("depth > 0").select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    made = nodes.join(sums.hint("merge"), KEY).join(inner.hint("merge"), KEY, "left").join(digests(pieces).hint("merge"), KEY, "left")
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return made.join(parents.hint("merge"), ["up_a", "up_b", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per distinct prefix, from marked turns (conv_id, depth, id, words) and the ids of all conversations.

    A node is named by its smallest member and its depth. ``n_leaves`` and ``saved_tokens`` are over its subtree: what a
    store of the trie holds once instead of once per conversation.
    """
    return only(turns.sparkSession, "conversation-trie", lambda: _built(turns, ids))


def with_turns(nodes: DataFrame, turns: DataFrame, originals: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Nodes with role and text of their last turn (null at the root), found by the turn's MD5."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    both = F.unhex(F.md5(F.concat(*[F.md5(x.cast("binary")) for x in said]).cast("binary")))
    texts = originals.select(both.alias("id"), said[0].alias("role"), said[1].alias("text")).groupBy("id").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return nodes.join(turns.select("conv_id", "depth", "id"), ["conv_id", "depth"], "left").join(texts, "id", "left").drop("id")
