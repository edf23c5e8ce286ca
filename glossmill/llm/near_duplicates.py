"""Near-duplicate groups by a chosen-path set similarity join on minwise tokens.

A document's set is its distinct five-word shingles. Equal sets are one class, stood for by its smallest id. Every set
has a signature of ``TOKENS`` minwise tokens. In each of ``TREES`` independent random trees a node picks two of the
token positions, and a set goes to one child per picked position, named by its token there: a pair that agrees on a
share s of its tokens stays together on a path of any depth with a probability near 0.9 at s = 0.75, and fails in all
four trees about once in ten thousand times. Nodes of at most ``GROUP`` sets are compared exhaustively, larger ones
branch on, until a node keeps most of its parent's sets: then they resemble each other and branching gains nothing.

Such a family may be large. It is cut into blocks, each compared exhaustively together with the family's pivots, which
all its blocks share; that joins what resembles many others. What is then outside the family's largest component is
compared with the whole family, in groups of bounded size. Nothing is dropped, and no group grows with a family.

Nodes are compared on signatures, with a threshold four standard deviations low, and yield no more links than they have
sets; the components of these links are the clusters. Every set is in one cluster, and inside clusters, again in groups
of bounded size, links are decided on the full shingle sets, so a set moves once however many nodes it was in.

Signatures and sets move rarely: nodes are lists of ids, a signature goes once to all nodes that begin with the same set
and once to all children of a set's nodes, and the texts of clustered sets are found through a bitmap of fixed size
before the join.

Defined cases: null or empty texts have an empty set and are linked with nothing; a null id is linked with nothing and
has a null component; repeated rows are repeated in the result; an empty table gives an empty result; columns other
than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W
from glossmill.llm.components import components
from glossmill.llm.tables import only, stored

WIDTH = 5
SIMILARITY = 75  # per cent
TOKENS = 128
TREES = 4
FIRST_DEPTH = 3
DEEPEST = 12
GROUP = 256
BLOCK = 2048  # signatures compared at once in a family
SET_BLOCK = 512  # sets compared at once in a large cluster
PIVOTS = 64
FILTER_BITS = 1 << 25
FAMILY_SHARE = 0.5
SKETCH_SIMILARITY = 0.60  # four standard deviations below the threshold at 128 tokens

_U = np.uint64


def _multipliers() -> np.ndarray:
    return W.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minwise tokens of each set; ``first`` is where each non-empty set begins."""
    out = np.empty((len(first), TOKENS), np.uint32)
    if len(first):
        for k, factor in enumerate(_multipliers()):
            out[:, k] = np.minimum.reduceat(((hashes * factor) >> _U(32)).astype(np.uint32), first)
    return out


def children(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two children of each row's node, by the token at the two positions that the node picks."""
    one = W.mix(nodes ^ _U(0xA24BAED4963EE407)) % _U(TOKENS)
    two = (one + _U(1) + W.mix(nodes ^ _U(0x9FB21C651E98DF25)) % _U(TOKENS - 1)) % _U(TOKENS)
    row = np.arange(len(nodes))
    return tuple(W.mix(nodes * _U(0xD6E8FEB86659FD93) + (at << _U(32)) + tokens[row, at.astype(np.int64)]) for at in (one, two))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, 128-bit mark of the set, signature) per row."""
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in W.blocks(batches, "text"):
            hashes, owner = W.shingles(data, offsets, WIDTH)
            n = len(offsets) - 1
            sizes = np.bincount(owner, minlength=n)
            full = np.flatnonzero(sizes)
            first = np.searchsorted(owner, full)
            marks = np.zeros((2, n), np.uint64)
            if len(full):
                marks[0, full] = np.add.reduceat(hashes, first)
                marks[1, full] = np.add.reduceat(W.mix(hashes ^ _U(0x2545F4914F6CDD1D)), first)
            made, at = [b""] * n, signatures(hashes, first)
            for k, row in enumerate(full.tolist()):
                made[row] = at[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes.astype(np.int64)), pa.array(W.signed(marks[0])), pa.array(W.signed(marks[1])), pa.array(made, pa.binary())],
                ["id", "n_shingles", "mark_a", "mark_b", "tokens"],
            )

    return source.mapInArrow(run, "id bigint, n_shingles bigint, mark_a bigint, mark_b bigint, tokens binary")


NODE = "node bigint, rep bigint"


def _first_nodes(classes: DataFrame) -> DataFrame:
    """(node, rep) of every class at the first depth, in all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, tokens = batch.column("rep").to_numpy(), _matrix(batch.column("tokens"))
            level = [np.full(len(reps), W.mix(np.array([tree + 1], np.uint64))[0]) for tree in range(TREES)]
            for _ in range(FIRST_DEPTH):
                level = [child for nodes in level for child in children(nodes, tokens)]
            if len(reps):
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(np.concatenate(level))), pa.array(np.tile(reps, len(level)))], ["node", "rep"])

    return classes.select("rep", "tokens").mapInArrow(run, NODE)


def _next_nodes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of all children, with the size of the parent. A set is in few nodes, so its tokens are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("nodes")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            tokens, rep = _matrix(batch.column("tokens"))[row], batch.column("rep").take(pa.array(row))
            for child in children(flat.field("node").to_numpy().view(np.uint64), tokens):
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(child)), rep, flat.field("size")], ["node", "rep", "parent"])

    own = members.groupBy("rep").agg(F.collect_list(F.struct("node", "size")).alias("nodes"))
    return own.join(classes.select("rep", "tokens"), "rep").mapInArrow(run, f"{NODE}, parent bigint")


def _sized(nodes: DataFrame) -> DataFrame:
    """Members of nodes with two sets or more, and the size of their node."""
    return nodes.join(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1").hint("merge"), "node")


def _whole(members: DataFrame) -> DataFrame:
    """(bucket, reps): the sets of every node in order; nodes that hold the same sets are one, those with the same first share a bucket."""
    lists = members.groupBy("node").agg(F.sort_array(F.collect_list("rep")).alias("reps")).select("reps").distinct()
    return lists.select(F.get("reps", F.lit(0)).alias("bucket"), "reps")


def _listed(groups: DataFrame) -> DataFrame:
    """(bucket, reps) of groups (name, rep), each in a bucket of its own."""
    return groups.groupBy(F.col("name").alias("bucket")).agg(F.sort_array(F.collect_list("rep")).alias("reps"))


def _split(families: DataFrame, block: int) -> DataFrame:
    """(name, rep): blocks of a family, each with the family's pivots."""
    blocks = F.ceil(F.col("size") / (block - PIVOTS))
    place = F.xxhash64("rep")
    pivot = F.pmod(F.xxhash64(place), F.lit(1 << 30)) * F.col("size") < PIVOTS * (1 << 30)
    wide = families.select("node", "rep", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(place, blocks)))).alias("block"))
    return wide.select(F.xxhash64("node", "block").alias("name"), "rep")


def _rest(families: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """(name, rep): what is outside the largest component of a family against all of the family, in blocks."""
    own = families.join(comps, "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("comp"))
    counts = own.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top")).select("node", "size", F.col("top.comp").alias("top"), (F.col("size") - F.col("top.n")).alias("left"))
    rows = own.join(most.where("`left` > 0"), "node")
    half = block // 2
    all_blocks, few_blocks = F.ceil(F.col("size") / half), F.ceil(F.col("left") / half)
    zero, place = F.lit(0).cast("long"), F.xxhash64("rep")
    each = rows.select("node", "rep", F.pmod(place, all_blocks).alias("x"), F.explode(F.sequence(zero, few_blocks - 1)).alias("y"))
    few = rows.where("comp != top").select("node", "rep", F.explode(F.sequence(zero, all_blocks - 1)).alias("x"), F.pmod(F.xxhash64(place), few_blocks).alias("y"))
    return each.unionByName(few).select(F.xxhash64("node", "x", "y").alias("name"), "rep").distinct()


def sketch_forest(reps: np.ndarray, label: np.ndarray, tokens: np.ndarray, lists: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what the signatures of the members of each list (places among ``reps``) connect, none inside a label."""
    label, out = label.copy(), []
    for own in lists:
        for k, one in enumerate(own[:-1].tolist()):
            other = own[k + 1 :]
            other = other[label[other] != label[one]]
            alike = other[(tokens[other] == tokens[one]).mean(axis=1) >= SKETCH_SIMILARITY]
            for j in alike.tolist():
                if label[j] != label[one]:
                    out.append((int(reps[one]), int(reps[j])))
                    label[label == label[j]] = label[one]
    return out


def _sketch_links(lists: DataFrame, classes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Links (a, b) that connect what the signatures of each list's sets connect, none inside a component of ``comps``.

    The lists of a bucket are compared together, so that a set's tokens go there once. A bucket has the nodes that begin
    with one set, at most a few hundred lists, or one block.
    """

    def run(lists: pa.Table, loaded: pa.Table) -> pa.Table:
        loaded = loaded.combine_chunks().sort_by("rep")
        reps, label = loaded.column("rep").to_numpy(), loaded.column("comp").to_numpy()
        if not len(reps):
            return _pairs([])
        tokens = _matrix(loaded.column("tokens").combine_chunks())
        own = lists.column("reps").combine_chunks()
        # An id that stands for several sets has a row for each.
        places = [np.flatnonzero(np.isin(reps, one.values.to_numpy())) for one in own]
        return _pairs(sketch_forest(reps, label, tokens, places))

    wanted = lists.select("bucket", F.explode("reps").alias("rep")).distinct()
    loaded = _labelled(wanted.join(classes.select("rep", "tokens"), "rep"), comps).select(F.col("bucket").alias("place"), "rep", "comp", "tokens")
    return lists.groupBy("bucket").cogroup(loaded.groupBy("place")).applyInArrow(run, "a bigint, b bigint").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _labelled(groups: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return groups.withColumn("comp", F.col("rep"))
    return groups.join(comps, "rep", "left").withColumn("comp", F.coalesce("component", "rep"))


def forest(reps: np.ndarray, comps: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a group, decided on whole sets; no link inside a component of ``comps``."""
    ids = np.unique(values, return_inverse=True)[1]
    sizes, label = np.diff(offsets), comps.copy()
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    out = []
    for k in range(len(reps) - 1):
        other = (label != label[k]) & (100 * np.minimum(sizes, sizes[k]) >= SIMILARITY * np.maximum(sizes, sizes[k]))
        other[: k + 1] = False
        if not other.any():
            continue
        own = ids[offsets[k] : offsets[k + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[ids], offsets[:-1], dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(other & (100 * common >= SIMILARITY * (sizes + sizes[k] - common))).tolist():
            if label[j] != label[k]:
                out.append((int(reps[k]), int(reps[j])))
                label[label == label[j]] = label[k]
    return out


def _links(groups: DataFrame, sets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Links (a, b) inside groups (name, rep), on the full sets (rep, shingles)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group.column("shingles").chunk(0)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        return _pairs(forest(group.column("rep").to_numpy(), group.column("comp").to_numpy(), values, offsets - offsets[0]))

    joined = _labelled(groups, comps).join(sets, "rep").select("name", "rep", "comp", "shingles")
    return joined.groupBy("name").applyInArrow(run, "a bigint, b bigint").distinct()


def _comps(links: DataFrame) -> DataFrame:
    return components(links, "a", "b").select(F.col("id").alias("rep"), "component")


def _joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components after some more links; the old ones are stars already, so few rounds are left."""
    if more.isEmpty():
        return comps
    return _comps(comps.select(F.col("rep").alias("a"), F.col("component").alias("b")).unionByName(more))


def _bitmap(ids: DataFrame, name: str) -> bytes:
    """Which of ``FILTER_BITS`` residues any id's hash has: four megabytes, however many ids there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[W.mix(batch.column(0).to_numpy().view(np.uint64)) % _U(FILTER_BITS)] = True
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["at", "bits"])

    parts = ids.select(name).mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    whole = np.zeros(FILTER_BITS // 64, np.int64)
    for at, bits in parts.collect():
        whole[at] = bits
    return whole.tobytes()


def _near(rows: DataFrame, bitmap: bytes) -> DataFrame:
    """Rows whose first column, an id, has its residue in the bitmap: all wanted ones and a few others."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            place = W.mix(batch.column(0).to_numpy().view(np.uint64)) % _U(FILTER_BITS)
            hit = (bits[place >> _U(3)] >> (_U(7) - (place & _U(7))).astype(np.uint8)) & 1 > 0
            if hit.any():
                yield batch.filter(pa.array(hit))

    return rows.mapInArrow(run, rows.schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, once: bool) -> DataFrame:
    """(rep, shingles) of the wanted ids; with ``once`` false, rows that repeat id and text are left out first.

    A bitmap keeps most other texts out of the shuffle; the join decides.
    """
    source = docs.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("text")).where("rep is not null")
    source = _near(source, _bitmap(wanted, "rep")).join(wanted.hint("merge"), "rep", "left_semi")
    source = source if once else source.dropDuplicates(["rep", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in W.blocks(batches, "text"):
            hashes, owner = W.shingles(data, offsets, WIDTH)
            sets = W.list_array(pa.array(W.signed(hashes)), np.searchsorted(owner, np.arange(len(offsets))))
            yield pa.RecordBatch.from_arrays([rows.column(0), sets], ["rep", "shingles"])

    return stored(source.mapInArrow(run, "rep bigint, shingles array<bigint>").where("size(shingles) > 0"), "shingle-sets")


def _merged(families: DataFrame) -> DataFrame:
    """(node, rep, size): families that share a set are one, named by one of their sets, so each set is in one family."""
    lows = families.join(families.groupBy("node").agg(F.min("rep").alias("low")), "node").select("rep", "low").distinct()
    heads = lows.groupBy("rep").agg(F.min("low").alias("head"), F.collect_list("low").alias("lows"))  # few: a set is in few nodes
    bridges = heads.select("head", F.explode("lows").alias("low")).where("head != low").select(F.col("low").alias("a"), F.col("head").alias("b")).distinct()
    joined = _comps(bridges).withColumnRenamed("rep", "head")
    named = heads.join(joined, "head", "left").select(F.coalesce("component", "head").alias("node"), "rep")
    return named.join(named.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "node")


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(rep, component) of all classes (rep, tokens) that some node pairs with another one."""
    members = stored(_sized(_first_nodes(classes)), "node-members")
    classes = stored(_near(classes, _bitmap(members, "rep")), "paired-classes")  # sets alone in all their nodes are done
    groups = _whole(members.where(F.col("size") <= GROUP))
    large, families = members.where(F.col("size") > GROUP), None
    for depth in range(FIRST_DEPTH + 1, DEEPEST + 1):
        if large.isEmpty():
            break
        deeper = stored(_sized(_next_nodes(large, classes)), "deeper-members")
        groups = groups.unionByName(_whole(deeper.where(F.col("size") <= GROUP)))
        big = deeper.where(F.col("size") > GROUP)
        family = big.where((F.col("size") > FAMILY_SHARE * F.col("parent")) | F.lit(depth == DEEPEST)).select("node", "rep", "size")
        families = family if families is None else families.unionByName(family)
        large = big.where(F.col("size") <= FAMILY_SHARE * F.col("parent"))
    if families is None:
        return _comps(stored(_sketch_links(stored(groups.distinct(), "lists"), classes, None), "sketch-links"))
    one = stored(_merged(families), "families")
    lists = stored(groups.distinct().unionByName(_listed(_split(one, BLOCK))), "lists")
    comps = _comps(stored(_sketch_links(lists, classes, None), "sketch-links"))
    return _joined(comps, stored(_sketch_links(stored(_listed(_rest(one, comps, BLOCK)), "family-rest"), classes, comps), "sketch-links-of-rest"))


def linked_classes(classes: DataFrame, docs: DataFrame, key: str, text: str, once: bool) -> DataFrame:
    """(rep, component) of all linked classes (rep, tokens) but the smallest of each component."""
    clusters = only(docs.sparkSession, "near-clusters", lambda: candidate_clusters(classes))
    # Each cluster's own smallest set is not in the table of components.
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("rep"), "component").distinct())
    sized = stored(clusters.join(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select(F.col("component").alias("node"), "rep", "size"), "clusters")
    sets = shingle_sets(docs, sized.select("rep"), key, text, once)
    large = sized.where(F.col("size") > GROUP)
    groups = sized.where(F.col("size") <= GROUP).select(F.col("node").alias("name"), "rep").unionByName(_split(large, SET_BLOCK))
    comps = _comps(stored(_links(groups, sets, None), "links"))
    if large.isEmpty():
        return comps
    return _joined(comps, stored(_links(_rest(large, comps, SET_BLOCK), sets, comps), "links-of-rest"))


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, rep, tokens): equal sets share the smallest id; tokens only where it is the row's own. Rows without
    an id or a set have no ``rep``."""
    rows = stored(features(docs, key, text), "set-features")
    usable = rows.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    first = usable.groupBy("mark_a", "mark_b").agg(F.min("id").alias("rep"))
    same = usable.join(first.hint("merge"), ["mark_a", "mark_b"]).select("id", "n_shingles", "rep", F.when(F.col("id") == F.col("rep"), F.col("tokens")).alias("tokens"))
    none = rows.where(F.col("id").isNull() | (F.col("n_shingles") == 0))
    return same.unionByName(none.select("id", "n_shingles", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("binary").alias("tokens")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest linked id, itself included), kept."""
    labelled = only(docs.sparkSession, "set-classes", lambda: _classes(docs, key, text))
    usable = labelled.where("rep is not null")
    classes = usable.where("id = rep and tokens is not null").select("rep", "tokens")
    once = usable.groupBy("id").count().where("count > 1").isEmpty()
    joined = only(docs.sparkSession, "near-components", lambda: linked_classes(classes, docs, key, text, once))
    grouped = labelled.select("id", "n_shingles", "rep").join(joined, "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep", "id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return grouped.select(F.col("id").alias(key), "n_shingles", "component_id", kept.alias("kept"))
