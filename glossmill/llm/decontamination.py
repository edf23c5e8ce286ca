"""Benchmark decontamination by greedy string tiling.

Items and documents are words in lower case (all scripts). Runs of ``SEED`` words that an item and a document share join the
two; before the join, documents' runs pass a bitmap of fixed size made from the items' runs, so that only documents
with a possible hit go on. Each joined pair is tiled: the longest common runs of unmarked words are found with running
Karp-Rabin hashes, marked on both sides, and the search goes on with shorter runs down to ``SEED`` words, so an item
whose sentences were reordered is still covered. A document is contaminated by an item when tiles cover at least
``COVERAGE`` per cent of the item's words.

Defined cases: null or empty texts share nothing; an item with fewer than ``SEED`` words is one run of its own length and
must occur whole; repeated rows of documents or items (equal key and text) count once; rows that share a key but differ
in text are tiled each; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W
from glossmill.llm.tables import stored

SEED = 5
COVERAGE = 60
BITMAP_BITS = 1 << 25

_U = np.uint64


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of a column of texts, whatever its case."""
    data, offsets = W.column_bytes(pc.utf8_lower(texts))
    starts, ends, rows = W.words(data, offsets)
    return W.byte_span_hash(data, starts, ends), rows


def _text_words(text: str) -> np.ndarray:
    return word_hashes(pa.array([text]))[0]


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length) of two sequences of word hashes, longest first.

    The length searched for falls by halves until matches appear; a match is extended as far as unmarked words agree,
    and the search is restarted at the longest extension, so that no shorter tile takes words of a longer one.
    """
    least = max(1, min(least, len(item)))
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []
    size = min(len(item), len(text))
    while size >= least:
        a, b = _free_windows(free_item, size), _free_windows(free_text, size)
        hash_a, hash_b = W.span_hash(item, a, a + size), W.span_hash(text, b, b + size)
        at = np.flatnonzero(np.isin(hash_b, hash_a))
        if not len(at):
            size = max(size // 2, least) if size > least else 0
            continue
        order = np.argsort(hash_a, kind="stable")
        low, high = np.searchsorted(hash_a[order], hash_b[at], "left"), np.searchsorted(hash_a[order], hash_b[at], "right")
        pairs = [(int(a[order[k]]), int(b[j])) for j, lo, hi in zip(at, low, high) for k in range(lo, hi)]
        found = []
        for i, j in pairs:
            n = size
            while i + n < len(item) and j + n < len(text) and free_item[i + n] and free_text[j + n] and item[i + n] == text[j + n]:
                n += 1
            found.append((n, i, j))
        longest = max(n for n, _, _ in found)
        if longest > size:
            size = longest
            continue
        for n, i, j in found:
            if free_item[i : i + n].all() and free_text[j : j + n].all() and (item[i : i + n] == text[j : j + n]).all():
                free_item[i : i + n] = free_text[j : j + n] = False
                out.append((i, j, n))
        size = max(size // 2, least) if size > least else 0
    return out


def _free_windows(free: np.ndarray, size: int) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(count[size:] - count[:-size] == size)


def _runs(rows: np.ndarray, hashes: np.ndarray, n: int, shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``SEED`` words and the row of each; with ``shorter`` a short row is a run of its own."""
    found, first = W.windows(hashes, rows, SEED)
    owner = rows[first]
    if shorter:
        counts = np.bincount(rows, minlength=n)
        short = np.flatnonzero((counts > 0) & (counts < SEED))
        begin = np.searchsorted(rows, short)
        found = np.concatenate([found, W.span_hash(hashes, begin, begin + counts[short])])
        owner = np.concatenate([owner, short])
    return found, owner


def item_runs(items: DataFrame) -> DataFrame:
    """(run, item, words) of every item row (item, text); ``words`` is the run's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, offsets in W.blocks(batches, "text"):
            hashes, row = word_hashes(rows.column("text"))
            found, owner = _runs(row, hashes, len(offsets) - 1, True)
            counts = np.bincount(row, minlength=len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(found)), rows.column(0).take(pa.array(owner)), pa.array(np.minimum(counts[owner], SEED).astype(np.int32))], ["run", "item", "words"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"run bigint, item {kind}, words int").distinct()


def _bitmap(runs: DataFrame) -> bytes:
    """Which of ``BITMAP_BITS`` residues any run has: four megabytes, however many items there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_BITS, bool)
        for batch in batches:
            bits[batch.column("run").to_numpy().view(np.uint64) % _U(BITMAP_BITS)] = True
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["at", "bits"])

    parts = runs.select("run").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    whole = np.zeros(BITMAP_BITS // 64, np.int64)
    for at, bits in parts.collect():
        whole[at] = bits
    return whole.tobytes()


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: int = COVERAGE) -> DataFrame:
    """(key, item key, item_words, covered_words, n_tiles, tiles) of every contaminated pair.

    ``tiles`` is an array of (item_at, at, words): word places in the item and in the document.
    """
    spark = docs.sparkSession
    named = stored(items.select(F.col(f"`{item_key}`").alias("item_key"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    runs = stored(item_runs(named.select("item", "text")), "benchmark-runs")
    shared = spark.sparkContext.broadcast(_bitmap(runs))
    widths = sorted(r[0] for r in runs.select("words").distinct().collect())  # at most SEED values
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for rows, _, offsets in W.blocks(batches, "text"):
            hashes, row = word_hashes(rows.column("text"))
            hit, owner = [], []
            for width in widths:
                found, first = W.windows(hashes, row, width)
                place = found % _U(BITMAP_BITS)
                mask = (bits[place >> _U(3)] >> (_U(7) - (place & _U(7))).astype(np.uint8)) & 1 > 0
                hit.append(found[mask])
                owner.append(row[first[mask]])
            if not hit or not sum(map(len, hit)):
                continue
            pair = np.unique(np.stack([np.concatenate(owner).astype(np.uint64), np.concatenate(hit)], 1), axis=0)
            at, who = np.unique(pair[:, 0].astype(np.int64), return_index=True)
            lists = W.list_array(pa.array(W.signed(np.ascontiguousarray(pair[:, 1]))), np.append(who, len(pair)))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), lists], ["key", "text", "runs"])

    kind = source.schema["key"].dataType.simpleString()
    possible = stored(source.mapInArrow(seeds, f"key {kind}, text string, runs array<bigint>").withColumn("row", F.monotonically_increasing_id()), "seeded-documents")
    pairs = possible.select("row", F.explode("runs").alias("run")).join(runs.select("run", "item"), "run").select("row", "item").distinct()
    both = pairs.join(possible.select("row", "key", "text"), "row").join(named.withColumnRenamed("text", "item_text"), "item").select("key", "item_key", "text", "item_text")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for whole, item in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist()):
                a = _text_words(item)
                made.append((len(a), tiles(a, _text_words(whole))))
            covered = [sum(t[2] for t in found) for _, found in made]
            keep = [k for k, (n, _) in enumerate(made) if 100 * covered[k] >= coverage * n and n]
            take = pa.array(keep, pa.int64())
            lists = pa.array([[{"item_at": i, "at": j, "words": n} for i, j, n in made[k][1]] for k in keep], pa.list_(pa.struct([("item_at", pa.int32()), ("at", pa.int32()), ("words", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(take), batch.column("item_key").take(take), pa.array([made[k][0] for k in keep], pa.int64()), pa.array([covered[k] for k in keep], pa.int64()), pa.array([len(made[k][1]) for k in keep], pa.int64()), lists],
                ["key", "item_key", "item_words", "covered_words", "n_tiles", "tiles"],
            )

    item_kind = named.schema["item_key"].dataType.simpleString()
    done = both.mapInArrow(tile, f"key {kind}, item_key {item_kind}, item_words bigint, covered_words bigint, n_tiles bigint, tiles array<struct<item_at:int,at:int,words:int>>")
    return done.dropDuplicates(["key", "item_key"]).select(F.col("key").alias(key), F.col("item_key").alias(item_key), "item_words", "covered_words", "n_tiles", "tiles")
