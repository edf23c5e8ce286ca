"""Language identification, words first: a known word counts with its frequency in each language, an unseen word falls
back to the longest of its character n-grams (four letters, then three, two, one) that training has seen.

The model is fitted on all labelled rows of a language up to about ``SAMPLE_ROWS``, else on so many, chosen by the hash
of their key. It keeps the ``ENTRIES`` most frequent words and n-grams of every length per language, with their counts in
all languages, so that what is broadcast is bounded by languages x 5 x entries hashes. Prediction reads every whole text.

Defined cases: a null text, an empty one or one without a letter is ``und`` with score 0; rows whose label is null are
not learned from; without any labelled row every text is ``und``; if no word or n-gram of a text is known, the first
language in alphabetical order is returned with a score of 1 / languages; repeated rows are repeated in the result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm import words as W
from glossmill.llm.tables import stored

SAMPLE_ROWS = 20_000  # of every language
ENTRIES = 20_000
LONGEST = 4
SMOOTHING = 0.5
UNKNOWN = "und"


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, offsets, starts, ends, rows) of runs of ASCII letters and bytes of other scripts."""
    data, offsets = W.column_bytes(pc.utf8_lower(texts))
    other = (data < 97) | ((data > 122) & (data < 128))
    return data, offsets, *W.pieces(data, offsets, other)


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` characters in the words, and the index of each run's word."""
    edges = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first, last = np.searchsorted(edges, starts), np.searchsorted(edges, ends)
    count = np.maximum(last - first - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    at = first[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    return W.byte_span_hash(data, edges[at], edges[at + n]), word


def _counts(labelled: DataFrame) -> DataFrame:
    """(lang, level, hash, n): level 0 has words, level k runs of k characters; counted per block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in W.blocks(batches, "text"):
            names, lang = np.unique(rows.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            data, _, starts, ends, row = letter_words(rows.column("text"))
            found = [(0, W.byte_span_hash(data, starts, ends), lang[row])]
            for n in range(1, LONGEST + 1):
                hashes, word = grams(data, starts, ends, n)
                found.append((n, hashes, lang[row[word]]))
            for level, hashes, owner in found:
                for k, name in enumerate(names):
                    unique, count = np.unique(hashes[owner == k], return_counts=True)
                    if len(unique):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(unique)), pa.array(np.full(len(unique), level, np.int32)), pa.array(W.signed(unique)), pa.array(count.astype(np.int64))], ["lang", "level", "hash", "n"]
                        )

    return labelled.mapInArrow(run, "lang string, level int, hash bigint, n bigint").groupBy("lang", "level", "hash").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> dict:
    """The model: language names and, per level, sorted hashes with a row of log frequencies by language."""
    labelled = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.xxhash64(F.col(f"`{key}`")).alias("mark"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    shares = labelled.groupBy("lang").agg((F.lit(sample_rows) / F.count(F.lit(1))).alias("share"))  # a row per language
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod("mark", F.lit(1 << 30)) <= F.col("share") * (1 << 30)).select("lang", "text")
    counts = _counts(sample)
    order = Window.partitionBy("lang", "level").orderBy(F.desc("n"), "hash")
    sums = Window.partitionBy("lang", "level")
    ranked = stored(counts.withColumn("total", F.sum("n").over(sums)).withColumn("place", F.row_number().over(order)), "language-counts")
    chosen = ranked.where(F.col("place") <= entries).select("level", "hash").distinct()
    kept = ranked.join(chosen, ["level", "hash"], "left_semi").select("lang", "level", "hash", "n", "total").toArrow()
    langs = sorted(set(kept.column("lang").to_pylist()))
    level, name = kept.column("level").to_numpy(), kept.column("lang").to_numpy().astype(str)
    hashes, n, totals = kept.column("hash").to_numpy().view(np.uint64), kept.column("n").to_numpy(), kept.column("total").to_numpy()
    levels = []
    for k in range(LONGEST + 1):
        known = np.unique(hashes[level == k])
        logs = np.empty((len(known), len(langs)), np.float32)
        for j, one in enumerate(langs):
            mine = (level == k) & (name == one)
            size = float(totals[mine][0]) if mine.any() else 0.0
            row = np.full(len(known), SMOOTHING)
            row[np.searchsorted(known, hashes[mine])] += n[mine]
            logs[:, j] = np.log(row / (size + SMOOTHING * (len(known) + 1)))
        levels.append((known, logs))
    return {"langs": langs, "levels": levels}


def _look_up(level: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, _ = level
    if not len(known):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes, at


def score_rows(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and the score of every text of a block."""
    langs, levels = model["langs"], model["levels"]
    data, offsets, starts, ends, rows = letter_words(texts)
    n = len(offsets) - 1
    letters = np.zeros(n, bool)
    ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    letters = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    has_word = np.bincount(rows, minlength=n) > 0
    for k in np.flatnonzero(~letters & has_word).tolist():
        letters[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode())
    if not langs:
        return [UNKNOWN] * n, np.zeros(n)
    unique, first, inverse = np.unique(W.byte_span_hash(data, starts, ends), return_index=True, return_inverse=True)
    vector = np.zeros((len(unique), len(langs)), np.float64)
    known, at = _look_up(levels[0], unique)
    vector[known] = levels[0][1][at[known]]
    open_words = np.flatnonzero(~known)
    for size in range(LONGEST, 0, -1):
        if not len(open_words):
            break
        hashes, word = grams(data, starts[first[open_words]], ends[first[open_words]], size)
        seen, at = _look_up(levels[size], hashes)
        hits = np.bincount(word[seen], minlength=len(open_words))
        found = np.flatnonzero(hits)
        for j in range(len(langs)):
            sums = np.bincount(word[seen], weights=levels[size][1][at[seen], j], minlength=len(open_words))
            vector[open_words[found], j] = sums[found] / hits[found]
        open_words = open_words[hits == 0]
    total = np.stack([np.bincount(rows, weights=vector[inverse, j], minlength=n) for j in range(len(langs))], 1)
    count = np.maximum(np.bincount(rows, minlength=n), 1)[:, None]
    scaled = total / count * np.minimum(count, 20)
    odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    best = scaled.argmax(axis=1)
    score = np.where(letters, (odds / odds.sum(axis=1, keepdims=True)).max(axis=1), 0.0)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())], score


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in W.blocks(batches, "text"):
            names, score = score_rows(shared.value, rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(names), pa.array(score)], ["key", "lang_pred", "score"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
