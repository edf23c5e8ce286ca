"""Quality rules from cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space between words made one) and hashed. For every host the number of
distinct documents with a line is counted; exact copies of a text count as one document, so a page that was copied
often does not mark its own lines. Lines above the host's limit are boilerplate and are taken away; a document that is
left with too few words is rejected.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; a line
without a word is never counted; repeated rows are repeated in the result; an empty table gives an empty result; other
columns are kept by ``remove_frequent_lines`` and ignored by ``measure``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W
from glossmill.llm.tables import stored

MIN_DOCUMENTS = 5
MAX_SHARE = 0.10
MAX_DOCUMENTS = 10_000
MIN_WORDS = 20
MIN_LEFT = 0.3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, text_hash bigint, lines array<struct<line bigint, words int>>"


def _repeated(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each (row, hash) occurs twice or more."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(h), bool)
    out[order] = twice
    return out


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each non-empty line."""
    return W.pieces(data, offsets, data == 10)


def _measure_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    n = len(offsets) - 1
    space = W.is_space(data)
    starts, ends, rows = W.pieces(data, offsets, space)
    n_words = np.bincount(rows, minlength=n)
    chars = np.concatenate([[0], np.cumsum(~space & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))])
    hashes = W.byte_span_hash(data, starts, ends)
    runs, first = W.windows(hashes, rows, WINDOW)
    again = first[_repeated(runs, rows[first])]
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, again, 1)
    np.add.at(depth, again + WINDOW, -1)
    repeat_words = np.bincount(rows[np.cumsum(depth[:-1]) > 0], minlength=n)
    line_start, line_end, line_row = line_spans(data, offsets)
    word_from, word_to = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = word_to > word_from
    line_start, line_end, line_row, word_from, word_to = (x[full] for x in (line_start, line_end, line_row, word_from, word_to))
    exact = W.byte_span_hash(data, line_start, line_end)
    dup_lines = np.bincount(line_row, minlength=n) - _distinct_per_row(exact, line_row, n)
    low = W.byte_span_hash(W.lower_ascii(data), starts, ends)
    line_hash = W.span_hash(low, word_from, word_to)
    order = np.lexsort((line_hash, line_row))
    h, r, size = line_hash[order], line_row[order], (word_to - word_from)[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    total = np.add.reduceat(size, at) if len(at) else size
    lines = pa.StructArray.from_arrays([pa.array(W.signed(h[at])), pa.array(total.astype(np.int32))], ["line", "words"])
    return {
        "n_words": n_words,
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "text_hash": W.signed(W.byte_span_hash(data, offsets[:-1], offsets[1:])),
        "lines": W.list_array(lines, np.searchsorted(r[at], np.arange(n + 1))),
    }


def _distinct_per_row(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[fresh], minlength=n)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, host, the base figures, and its distinct normalised lines with the words each holds there."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in W.blocks(batches, "text"):
            made = _measure_block(data, offsets)
            arrays = [rows.column(0), rows.column(1)] + [v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for v in made.values()]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "host", *made])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, host string, {MEASURES}")


def frequent_lines(measured: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line, documents) above the host's limit: more than ``min_documents``, and more than ``max_share`` of its distinct texts or more than ``max_documents``.

    Both counts combine before the shuffle; copies of a text fall together in the first grouping.
    """
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))
    distinct = measured.groupBy(host.alias("host"), "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    lines = measured.select(host.alias("host"), "text_hash", F.explode("lines.line").alias("line")).groupBy("host", "line", "text_hash").agg(F.lit(1).alias("one"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > min_documents)
    return counts.join(sizes, "host").where((F.col("documents") > max_share * F.col("texts")) | (F.col("documents") > max_documents)).select("host", "line", "documents")


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    min_words: int = MIN_WORDS,
    min_left: float = MIN_LEFT,
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """One row per row of ``docs``: the base figures, the words in frequent lines, and the verdict."""
    # Rows are told apart by a number given before the table is stored: keys may be null or repeated.
    measured = stored(measure(docs, key, text, host).withColumn("row", F.monotonically_increasing_id()), "line-measures")
    frequent = stored(frequent_lines(measured, min_documents, max_share, max_documents), "frequent-lines")
    own = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))
    lost = (
        measured.select("row", own.alias("host"), F.explode("lines").alias("at"))
        .select("row", "host", "at.line", "at.words")
        .join(frequent.select("host", "line"), ["host", "line"])
        .groupBy("row")
        .agg(F.sum("words").alias("lost_words"))
    )
    joined = measured.drop("lines", "text_hash").join(lost, "row", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lost_words = F.coalesce("lost_words", F.lit(0)).cast("long")
    left = F.col("n_words") - lost_words
    kept = ~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))
    return joined.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", lost_words.alias("lost_words"), failed.alias("base_failed"), kept.alias("kept")
    )


def remove_frequent_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without the lines that ``frequent`` lists for their host; the other lines keep their order and bytes.

    Line hashes are computed in the same way as for counting, so the join is on (host, line); every row keeps its place
    in the result but null and empty texts stay as they are.
    """
    marked = docs.withColumn("__row", F.monotonically_increasing_id())
    marked = stored(marked, "line-input")
    source = marked.select("__row", F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("")).alias("host"), F.col(f"`{text}`").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in W.blocks(batches, "text"):
            start, end, row = line_spans(data, offsets)
            word_start, word_end, _ = W.words(data, offsets)
            low = W.byte_span_hash(W.lower_ascii(data), word_start, word_end)
            first, last = np.searchsorted(word_start, start), np.searchsorted(word_start, end)
            hashes = np.where(last > first, W.span_hash(low, first, last), np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row)), pa.array(start - offsets[row]), pa.array(W.signed(hashes)), pa.array(last > first)],
                ["__row", "host", "at", "line", "has_words"],
            )

    lines = source.mapInArrow(split, "__row bigint, host string, at bigint, line bigint, has_words boolean").where("has_words")
    cuts = lines.join(frequent.select("host", "line"), ["host", "line"]).groupBy("__row").agg(F.sort_array(F.collect_list("at")).alias("__cuts"))
    joined = marked.join(cuts, "__row", "left")
    body = F.encode(F.col(f"`{text}`"), "UTF-8")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, cuts in zip(batch.column("__body").to_pylist(), batch.column("__cuts").to_pylist()):
                gone, kept, at = set(cuts), [], 0
                for line in value.split(b"\n"):
                    if at not in gone:
                        kept.append(line)
                    at += len(line) + 1
                out.append(b"\n".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.string())], ["__row", "__text"])

    changed = joined.where(F.col("__cuts").isNotNull()).select("__row", body.alias("__body"), "__cuts").mapInArrow(drop, "__row bigint, __text string")
    names = [f"`{c}`" for c in docs.columns]
    result = marked.join(changed, "__row", "left")
    return result.select(*[F.coalesce("__text", F.col(f"`{text}`")).alias(text) if c == f"`{text}`" else F.col(c) for c in names])
