"""Removal of passages that repeat across a corpus, by content-defined chunks of lines.

A line ends at a line feed and, unless ``sentences=False``, also after ``.``, ``!`` or ``?`` before white space, since
corpora carry repeated passages inside longer lines. Lines are hashed without the white space around them. A rolling hash
over the hashes of the last ``ROLL`` lines chooses boundaries, after one line in ``RATE``: a chunk ends where the lines
at its end say so, and begins after the lines that ended the one before, so that a line put in or taken out moves only the
chunks around it, and a passage has the same chunks wherever it stands, but for its two edges. The edges, and passages too
short to hold a boundary, are secured by the shortest runs of two lines or more with ``MIN_WORDS`` words that begin, or
that end, at a line; they depend on the lines inside them alone, so every line of a repeated passage of two lines and
``MIN_WORDS`` words lies in a chunk or run inside the passage, whatever stands around it.

Chunks and runs that occur twice or more in the corpus are repeated. Of each the first occurrence, by key and place,
stays, and the lines of the others go, once all lines of equal hash in them are found equal byte for byte. A line goes if
any of its chunks came before: of overlapping passages (a b) in one document and (b c) in another, a third document with
(a b c) loses all three, though they stand in no document in a row; and of a line repeated four times in a row one stays.

Defined cases: null texts stay null, empty ones empty; rows that repeat both key and text count as one document and are
changed alike; a null key sorts first; a document whose lines all go is left with an empty text; an empty table gives an
empty result; all other columns are kept as they are, whatever their names; columns that are named like the two counts in
the result are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W
from glossmill.llm.tables import only, stored, unused

MIN_WORDS = 8
ROLL = 2
RATE = 4
SPACES = b" \t\n\x0b\x0c\r"

_U = np.uint64


def lines(data: np.ndarray, offsets: np.ndarray, sentences: bool = True) -> tuple[np.ndarray, ...]:
    """(start, first byte of content, end of content, words, row) of every line that has a word."""
    ends = data == 10
    if sentences and len(data) > 1:
        ends[:-1] |= ((data == 46) | (data == 33) | (data == 63))[:-1] & W.is_space(data)[1:]
    edges = np.union1d(np.flatnonzero(ends) + 1, offsets)
    start, stop = edges[:-1], edges[1:]
    word_start, word_end, _ = W.words(data, offsets)
    first, last = np.searchsorted(word_start, start), np.searchsorted(word_start, stop)
    full = last > first
    start, first, last = start[full], first[full], last[full]
    return start, word_start[first], word_end[last - 1], last - first, np.searchsorted(offsets, start, "right") - 1


def boundaries(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a chunk ends after each line: the hash of the last ``ROLL`` lines of the row says so."""
    out = np.zeros(len(hashes), bool)
    found, first = W.windows(hashes, row, ROLL)
    out[first + ROLL - 1] = found % _U(RATE) == 0
    return out


def defined_chunks(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of the content-defined chunks, which divide the lines of each row."""
    cut = boundaries(hashes, row)
    if len(row):
        cut[:-1] |= row[1:] != row[:-1]
        cut[-1] = True
    last = np.flatnonzero(cut) + 1
    return np.concatenate([[0], last[:-1]])[: len(last)].astype(np.int64), last


def short_runs(sizes: np.ndarray, offsets: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of the shortest runs of two lines or more with ``MIN_WORDS`` words from and up to every line."""
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    line = np.arange(len(sizes))
    ahead = np.maximum(np.searchsorted(before, before[:-1] + MIN_WORDS), line + 2)
    back = np.minimum(np.searchsorted(before, before[1:] - MIN_WORDS, "right") - 1, line - 1)
    fits, also = ahead <= offsets[row + 1], back >= offsets[row]
    return np.concatenate([line[fits], back[also]]), np.concatenate([ahead[fits], line[also] + 1])


def chunks(hashes: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first line, lines, key) of the content-defined chunks of two lines or more with ``MIN_WORDS`` words, and of the
    short runs that secure their edges, by first line."""
    row = np.searchsorted(offsets, np.arange(len(hashes)), "right") - 1
    start, stop = defined_chunks(hashes, row)
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    wide = (stop - start > 1) & (before[stop] - before[start] >= MIN_WORDS)
    first, last = short_runs(sizes, offsets, row)
    first, last = np.concatenate([start[wide], first]), np.concatenate([stop[wide], last])
    code = np.unique(first * (len(hashes) + 1) + last)
    first, last = code // (len(hashes) + 1), code % (len(hashes) + 1)
    return first, last - first, W.span_hash(hashes, first, last)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


KEY = ["__id", "__mark"]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumns({"__id": F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "__mark": F.xxhash64(F.col(f"`{text}`"))})


def line_table(docs: DataFrame, key: str, text: str, sentences: bool) -> DataFrame:
    """Line hashes and word counts of every distinct (key, text), with what orders the documents."""
    source = keyed(docs, key, text).select(F.col(f"`{key}`").alias("order"), *KEY, F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in W.blocks(batches, "text"):
            _, first, last, size, row = lines(data, offsets, sentences)
            at = np.searchsorted(row, np.arange(len(offsets)))
            hashes = W.list_array(pa.array(W.signed(W.byte_span_hash(data, first, last))), at)
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], hashes, W.list_array(pa.array(size.astype(np.int32)), at)], ["order", *KEY, "hashes", "sizes"])

    kind = source.schema["order"].dataType.simpleString()
    return source.mapInArrow(run, f"order {kind}, __id string, __mark bigint, hashes array<bigint>, sizes array<int>")


def _occurrences(table: DataFrame) -> DataFrame:
    """One row per document and chunk, with the number of its places in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = _lists(batch, "hashes")
            if not len(hashes):
                continue
            first, _, keys = chunks(hashes.view(np.uint64), _lists(batch, "sizes")[0], offsets)
            row = np.searchsorted(offsets, first, "right") - 1
            order = np.lexsort((keys, row))
            row, keys = row[order], keys[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            at = np.flatnonzero(fresh)
            times = np.diff(np.append(at, len(row)))
            yield pa.RecordBatch.from_arrays([batch.column("rank").take(pa.array(row[at])), pa.array(W.signed(keys[at])), pa.array(times.astype(np.int32))], ["rank", "chunk", "times"])

    return table.mapInArrow(run, "rank bigint, chunk bigint, times int")


def _repeated(occurrences: DataFrame) -> DataFrame:
    """Per document: the chunks that occur more than once, as those that occur here first and those that do not."""
    least = occurrences.groupBy("chunk").agg(F.sum("times").alias("all"), F.min("rank").alias("least")).where("all > 1").select("chunk", "least")
    hits = occurrences.select("chunk", "rank").join(stored(least, "line-chunks"), "chunk")
    here = F.col("rank") == F.col("least")
    return hits.groupBy("rank").agg(F.collect_list(F.when(here, F.col("chunk"))).alias("here"), F.collect_list(F.when(~here, F.col("chunk"))).alias("earlier"))


def _marked(first: np.ndarray, count: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, offsets) per row of the lines in the given runs."""
    depth = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + count, -1)
    line = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
    at = np.searchsorted(line, offsets)
    return line - np.repeat(offsets[:-1], np.diff(at)), at


def _lines_of(table: DataFrame, repeated: DataFrame) -> DataFrame:
    """Per document the lines in repeated chunks, and those of them in a chunk that came before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, offsets = _lists(batch, "hashes")
            first, count, keys = chunks(hashes.view(np.uint64), _lists(batch, "sizes")[0], offsets)
            row = np.searchsorted(offsets, first, "right") - 1
            (here, here_at), (earlier, earlier_at) = _lists(batch, "here"), _lists(batch, "earlier")
            # Rows and keys as one exact number, since a key may be repeated in one row and not in another.
            code = np.unique(np.concatenate([keys, here.view(np.uint64), earlier.view(np.uint64)]), return_inverse=True)[1] * batch.num_rows
            own = code[: len(keys)] + row
            own_here = code[len(keys) : len(keys) + len(here)] + np.repeat(np.arange(batch.num_rows), np.diff(here_at))
            own_earlier = code[len(keys) + len(here) :] + np.repeat(np.arange(batch.num_rows), np.diff(earlier_at))
            again = np.ones(len(own), bool)
            again[np.unique(own, return_index=True)[1]] = False  # chunks are in the order of their first lines
            kept, came = np.isin(own, own_here), np.isin(own, own_earlier)
            gone = came | (kept & again)
            lists = [W.list_array(pa.array(line.astype(np.int32)), at) for line, at in (_marked(first[x], count[x], offsets) for x in (kept | came, gone))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *lists], [*KEY, "__lines", "__gone"])

    return table.join(repeated, "rank").select(*KEY, "hashes", "sizes", "here", "earlier").mapInArrow(run, "__id string, __mark bigint, __lines array<int>, __gone array<int>")


def _unequal(marked: DataFrame, text: str, sentences: bool) -> DataFrame:
    """Hashes of lines in repeated chunks that stand for different bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in W.blocks(batches, "text"):
            _, first, last, _, row = lines(data, offsets, sentences)
            wanted, at = _lists(rows, "__lines")
            base = np.searchsorted(row, np.arange(len(offsets) - 1))
            index = np.unique(np.repeat(base, np.diff(at)) + wanted)
            hashes = W.byte_span_hash(data, first, last)[index]
            _, one = np.unique(hashes, return_index=True)
            raw = data.tobytes()
            # Within a block, equal hashes are compared here; one of each goes on.
            content = [raw[b:e] for b, e in zip(first[index].tolist(), last[index].tolist())]
            seen: dict[int, bytes] = {}
            extra = [k for k, (h, c) in enumerate(zip(hashes.tolist(), content)) if seen.setdefault(h, c) != c]
            pick = [*one.tolist(), *extra]
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(hashes[pick])), pa.array([content[k] for k in pick], pa.binary())], ["line", "bytes"])

    source = marked.select(F.col(f"`{text}`").alias("text"), "__lines").where("size(__lines) > 0")
    found = source.mapInArrow(run, "line bigint, bytes binary")
    return found.groupBy("line").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).where("low != high").select("line")


def repeated_lines(docs: DataFrame, key: str, text: str, sentences: bool) -> DataFrame:
    """Per document (__id, __mark): the lines in repeated chunks, and those of them that go."""
    table = stored(line_table(docs, key, text, sentences), "line-hashes")
    if not table.groupBy(*KEY).count().where("count > 1").isEmpty():
        table = stored(table.dropDuplicates(KEY), "distinct-line-hashes")
    # Documents in order, so that one number stands for what orders them.
    ranked = table.repartitionByRange("order", *KEY).sortWithinPartitions("order", *KEY).withColumn("rank", F.monotonically_increasing_id())
    ranked = stored(ranked.select("rank", *KEY, "hashes", "sizes"), "ranked-line-hashes")
    return _lines_of(ranked, _repeated(_occurrences(ranked)))


OWN = {*KEY, "__lines", "__gone"}


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: bool = True) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and the columns ``__n_lines`` and ``__n_removed`` (long)."""
    docs = docs.drop("__n_lines", "__n_removed")
    clashing = {c: unused(docs.columns, f"{c}_of_caller") for c in docs.columns if c in OWN}
    cut = _cut(docs.withColumnsRenamed(clashing), clashing.get(key, key), clashing.get(text, text), sentences)
    return cut.withColumnsRenamed({own: c for c, own in clashing.items()})


def _cut(docs: DataFrame, key: str, text: str, sentences: bool) -> DataFrame:
    lists = only(docs.sparkSession, "repeated-lines", lambda: repeated_lines(docs, key, text, sentences))
    empty = F.array().cast("array<int>")
    marked = keyed(docs, key, text).join(lists.hint("merge"), KEY, "left").withColumns({"__lines": F.coalesce("__lines", empty), "__gone": F.coalesce("__gone", empty)})
    marked = stored(marked, "line-marked")
    unequal = stored(_unequal(marked, text, sentences), "unequal-lines")
    if not unequal.isEmpty():
        table = line_table(docs, key, text, sentences).dropDuplicates(KEY)
        own = table.select(*KEY, F.posexplode("hashes").alias("line", "hash")).join(unequal.withColumnRenamed("line", "hash"), "hash").groupBy(*KEY).agg(F.collect_set("line").alias("__spare"))
        marked = marked.join(own, KEY, "left").withColumn("__gone", F.array_except("__gone", F.coalesce("__spare", empty))).drop("__spare")
    columns = list(docs.columns)
    index = columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in W.blocks(batches, text):
            _, start, _, _, row = lines(data, offsets, sentences)  # a line takes the white space behind it along
            gone, at = _lists(rows, "__gone")
            base = np.searchsorted(row, np.arange(len(offsets)))
            stop = np.append(start[1:], len(data))
            last = np.append(row[1:] != row[:-1], True) if len(row) else np.empty(0, bool)
            stop[last] = offsets[row[last] + 1]
            removed = np.zeros(len(start), bool)
            removed[np.repeat(base[:-1], np.diff(at)) + gone] = True
            column = rows.column(index)
            changed = np.flatnonzero(np.diff(at)).tolist()
            if changed:
                values = column.to_pylist()
                for k in changed:
                    lo, hi = base[k], base[k + 1]
                    stay = lo + np.flatnonzero(~removed[lo:hi])
                    head = data[offsets[k] : start[lo]].tobytes() if len(stay) else b""
                    rest = (head + b"".join(data[b:e].tobytes() for b, e in zip(start[stay].tolist(), stop[stay].tolist()))).rstrip(SPACES)
                    values[k] = (rest.lstrip(SPACES) if removed[lo] else rest).decode()
                column = pa.array(values, pa.string())
            arrays = [column if k == index else rows.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.diff(base)), pa.array(np.diff(at))], [*columns, "__n_lines", "__n_removed"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*docs.schema.fields]).add("__n_lines", LongType()).add("__n_removed", LongType())
    return marked.select(*[f"`{n}`" for n in [*columns, "__gone"]]).mapInArrow(cut, schema)
