"""Best-fit packing of tokenised documents into sequences of fixed length, with a bounded number of open bins.

Each task packs its rows as they come. At most ``open_bins`` bins are open; a bitset has one bit for every amount of
free space that some open bin has, so the tightest bin that fits is found with one shift and one lowest-set-bit. If
none fits and all bins are in use, the fullest closes first. The pieces in bins that are still open when a task ends
are packed once more, longest first, over fewer tasks, so that the ends of tasks cost little. Only documents longer
than a sequence are cut.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows are packed as often as they come;
an empty table gives an empty result; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W
from glossmill.llm.tables import stored

LENGTH = 4096
OPEN_BINS = 256
END_ID = 1
CACHE_WORDS = 600_000
REPACK_ROWS = 200_000
LETTER, MARK = 1, 3
KINDS = np.zeros(256, np.uint8)
KINDS[97:123] = LETTER
KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = MARK


class Bins:
    """Open bins by free space. ``place`` returns (bin, offset) of a piece."""

    def __init__(self, length: int, limit: int) -> None:
        self.length, self.limit = length, limit
        self.bits = 0
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        row = self.by_free[free]
        number = row.pop()
        if not row:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if size < self.length and self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.length
            self.made += 1
        if free > size:
            self.by_free[free - size].append(number)
            self.bits |= 1 << (free - size)
            self.open += 1
        return number, self.length - free

    def still_open(self) -> set[int]:
        return {number for row in self.by_free.values() for number in row}


class WordIds:
    """Ids of white-space separated words, each distinct word encoded once while the cache has room for it.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in order.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.first = np.zeros(1 << 17, np.int64)  # one more than there are words

    def _add(self, hashes: list[int], texts: list[str]) -> None:
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        n, used = len(self.index), int(self.first[len(self.index)])
        total = used + int(sizes.sum())
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(max(total, 2 * used) - used, np.uint32)])
        if n + len(texts) + 1 > len(self.first):
            self.first = np.concatenate([self.first[: n + 1], np.zeros(max(len(texts), n + 1), np.int64)])
        self.ids[used:total] = np.fromiter((i for x in encoded for i in x), np.uint32, total - used)
        np.cumsum(sizes, out=self.first[n + 1 : n + 1 + len(texts)])
        self.first[n + 1 : n + 1 + len(texts)] += used
        self.index.update(zip(hashes, range(n, n + len(hashes))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block and the offset of each row's ids."""
        data, starts, ends, rows = _parts(data, offsets)
        unique, at, inverse = np.unique(W.byte_span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.index) + len(unique) > self.limit:
            self.clear()
        keys = unique.tolist()
        missing = [k for k, key in enumerate(keys) if key not in self.index]
        if missing:
            raw = data.tobytes()
            begin, end = starts[at[missing]].tolist(), ends[at[missing]].tolist()
            self._add([keys[k] for k in missing], [raw[b:e].decode() for b, e in zip(begin, end)])
        slot = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[inverse]
        sizes = self.first[slot + 1] - self.first[slot]
        ends_at = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.first[slot] - ends_at[:-1], sizes) + np.arange(ends_at[-1])]
        return ids, ends_at[np.searchsorted(rows, np.arange(len(offsets)))]


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is encoded on its own: words, cut where letters and marks meet, with A-Z in lower case.

    The tokenizer lower-cases and cuts there itself, so this only makes repeats more frequent. Letters are a-z and those of
    Latin-1; marks are those of ASCII but the apostrophe, which may begin a contraction. A block with the beginning of a
    special token keeps its case and whole words, as special tokens are told apart by them.
    """
    starts, ends, rows = W.words(data, offsets)
    if np.any((data[:-1] == 60) & (data[1:] == 124)):
        return data, starts, ends, rows
    data = W.lower_ascii(data)
    kind = KINDS[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[latin] = kind[latin + 1] = LETTER
    cuts = np.flatnonzero(kind[:-1] + kind[1:] == LETTER + MARK) + 1
    at = np.searchsorted(starts, cuts, side="right")
    inside = starts[at - 1] < cuts  # not where two texts meet
    cuts, at = cuts[inside], at[inside]
    return data, np.insert(starts, at, cuts), np.insert(ends, at - 1, cuts), np.insert(rows, at, rows[at - 1])


def word_ids(path: str) -> WordIds:
    cache = W.state().setdefault("word_ids", {})
    if path not in cache:
        cache[path] = WordIds(path)
    return cache[path]


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, open boolean"


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves if wanted.

    ``tokenizer`` is the path of a tokenizer file whose normalisation drops white space; every executor must have it.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins, task = word_ids(tokenizer), Bins(length, open_bins), TaskContext.get().partitionId()
        held: list[tuple] = []
        for rows, data, offsets in W.blocks(batches, "text"):
            ids, at = encoder.encode(data, offsets)
            raw, at = ids.astype("<u4"), at.tolist()
            keys, closing = rows.column(0).to_pylist(), np.array([end_id], "<u4")
            for k, name in enumerate(keys):
                own = np.concatenate([raw[at[k] : at[k + 1]], closing])
                for piece, start in enumerate(range(0, len(own), length)):
                    part = own[start : start + length]
                    number, offset = bins.place(len(part))
                    held.append((name, piece, start, len(part), zlib.crc32(part.tobytes()), number, offset, part if with_ids else None))
            if len(held) >= 50_000:
                live = bins.still_open()
                yield flush([x for x in held if x[5] not in live], task, live)
                held = [x for x in held if x[5] in live]
        yield flush(held, task, bins.still_open())

    def flush(held: list[tuple], task: int, live: set[int]) -> pa.RecordBatch:
        columns = list(zip(*held)) if held else [[]] * 8
        types = [pa_key, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        arrays[5] = pa.array([((task << 32) | n) * 2 for n in columns[5]], pa.int64())
        arrays.append(pa.array([n in live for n in columns[5]], pa.bool_()))
        if with_ids:
            arrays.append(pa.array([x.astype(np.int64) for x in columns[7]], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_key = to_arrow_type(source.schema["key"].dataType)
    schema = f"key {kind}, {PIECES}" + (", ids array<bigint>" if with_ids else "")
    names = ["key", *(x.split()[0] for x in PIECES.split(", ")), *(["ids"] if with_ids else [])]
    packed = stored(source.mapInArrow(first, schema), "packed-pieces")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task = Bins(length, open_bins), TaskContext.get().partitionId()
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            new = {"sequence_id": pa.array([((task << 32) | n) * 2 + 1 for n, _ in placed], pa.int64()), "offset": pa.array([o for _, o in placed], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    rest = packed.where("open")
    tasks = -(-rest.count() // REPACK_ROWS) or 1
    repacked = rest.repartition(tasks, F.xxhash64("key", "piece", "start")).sortWithinPartitions(F.desc("length"), "key", "piece", "ids_crc32").mapInArrow(again, schema)
    return packed.where("not open").unionByName(repacked).select(F.col("key").alias(key), *[n for n in names if n not in ("key", "open")])
