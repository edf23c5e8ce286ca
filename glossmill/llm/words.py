"""Words, spans and their hashes over whole Arrow batches of texts, as numpy arrays.

A block is a run of rows with about a megabyte of text (one longer text is a block of its own); no text is ever cut.
Hashes have 64 bits. Spans are compared by hash here; operators that promise exactness compare what the spans hold.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64
_STEP, _STEP_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def state() -> dict:
    """A dictionary that lives as long as the Python process, so that tasks of one worker share costly tables."""
    name = "glossmill_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a bijection on 64 bits)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = state()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        pair = []
        for base in (_STEP, _STEP_INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            pair.append(np.cumprod(factors, dtype=np.uint64))
        cache["powers"] = tuple(pair)
    return cache["powers"]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span ``values[start:end]``; equal spans have equal hashes wherever they lie."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _byte_codes() -> np.ndarray:
    cache = state()
    if "codes" not in cache:
        cache["codes"] = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
    return cache["codes"]


def byte_span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(_byte_codes()[data], starts, ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def is_space(data: np.ndarray) -> np.ndarray:
    """The separators 0x20 and 0x09 to 0x0D. UTF-8 never uses these bytes inside another character."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, first = len(column), column.offset
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[first : first + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in order, as (rows, text bytes, offsets), each block about ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def pieces(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes without a separator, never over two rows: (starts, ends, row of each)."""
    inside = ~separator
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= separator[:-1]
    end[:-1] &= separator[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pieces(data, offsets, is_space(data))


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` items within a row, and the index of each run's first item."""
    if len(hashes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(rows[: len(rows) - width + 1] == rows[width - 1 :])
    return span_hash(hashes, first, first + width), first


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles per row (A-Z lower-cased), sorted by (row, hash). A row with fewer words is one shingle."""
    low = lower_ascii(data)
    starts, ends, rows = words(low, offsets)
    hashes = byte_span_hash(low, starts, ends)
    found, first = windows(hashes, rows, width)
    owner = rows[first]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.searchsorted(rows, short)
        found = np.concatenate([found, span_hash(hashes, begin, begin + counts[short])])
        owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[fresh], owner[fresh]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
