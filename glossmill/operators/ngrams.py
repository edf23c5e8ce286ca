"""Clipped n-gram matches of many text pairs at once.

The matches of a pair depend on that pair alone, so they need no shuffle: each Arrow batch is scored
where it lies and Spark adds up small integers. Within a batch all n-grams become integer keys that are
sorted once, or once per order where the longest n-gram does not fit into one key; the keys are exact, not hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

COUNTS = T.ArrayType(T.LongType())
CHUNK_SYMBOLS = 200_000
KEY_LIMIT = 2**61


def lengths(column: pa.Array) -> np.ndarray:
    """Symbols per row: list elements or characters, 0 for NULL."""
    size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.utf8_length(column)
    return size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def symbols(hyp: pa.Array, ref: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Small integers for the symbols of both sides, equal for equal symbols, and how many there are."""
    if pa.types.is_list(hyp.type):
        left, right = hyp.flatten(), ref.flatten()
        encoded = pa.concat_arrays([left, right]).dictionary_encode()
        codes, kinds = encoded.indices.to_numpy(), len(encoded.dictionary)
        return codes[: len(left)], codes[len(left) :], max(kinds, 1)
    left, right = (np.frombuffer("".join(pc.fill_null(side, "").to_pylist()).encode("utf-32-le"), np.uint32) for side in (hyp, ref))
    present = np.zeros(max((int(side.max()) + 1 for side in (left, right) if side.size), default=1), dtype=bool)
    present[left], present[right] = True, True
    number = np.cumsum(present) - 1
    return number[left], number[right], max(int(number[-1]) + 1, 1)


def chunks(hyp: pa.Array, ref: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of rows with a bounded number of symbols, so that one batch of long texts fits in memory."""
    running = np.cumsum(lengths(hyp) + lengths(ref))
    start = 0
    while start < len(hyp):
        done = running[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(running, done + CHUNK_SYMBOLS, side="right")))
        yield hyp.slice(start, stop - start), ref.slice(start, stop - start)
        start = stop


def clipped(hyp_keys: np.ndarray, ref_keys: np.ndarray, hyp_count: np.ndarray, ref_count: np.ndarray) -> np.ndarray:
    """Matches per row. Keys order by row first; the lowest bit tells the two sides apart."""
    keys = np.concatenate([hyp_keys << 1, (ref_keys << 1) | 1])
    rows = hyp_count.size
    if keys.size == 0:
        return np.zeros(rows, dtype=np.int64)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, keys.size))
    key, row = keys[first], np.repeat(np.arange(rows), hyp_count + ref_count)[first]
    met = np.flatnonzero((key[:-1] & 1 == 0) & (key[:-1] + 1 == key[1:]))
    found = np.bincount(row[met], weights=np.minimum(count[met], count[met + 1]), minlength=rows)
    return found.astype(np.int64)


def padded_keys(codes: np.ndarray, size: np.ndarray, orders: int, bits: int) -> np.ndarray:
    """Row and the next ``orders`` symbols of every position as one number; behind the end of a row symbols are 0."""
    row = np.repeat(np.arange(size.size), size)
    at = np.arange(codes.size) + row * (orders - 1)
    room = codes.size + size.size * (orders - 1)
    spread = np.zeros(room + orders, dtype=np.int64)
    spread[at] = codes + 1
    keys = spread[:room].copy()
    for k in range(1, orders):
        keys <<= bits
        keys |= spread[k : k + room]
    return keys[at] | (row << (bits * orders))


def prefix_matches(
    sides: list[tuple[np.ndarray, np.ndarray]], orders: int, bits: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The table from one sort: in the order of the longest n-grams the shorter ones, their beginnings, lie side by side."""
    (left, hyp_len), (right, ref_len) = sides
    keys = np.concatenate([padded_keys(left, hyp_len, orders, bits) << 1, (padded_keys(right, ref_len, orders, bits) << 1) | 1])
    keys.sort()
    # Where n-grams begin: the highest bit at which each differs from the one before; positions and, in the lower half,
    # reference n-grams so far.
    change = np.concatenate([[0], keys[1:] ^ keys[:-1]])[: keys.size]
    change[:1] = 2**62
    places = (np.arange(keys.size + 1) << 32) + np.concatenate([[0], np.cumsum(keys & 1)])
    end, places = places[-1:], places[:-1]
    result = []
    for order in range(orders, 0, -1):
        drop = 1 + bits * (orders - order)
        begins = np.flatnonzero(change >= 1 << drop)
        change, places = change.take(begins), places.take(begins)
        both = np.diff(places, append=end)
        ref_count = both & 0xFFFFFFFF
        found = np.minimum((both >> 32) - ref_count, ref_count)
        met = np.flatnonzero(found)
        key = keys[places[met] >> 32] >> drop
        whole = key & ((1 << bits) - 1) != 0
        matched = np.bincount(key[whole] >> (bits * order), weights=found[met[whole]], minlength=hyp_len.size).astype(np.int64)
        result.append((*(np.maximum(size - order + 1, 0) for size in (hyp_len, ref_len)), matched))
    return result[::-1]


def match_table(hyp: pa.Array, ref: pa.Array, orders: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order 1..n: n-grams of the hypothesis, of the reference, and clipped matches, by row."""
    hyp_len, ref_len = lengths(hyp), lengths(ref)
    left, right, kinds = symbols(hyp, ref)
    bits = kinds.bit_length()
    if len(hyp).bit_length() + orders * bits < 63:
        return prefix_matches([(left, hyp_len), (right, ref_len)], orders, bits)
    sides = []
    for codes, size in ((left, hyp_len), (right, ref_len)):
        row = np.repeat(np.arange(size.size), size)
        remaining = np.repeat(np.cumsum(size), size) - np.arange(codes.size)
        sides.append([codes.astype(np.int64), remaining, np.arange(codes.size), row.astype(np.int64)])
    result = []
    for order in range(1, orders + 1):
        peak = max((int(keys.max()) for *_, keys in sides if keys.size), default=0)
        if peak >= KEY_LIMIT // kinds:
            split = sides[0][3].size
            ranks = np.unique(np.concatenate([sides[0][3], sides[1][3]]), return_inverse=True)[1]
            sides[0][3], sides[1][3] = ranks[:split], ranks[split:]
        for side in sides:
            codes, remaining, at, keys = side
            fits = remaining[at] >= order
            at = at[fits]
            side[2:] = [at, keys[fits] * kinds + codes[at + order - 1]]
        counts = [np.maximum(size - order + 1, 0) for size in (hyp_len, ref_len)]
        result.append((*counts, clipped(sides[0][3], sides[1][3], *counts)))
    return result


def as_lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column of 64-bit integers."""
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1), pa.int64()))
