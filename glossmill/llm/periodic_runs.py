"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, at least two periods and ``LEAST`` words long, that no neighbouring
word extends. The automaton of a stretch of words is built once; its suffix links form a tree, in which the path from
the root to the state of the first i words holds the suffixes ending there. Each appended word accesses that path in a
link-cut tree: the path is cut out of the preferred paths it crosses and becomes one, coloured i. A piece cut out that
was coloured j, with l words in its deepest state, says that the last l words ended last at j. If p = i - j is at most
l, the last l + p words have smallest period p (a square), and l being the longest, no word before them extends it. A
square that the next word continues is left to that word, so that each run is met once, complete.

Every six words of a run (half of ``LEAST``) stand twice in it, so words that lie in no six words occurring twice can be
in no run. Before the automaton, texts are cut at such words, again and again until every stretch repeats something in
itself; this loses nothing, and of ordinary prose little is left. Only hashes of words are compared, with 64 bits.

Documents are worked on one by one inside tasks: no shuffle. A text of n words takes O(n log n) steps; memory grows with
the longest repetitive stretch, by some 500 bytes a word.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; a null key stays null;
repeated rows are repeated in the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W

LEAST = 12
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64


def suffix_automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest length) of every state, and the state of every prefix; state 0 is the empty word."""
    steps: list[dict[int, int]] = [{}]
    link, length, prefix, last = [-1], [0], [], 0
    for i, c in enumerate(symbols):
        new = len(length)
        steps.append({})
        length.append(i + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = link[at]
        if at >= 0:
            to = steps[at][c]
            if length[at] + 1 != length[to]:
                copy = len(length)
                steps.append(steps[to].copy())
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = copy
                while at >= 0 and steps[at].get(c) == to:
                    steps[at][c] = copy
                    at = link[at]
                to = copy
            link[new] = to
        prefix.append(new)
        last = new
    return link, length, prefix


class Paths:
    """A link-cut tree over a forest whose parents are given (0: none): preferred paths as splay trees, by depth.

    A path has one colour, kept at the root of its splay tree. Nodes are never re-rooted, so nothing is pushed down.
    """

    def __init__(self, parents: list[int]):
        self.up = [max(p, 0) for p in parents]
        self.left, self.right, self.colour = ([0] * len(parents) for _ in range(3))

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            for y in (p if inner and (left[g] == p) == (left[p] == x) else x, x) if inner else (x,):
                p = up[y]
                g = up[p]
                if left[p] == y:
                    moved = left[p] = right[y]
                    right[y] = p
                else:
                    moved = right[p] = left[y]
                    left[y] = p
                if moved:
                    up[moved] = p
                up[p] = y
                up[y] = g
                if left[g] == p and g:
                    left[g] = y
                elif right[g] == p and g:
                    right[g] = y

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Makes the path from the root to ``x`` one of the given colour; (colour, deepest node) of the pieces it took."""
        up, left, right, colours = self.up, self.left, self.right, self.colour
        taken, below = [], 0
        while x:
            top = x
            while (p := up[top]) and (left[p] == top or right[p] == top):
                top = p
            old = colours[top]
            self._splay(x)
            taken.append((old, x))
            rest = right[x]
            if rest:
                colours[rest] = old
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return taken


def runs_of(symbols: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    n = len(symbols)
    link, length, prefix = suffix_automaton(symbols)
    paths, out = Paths(link), []
    for i in range(1, n + 1):  # colours are numbers of words read, 0 for none
        for j, state in paths.access(prefix[i - 1], i):
            p = i - j
            if j and length[state] >= p and length[state] + p >= least and (i == n or symbols[i] != symbols[i - p]):
                out.append((i - length[state] - p, length[state] + p, p))
    out.sort(key=lambda r: (r[0], r[2]))
    return out


def stretches(hashes: np.ndarray, rows: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal stretches within a row that can hold runs."""
    width = (least + 1) // 2
    at, owner = np.arange(len(hashes)), rows.astype(np.uint64)
    while len(at):
        found, first = W.windows(hashes[at], owner, width)
        keys = W.mix(found ^ W.mix(owner[first] + _U(1)))
        ordered = np.sort(keys)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        hit = first[np.isin(keys, twice)] if len(twice) else first[:0]
        depth = np.zeros(len(at) + 1, np.int64)
        depth[hit] += 1
        depth[hit + width] -= 1
        kept = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
        # A new stretch begins where words between were left out or another one ends.
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (np.diff(kept) > 1) | (owner[kept][1:] != owner[kept][:-1])
        whole = len(kept) == len(at)
        at, again = at[kept], np.cumsum(fresh).astype(np.uint64)
        if whole and len(np.unique(owner)) == (int(again[-1]) if len(again) else 0):
            break
        owner = again
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(at) else np.empty(0, np.int64)
    return at[starts], at[np.append(starts[1:], len(at)) - 1] + 1 if len(at) else starts


def _joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row with one space between them."""
    starts, ends, rows = starts[kept], ends[kept], rows[kept]
    inner = ends[:-1][rows[1:] == rows[:-1]]  # after these a space, in the place of the first byte behind the word
    text = np.append(data, np.uint8(32))
    text[inner] = 32
    inside = np.zeros(len(text) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # starts and ends are distinct among themselves
    mask = np.cumsum(inside[:-1], dtype=np.int8) > 0
    mask[inner] = True
    sizes = np.concatenate([[0], np.cumsum(mask[: len(data)], dtype=np.int64)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(sizes.tobytes()), pa.py_buffer(text[: len(data)][mask[: len(data)]].tobytes()))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs of (start, length, period), collapsed) per row; the last is the text without the words that a
    run holds after its first period, the rest joined by single spaces."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in W.blocks(batches, "text"):
            starts, ends, rows = W.words(data, offsets)
            hashes = W.byte_span_hash(data, starts, ends)
            n = len(offsets) - 1
            base = np.searchsorted(rows, np.arange(n + 1))
            found, owner = [], []
            for a, b in zip(*(x.tolist() for x in stretches(hashes, rows, least))):
                own = runs_of(np.unique(hashes[a:b], return_inverse=True)[1].tolist(), least)
                found += [(s + a, length, p) for s, length, p in own]
                owner += [int(rows[a])] * len(own)
            # Stretches come in the order of their places, so rows, starts and periods are in order.
            start, length, period = np.array(found, np.int64).reshape(-1, 3).T
            row = np.array(owner, np.int64)
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, start + length, -1)
            kept = np.cumsum(depth[:-1]) == 0
            items = pa.StructArray.from_arrays([pa.array(start - base[row]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            lists = W.list_array(items, np.searchsorted(row, np.arange(n + 1)))
            collapsed = _joined(data, offsets, starts, ends, rows, kept)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(base)), lists, collapsed.cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("key", key)


def folded(text: Column, mark: Column) -> Column:
    """Text whose words from number a on repeat with period p, if ``mark`` is a multiple of 10: with g a tenth of it and n
    words, a = g % n and p = 1 + (n - a) // (3 + g % 8). Other texts, and those without words, stay."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def fold(held: Column) -> Column:
        n, g = F.size(held), F.floor(mark / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(held, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(held, F.lit(1), a), tail), " ")).otherwise(text)

    # The words stand in an array of one, so that they are found once.
    made = F.get(F.transform(F.array(words), fold), F.lit(0))
    return F.when((mark % 10 == 0) & text.isNotNull(), made).otherwise(text)
