"""Corpus and sentence TER (Snover 2006): edits after greedy block shifts, over reference words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import as_column
from glossmill.functions.text import squeeze
from glossmill.operators.ngrams import COUNTS, as_lists, chunks, clipped, lengths, symbols
from glossmill.operators.scoring import sum_statistics

# Limits that belong to the published definition of the score.
MAX_SHIFT_SIZE = 10
MAX_SHIFT_DISTANCE = 50
MAX_CANDIDATES = 1000
BEAM = 25

FAR = np.int32(2**28)
BATCH_CELLS = 4_000_000
FIRST_REACH = 4  # edits beyond the least ones that the first look at a pair allows


class Band:
    """Edit costs of many pairs at once, row by row, within the beam around each pair's diagonal.

    Column k of row i stands for reference position ``starts[i] + k``; row 0 is implied.
    """

    def __init__(self, hyps: list[np.ndarray], refs: list[np.ndarray], keep: bool):
        self.n = np.array([h.size for h in hyps])
        self.m = np.array([r.size for r in refs])
        self.hyp = _padded(hyps, -1)
        self.ref = _padded(refs, -2)
        ratio, half = self.m / self.n, half_widths(self.n, self.m)
        width = int(2 * half.max())
        pairs, steps = np.arange(self.n.size)[:, None], np.arange(width, dtype=np.int32)
        self.starts = np.floor(np.arange(self.n.max() + 1)[:, None] * ratio).astype(np.int32) - half.astype(np.int32)
        self.rows = [np.zeros((0, 0), dtype=np.int32)]
        self.total = np.zeros(self.n.size, dtype=np.int64)
        last, in_beam = self.m.astype(np.int32)[:, None], steps < 2 * half[:, None]
        previous = None
        for i in range(1, int(self.n.max()) + 1):
            at = self.starts[i][:, None] + steps
            valid = (at >= 0) & (at <= last) & in_beam
            if i == 1:
                above = np.where(at >= 0, at, FAR)
                diagonal = np.where(at >= 1, at - 1, FAR)
            else:
                moved = (self.starts[i] - self.starts[i - 1])[:, None]
                right = np.full((self.n.size, int(moved.max())), FAR, dtype=np.int32)
                framed = np.concatenate([np.full((self.n.size, 1), FAR, dtype=np.int32), previous, right], axis=1)
                diagonal, above = framed[pairs, steps + moved], framed[pairs, steps + moved + 1]
            words = self.ref[pairs, np.clip(at - 1, 0, self.ref.shape[1] - 1)]
            best = np.minimum(diagonal + (words != self.hyp[:, i - 1 : i]), above + 1)
            best = np.minimum.accumulate(np.where(valid, best, FAR) - steps, axis=1) + steps
            previous = np.where(valid, best, FAR).astype(np.int32)
            if keep:
                self.rows.append(previous)
            done = np.flatnonzero(self.n == i)
            self.total[done] = previous[done, self.m[done] - self.starts[i][done]]

    def cost(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Costs at one cell per pair; FAR outside the band."""
        pairs = np.arange(self.n.size)
        column = j - self.starts[np.maximum(i, 0), pairs]
        inside = (i > 0) & (column >= 0) & (column < self.costs.shape[2])
        found = self.costs[np.maximum(i, 1) - 1, pairs, np.where(inside, column, 0)]
        return np.where((i == 0) & (j >= 0), j, np.where(inside & (j >= 0), found, FAR))

    def alignment(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Wrong hypothesis words, wrong reference words, and the hypothesis position per reference word."""
        self.costs = np.stack(self.rows[1:])
        i, j, pairs = self.n.copy(), self.m.copy(), np.arange(self.n.size)
        hyp_wrong, ref_wrong = np.ones(self.hyp.shape, dtype=bool), np.ones(self.ref.shape, dtype=bool)
        at = np.full(self.ref.shape, -1, dtype=np.int64)
        while True:
            live = (i > 0) | (j > 0)
            if not live.any():
                return hyp_wrong, ref_wrong, at
            here, both = self.cost(i, j), (i > 0) & (j > 0)
            same = both & (self.hyp[pairs, np.maximum(i, 1) - 1] == self.ref[pairs, np.maximum(j, 1) - 1])
            paired = both & (here == self.cost(i - 1, j - 1) + ~same)
            dropped = live & ~paired & (i > 0) & (here == self.cost(i - 1, j) + 1)
            added = live & ~paired & ~dropped
            matched = np.flatnonzero(paired & same)
            hyp_wrong[matched, i[matched] - 1] = False
            ref_wrong[matched, j[matched] - 1] = False
            placed = np.flatnonzero(paired | added)
            at[placed, j[placed] - 1] = i[placed] - 1
            i = i - (paired | dropped)
            j = j - (paired | added)


class ThinBand:
    """Edit costs of pairs whose cost is at most ``limit``, on the diagonals that such a path can reach.

    A path of that cost ends ``m - n`` diagonals from where it began, so it meets ``limit + 1`` diagonals at most. While
    ``limit`` is below ``BEAM`` all of them lie in the beam of ``Band``; totals up to ``limit`` and the alignments behind
    them are the same there, larger totals only say that the cost is above ``limit``. Values are kept less their column,
    columns first, and pairs in the order of their length, so that a row takes the pairs that still go on.
    """

    def __init__(self, hyps: list[np.ndarray], refs: list[np.ndarray], limit: int, keep: bool):
        n, m = np.array([h.size for h in hyps]), np.array([r.size for r in refs])
        self.order = np.argsort(n, kind="stable")
        self.n, self.m, self.total = n, m, np.zeros(n.size, dtype=np.int64)
        n, m = n[self.order], m[self.order]
        self.low = np.minimum(m - n, 0) - np.maximum(limit - np.abs(m - n), 0) // 2
        width, longest = limit + 1, int(n[-1])
        self.hyp = _columns([hyps[p] for p in self.order], np.zeros(n.size, dtype=np.int64), longest, -1)
        # Row i and column k stand for reference position i + low + k, so each row takes the next rows of ``ref``.
        self.ref = _columns([refs[p] for p in self.order], -self.low, longest + width, -2)
        at = self.low + np.arange(width)[:, None]
        previous = np.where(at >= 0, self.low, FAR).astype(np.int32)
        self.costs = np.full((longest, width, n.size) if keep else (0, 0, 0), FAR, dtype=np.int32)
        ends = np.searchsorted(n, np.arange(longest + 1), side="right")
        for i in range(1, longest + 1):
            previous = previous[:, ends[i - 1] - n.size :]
            done = ends[i - 1]
            best = previous + (self.ref[i - 1 : i - 1 + width, done:] != self.hyp[i - 1, done:])
            np.minimum(best[:-1], previous[1:] + 2, out=best[:-1])
            for k in range(1, width):
                np.minimum(best[k], best[k - 1], out=best[k])
            previous = best
            if keep:
                self.costs[i - 1, :, done:] = previous
            last = np.arange(done, ends[i])
            column = m[last] - n[last] - self.low[last]
            inside = (column >= 0) & (column < width)
            self.total[self.order[last]] = np.where(inside, previous[np.where(inside, column, 0), last - done] + column, FAR)

    def alignment(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As in ``Band``, for pairs whose total is within the limit."""
        size = self.n.size
        hyp_wrong, ref_wrong = np.ones((size, self.n.max()), dtype=bool), np.ones((size, self.m.max()), dtype=bool)
        at = np.full(ref_wrong.shape, -1, dtype=np.int64)
        pairs, low, i, j = np.arange(size), self.low, self.n[self.order], self.m[self.order]
        width = self.costs.shape[1]

        def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            column = j - i - low
            inside = (i > 0) & (j >= 0) & (column >= 0) & (column < width)
            found = self.costs[np.maximum(i, 1) - 1, np.where(inside, column, 0), pairs] + column
            return np.where((i == 0) & (j >= 0), j, np.where(inside, found, FAR))

        here = cost(i, j)
        while pairs.size:
            both = (i > 0) & (j > 0)
            same = both & (self.hyp[np.maximum(i, 1) - 1, pairs] == self.ref[np.maximum(j - 1 - low, 0), pairs])
            paired = both & (here == cost(i - 1, j - 1) + ~same)
            dropped = ~paired & (i > 0) & (here == cost(i - 1, j) + 1)
            matched, placed = paired & same, ~dropped
            row = self.order[pairs]
            hyp_wrong[row[matched], i[matched] - 1] = False
            ref_wrong[row[matched], j[matched] - 1] = False
            at[row[placed], j[placed] - 1] = i[placed] - 1
            here = here - ~matched
            i, j = i - (paired | dropped), j - placed
            live = (i > 0) | (j > 0)
            if not live.all():
                pairs, low, i, j, here = pairs[live], low[live], i[live], j[live], here[live]
        return hyp_wrong, ref_wrong, at


def _columns(rows: list[np.ndarray], before: np.ndarray, height: int, filler: int) -> np.ndarray:
    """A column per row of numbers, each with its own room before it."""
    out = np.full((height, len(rows)), filler, dtype=np.int32)
    sizes = np.minimum(np.array([row.size for row in rows]), np.maximum(height - before, 0))
    column = np.repeat(np.arange(len(rows)), sizes)
    out[np.arange(column.size) - np.repeat(np.cumsum(sizes) - sizes - before, sizes), column] = np.concatenate([row[:size] for row, size in zip(rows, sizes)])
    return out


def _padded(rows: list[np.ndarray], filler: int) -> np.ndarray:
    out = np.full((len(rows), max(row.size for row in rows)), filler, dtype=np.int32)
    for at, row in enumerate(rows):
        out[at, : row.size] = row
    return out


def half_widths(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Reach of the beam on each side of the diagonal."""
    half = m / n / 2
    return np.where(half > BEAM, np.ceil(half + BEAM), BEAM).astype(np.int64)


def batches(hyps: list[np.ndarray], refs: list[np.ndarray], limits: np.ndarray) -> Iterator[tuple[np.ndarray, int | None]]:
    """Index runs of pairs of similar size and one limit (None: the whole beam), each with a bounded number of cost cells."""
    if not hyps:
        return
    n = np.array([h.size for h in hyps])
    thin = limits < BEAM
    width = np.where(thin, limits + 1, 2 * half_widths(n, np.array([r.size for r in refs])))
    order = np.lexsort((n, width, thin))
    start = 0
    while start < order.size:
        first = order[start]
        stop, longest = start + 1, n[first]
        while stop < order.size and thin[order[stop]] == thin[first] and (not thin[first] or width[order[stop]] == width[first]):
            longest = max(longest, n[order[stop]])
            if (stop + 1 - start) * int(longest) * int(width[order[stop]]) > BATCH_CELLS:
                break
            stop += 1
        yield order[start:stop], int(limits[first]) if thin[first] else None
        start = stop


def band(hyps: list[np.ndarray], refs: list[np.ndarray], limit: int | None, keep: bool) -> Band | ThinBand:
    return Band(hyps, refs, keep) if limit is None else ThinBand(hyps, refs, limit, keep)


def totals(hyps: list[np.ndarray], refs: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """Word edits of each pair, exact where they are within its limit or that is not below ``BEAM``; else some number above it."""
    found = np.zeros(len(hyps), dtype=np.int64)
    for part, limit in batches(hyps, refs, limits):
        found[part] = band([hyps[k] for k in part], [refs[k] for k in part], limit, keep=False).total
    return found


def least_edits(hyps: list[np.ndarray], refs: list[np.ndarray]) -> np.ndarray:
    """Edits that no order of the hypothesis words can save: those of the two bags of words."""
    n, m = np.array([h.size for h in hyps]), np.array([r.size for r in refs])
    left, right = np.concatenate(hyps).astype(np.int64), np.concatenate(refs).astype(np.int64)
    kinds = int(max(left.max(), right.max())) + 1
    rows = np.arange(n.size, dtype=np.int64) * kinds
    return np.maximum(n, m) - clipped(np.repeat(rows, n) + left, np.repeat(rows, m) + right, n, m)


def shifted(words: np.ndarray, start: int, length: int, target: int) -> np.ndarray:
    """``words`` with a block moved so that it comes before old position ``target``."""
    stop = start + length
    block = words[start:stop]
    if target > stop:
        return np.concatenate([words[:start], words[stop:target], block, words[target:]])
    if target > start:
        return np.concatenate([words[:start], words[stop : target + length], block, words[target + length :]])
    return np.concatenate([words[:target], block, words[target:start], words[stop:]])


def near_errors(wrong: np.ndarray) -> list[int]:
    """Positions from which a block of the largest size would reach a wrong word."""
    ahead = np.append(0, np.cumsum(wrong))
    ends = np.minimum(np.arange(wrong.size) + MAX_SHIFT_SIZE, wrong.size)
    return np.flatnonzero(ahead[ends] > ahead[:-1]).tolist()


def moves_of(
    hyp: list[int], ref: list[int], hyp_wrong: np.ndarray, ref_wrong: np.ndarray, at: list[int], budget: int
) -> list[tuple[int, int, int]]:
    """Block moves worth trying, (start, length, target): both sides of the block hold a wrong word.

    The list ends with the block at which ``budget`` is used up.
    """
    places: dict[int, list[int]] = {}
    for r in near_errors(ref_wrong):
        places.setdefault(ref[r], []).append(r)
    wrong_h, wrong_r = np.append(0, np.cumsum(hyp_wrong)).tolist(), np.append(0, np.cumsum(ref_wrong)).tolist()
    moves: list[tuple[int, int, int]] = []
    for h in near_errors(hyp_wrong):
        for r in places.get(hyp[h], ()):
            if abs(r - h) > MAX_SHIFT_DISTANCE:
                continue
            for length in range(1, min(MAX_SHIFT_SIZE, len(hyp) - h, len(ref) - r) + 1):
                if hyp[h + length - 1] != ref[r + length - 1]:
                    break
                if wrong_h[h + length] == wrong_h[h] or wrong_r[r + length] == wrong_r[r] or h <= at[r] < h + length:
                    continue
                last = None
                for offset in range(-1, length):
                    target = 0 if r + offset < 0 else at[r + offset] + 1
                    if target != last:
                        moves.append((h, length, target))
                        last = target
                if len(moves) >= budget:
                    return moves
    return moves


def edit_counts(hyps: list[np.ndarray], refs: list[np.ndarray]) -> np.ndarray:
    """Shifts plus word edits per pair. All pairs take their next greedy shift together.

    Costs are looked for near the diagonal first, and a shift is worth its edits only if they are fewer than before. A pair
    with no more edits than its two bags of words differ by takes no further shift.
    """
    counts = np.array([max(h.size, r.size) for h, r in zip(hyps, refs)], dtype=np.int64)
    words, tried, shifts = list(hyps), np.zeros(counts.size, dtype=np.int64), np.zeros(counts.size, dtype=np.int64)
    live = []
    for p, (h, r) in enumerate(zip(hyps, refs)):
        if h.size == r.size and (h == r).all():
            counts[p] = 0
        elif h.size and r.size:
            live.append(p)
    if not live:
        return counts
    least = np.zeros(counts.size, dtype=np.int64)
    least[live] = least_edits([hyps[p] for p in live], [refs[p] for p in live])
    open_ = np.array(live)
    for reach in (FIRST_REACH, BEAM - 1, BEAM):
        limits = np.full(open_.size, reach) if reach >= BEAM - 1 else np.minimum(least[open_] + reach, BEAM - 1)
        limits[least[open_] >= BEAM] = BEAM
        counts[open_] = totals([hyps[p] for p in open_], [refs[p] for p in open_], limits)
        open_ = open_[(counts[open_] > limits) & (limits < BEAM)]
    live = [p for p in live if counts[p] > least[p]]
    while live:
        options: list[tuple[int, tuple[int, int, int]]] = []
        left = counts - shifts
        for part, limit in batches([words[p] for p in live], [refs[p] for p in live], left[live]):
            members = [live[k] for k in part]
            hyp_wrong, ref_wrong, at = band([words[p] for p in members], [refs[p] for p in members], limit, keep=True).alignment()
            for k, p in enumerate(members):
                n, m = words[p].size, refs[p].size
                moves = moves_of(
                    words[p].tolist(), refs[p].tolist(), hyp_wrong[k, :n], ref_wrong[k, :m], at[k, :m].tolist(), MAX_CANDIDATES - int(tried[p])
                )
                tried[p] += len(moves)
                if tried[p] < MAX_CANDIDATES:
                    options += [(p, move) for move in moves]
        best: dict[int, tuple[int, int, int, int]] = {}
        limits = left[[p for p, _ in options]] - 1
        for part, limit in batches([words[p] for p, _ in options], [refs[p] for p, _ in options], limits):
            group = [options[k] for k in part]
            costs = band([shifted(words[p], *move) for p, move in group], [refs[p] for p, _ in group], limit, keep=False).total
            for (p, (start, length, target)), cost in zip(group, costs.tolist()):
                if cost < left[p]:
                    rank = (cost, -length, start, target)
                    best[p] = min(best.get(p, rank), rank)
        live = []
        for p, (cost, length, start, target) in best.items():
            if shifts[p] + cost < counts[p]:
                words[p] = shifted(words[p], start, -length, target)
                shifts[p] += 1
                counts[p] = shifts[p] + cost
                if cost > least[p]:
                    live.append(p)
    return counts


def count_matrix(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """A row per pair: edits and reference words."""
    parts = []
    for left, right in chunks(hyp, ref):
        hyp_len, ref_len = lengths(left), lengths(right)
        hyp_codes, ref_codes, _ = symbols(left, right)
        hyp_rows = np.split(hyp_codes, np.cumsum(hyp_len)[:-1])
        ref_rows = np.split(ref_codes, np.cumsum(ref_len)[:-1])
        parts.append(np.column_stack([edit_counts(hyp_rows, ref_rows), ref_len]))
    return np.concatenate(parts) if parts else np.zeros((0, 2), dtype=np.int64)


@F.arrow_udf(COUNTS)
def ter_statistics(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return as_lists(count_matrix(hyp, ref))


def tokens(c: Column | str, case_sensitive: bool = False) -> Column:
    text = F.coalesce(as_column(c), F.lit(""))
    return F.filter(F.split(squeeze(text if case_sensitive else F.lower(text)), " "), lambda word: word != "")


def statistics(hypothesis: str, reference: str, case_sensitive: bool = False) -> Column:
    return ter_statistics(tokens(hypothesis, case_sensitive), tokens(reference, case_sensitive))


def ter_column(edit_count: Column, ref_words: Column) -> Column:
    without_ref = F.when(edit_count > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when(ref_words > 0, 100.0 * edit_count / ref_words).otherwise(without_ref)


def signature(case_sensitive: bool = False) -> str:
    return f"nrefs:1|case:{'mixed' if case_sensitive else 'lc'}|tok:tercom|norm:no|punct:yes|asian:no"


def corpus_ter(
    df: DataFrame,
    by: list[str] | None = None,
    hypothesis: str = "hypothesis",
    reference: str = "reference",
    case_sensitive: bool = False,
) -> DataFrame:
    """TER of all rows, or of each group, with its edits and reference words."""
    sums = sum_statistics(df, statistics(hypothesis, reference, case_sensitive), 2, by)
    return sums.select(
        *(by or []),
        ter_column(F.col("s0"), F.col("s1")).alias("ter"),
        F.col("s0").alias("edits"),
        F.col("s1").alias("ref_words"),
        F.lit(signature(case_sensitive)).alias("signature"),
    )


def sentence_ter(
    df: DataFrame,
    hypothesis: str = "hypothesis",
    reference: str = "reference",
    case_sensitive: bool = False,
    out: str = "ter",
) -> DataFrame:
    """Each row with its own TER; no shuffle."""
    scored = df.withColumn("_s", statistics(hypothesis, reference, case_sensitive))
    return scored.withColumn(out, ter_column(F.get("_s", F.lit(0)), F.get("_s", F.lit(1)))).drop("_s")
