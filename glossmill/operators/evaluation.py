"""Several metrics of the same pairs in one pass: one scan, one Python step, one shuffle of sums.

A metric is made of three things: the symbol columns that JVM expressions derive from either text, a count function that
turns a batch of them into integers per row, and a formula over their sums. ``evaluate`` lays the integers of all metrics
side by side in one array, so that the texts are read and sent once, and Spark adds the arrays up per group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import as_column
from glossmill.operators import bleu, chrf, ter
from glossmill.operators.bleu import count_matrix as bleu_counts
from glossmill.operators.chrf import count_matrix as chrf_counts
from glossmill.operators.ngrams import COUNTS, as_lists
from glossmill.operators.scoring import sum_statistics
from glossmill.operators.ter import count_matrix as ter_counts


@dataclass(frozen=True)
class Metric:
    """How one metric is counted and computed. Count functions travel to the executors: they name functions, not modules.

    ``symbols`` gives the columns (lists or texts) of one side; ``counts`` takes the Arrow arrays of the hypothesis side and
    of the reference side and returns a matrix of ``width`` integers per row; ``formula`` turns their sums into named
    columns, the score first under the metric's own name.
    """

    name: str
    symbols: Callable[[str], list[Column]]
    counts: Callable[[list[pa.Array], list[pa.Array]], np.ndarray]
    width: int
    formula: Callable[[list[Column]], list[Column]]
    signature: str


def bleu_metric(settings: bleu.BleuSettings = bleu.DEFAULT) -> Metric:
    return Metric(
        "bleu", lambda side: [bleu.tokens(side, settings)], lambda hyp, ref: bleu_counts(hyp[0], ref[0]), bleu.WIDTH,
        lambda sums: bleu.bleu_columns(sums, settings), settings.signature,
    )


def chrf_metric(word_order: int = 0, lowercase: bool = False) -> Metric:
    """chrF, or chrF++ (named ``chrf_words``) with word orders."""
    name = "chrf_words" if word_order else "chrf"
    orders = (chrf.CHAR_ORDER, word_order)

    def symbols(side: str) -> list[Column]:
        return [chrf.characters(side, lowercase), *([chrf.words(side, lowercase)] if word_order else [])]

    def counts(hyp: list[pa.Array], ref: list[pa.Array]) -> np.ndarray:
        return np.hstack([chrf_counts(h, r, n) for h, r, n in zip(hyp, ref, orders)])

    width = 3 * (chrf.CHAR_ORDER + word_order)
    return Metric(name, symbols, counts, width, lambda sums: [chrf.chrf_column(sums).alias(name)], chrf.signature(word_order, lowercase))


def ter_metric(case_sensitive: bool = False) -> Metric:
    def formula(sums: list[Column]) -> list[Column]:
        edits, ref_words = sums
        return [ter.ter_column(edits, ref_words).alias("ter"), edits.alias("edits"), ref_words.alias("ref_words")]

    return Metric(
        "ter", lambda side: [ter.tokens(side, case_sensitive)], lambda hyp, ref: ter_counts(hyp[0], ref[0]), 2, formula, ter.signature(case_sensitive)
    )


def exact_metric() -> Metric:
    """Share of hypotheses that equal their reference; NULL equals NULL."""

    def counts(hyp: list[pa.Array], ref: list[pa.Array]) -> np.ndarray:
        left, right = (side[0].to_numpy(zero_copy_only=False) for side in (hyp, ref))
        return np.column_stack([np.asarray(left == right, dtype=np.int64), np.ones(len(left), dtype=np.int64)])

    def formula(sums: list[Column]) -> list[Column]:
        return [F.when(sums[1] > 0, 100.0 * sums[0] / sums[1]).alias("exact"), sums[1].alias("pairs")]

    return Metric("exact", lambda side: [as_column(side)], counts, 2, formula, "exact")


def named(names: list[str], settings: bleu.BleuSettings = bleu.DEFAULT) -> list[Metric]:
    """Metrics by name: ``bleu``, ``chrf``, ``chrf_words``, ``ter``, ``exact``."""
    makers = {
        "bleu": lambda: bleu_metric(settings),
        "chrf": chrf_metric,
        "chrf_words": lambda: chrf_metric(word_order=2),
        "ter": ter_metric,
        "exact": exact_metric,
    }
    unknown = [name for name in names if name not in makers]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known are {sorted(makers)}")
    return [makers[name]() for name in dict.fromkeys(names)]


def statistics(metrics: list[Metric], hypothesis: str = "hypothesis", reference: str = "reference") -> Column:
    """One array per row with the integers of all metrics side by side. A text column that several metrics use is sent once."""
    sides = [[metric.symbols(side) for side in (hypothesis, reference)] for metric in metrics]
    columns = [c for hyp, ref in sides for c in (*hyp, *ref)]
    counted = [(metric.counts, len(hyp)) for metric, (hyp, _) in zip(metrics, sides)]

    @F.arrow_udf(COUNTS)
    def all_statistics(*arrays: pa.Array) -> pa.Array:
        parts, at = [], 0
        for counts, n in counted:
            parts.append(counts(list(arrays[at : at + n]), list(arrays[at + n : at + 2 * n])))
            at += 2 * n
        return as_lists(np.ascontiguousarray(np.hstack(parts), dtype=np.int64))

    return all_statistics(*columns)


def evaluate(
    df: DataFrame,
    metrics: list[Metric | str],
    by: list[str] | None = None,
    hypothesis: str = "hypothesis",
    reference: str = "reference",
) -> DataFrame:
    """All ``metrics`` over all rows, or per group, and a map of their signatures: one scan and one exchange.

    A NULL text counts as an empty one (``exact`` tells the two apart). Without rows an ungrouped evaluation has one row
    of zeros, a grouped one none. Two metrics must not share a name.
    """
    chosen = [named([m])[0] if isinstance(m, str) else m for m in metrics]
    names = [m.name for m in chosen]
    if not names or len(set(names)) < len(names):
        raise ValueError(f"metrics need different names, at least one; got {names}")
    width = sum(m.width for m in chosen)
    sums = sum_statistics(df, statistics(chosen, hypothesis, reference), width, by)
    columns, at = [], 0
    for metric in chosen:
        columns += metric.formula([F.col(f"s{k}") for k in range(at, at + metric.width)])
        at += metric.width
    signatures = F.create_map(*[F.lit(x) for m in chosen for x in (m.name, m.signature)])
    return sums.select(*(by or []), *columns, signatures.alias("signatures"))
