"""Corpus and sentence chrF and chrF++ (Popović 2015, 2017)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import SPACE, as_column
from glossmill.operators.ngrams import COUNTS, as_lists, chunks, match_table
from glossmill.operators.scoring import sum_statistics

CHAR_ORDER = 6
BETA = 2.0
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
OPENING_MARK = rf"(?U)(?<!\S)({PUNCTUATION})(?=\S*(?!{PUNCTUATION})\S(?!\S))"
CLOSING_MARK = rf"(?U)(?<=\S)({PUNCTUATION})(?!\S)"


def characters(c: Column | str, lowercase: bool = False) -> Column:
    """The text without white space."""
    text = F.coalesce(as_column(c), F.lit(""))
    return F.regexp_replace(F.lower(text) if lowercase else text, f"(?U){SPACE}+", "")


def words(c: Column | str, lowercase: bool = False) -> Column:
    """Words; a punctuation mark at the end of a word, else one at its start, stands alone."""
    text = F.coalesce(as_column(c), F.lit(""))
    text = F.lower(text) if lowercase else text
    text = F.regexp_replace(text, OPENING_MARK, "$1 ")
    text = F.regexp_replace(text, CLOSING_MARK, " $1")
    return F.array_remove(F.split(text, f"(?U){SPACE}+"), "")


def count_matrix(hyp: pa.Array, ref: pa.Array, orders: int) -> np.ndarray:
    """A row per pair, for each order: hypothesis n-grams (0 where the reference has none), reference n-grams, matches."""
    parts = []
    for left, right in chunks(hyp, ref):
        columns = []
        for hyp_total, ref_total, matched in match_table(left, right, orders):
            columns += [np.where(ref_total > 0, hyp_total, 0), ref_total, matched]
        parts.append(np.column_stack(columns))
    return np.concatenate(parts) if parts else np.zeros((0, 3 * orders), dtype=np.int64)


def statistics(hypothesis: str, reference: str, word_order: int = 0, lowercase: bool = False) -> Column:
    @F.arrow_udf(COUNTS)
    def char_statistics(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return as_lists(count_matrix(hyp, ref, CHAR_ORDER))

    @F.arrow_udf(COUNTS)
    def word_statistics(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return as_lists(count_matrix(hyp, ref, word_order))

    by_char = char_statistics(characters(hypothesis, lowercase), characters(reference, lowercase))
    if not word_order:
        return by_char
    return F.concat(by_char, word_statistics(words(hypothesis, lowercase), words(reference, lowercase)))


def chrf_column(sums: list[Column]) -> Column:
    """F-score of the mean precision and mean recall over the orders that both sides have."""
    precision, recall, orders = F.lit(0.0), F.lit(0.0), F.lit(0)
    for hyp, ref, matched in zip(sums[0::3], sums[1::3], sums[2::3]):
        both = (hyp > 0) & (ref > 0)
        precision = precision + F.when(both, matched / hyp).otherwise(F.lit(0.0))
        recall = recall + F.when(both, matched / ref).otherwise(F.lit(0.0))
        orders = orders + F.when(both, 1).otherwise(0)
    weight = BETA**2
    p, r = precision / orders, recall / orders
    value = 100.0 * (1 + weight) * p * r / (weight * p + r)
    return F.when((orders > 0) & (precision + recall > 0), value).otherwise(F.lit(0.0))


def signature(word_order: int, lowercase: bool) -> str:
    return f"nrefs:1|case:{'lc' if lowercase else 'mixed'}|eff:yes|nc:{CHAR_ORDER}|nw:{word_order}|space:no"


def corpus_chrf(
    df: DataFrame,
    by: list[str] | None = None,
    hypothesis: str = "hypothesis",
    reference: str = "reference",
    word_order: int = 0,
    lowercase: bool = False,
) -> DataFrame:
    """chrF of all rows, or of each group; ``word_order=2`` is chrF++."""
    width = 3 * (CHAR_ORDER + word_order)
    sums = sum_statistics(df, statistics(hypothesis, reference, word_order, lowercase), width, by)
    value = chrf_column([F.col(f"s{i}") for i in range(width)])
    return sums.select(*(by or []), value.alias("chrf"), F.lit(signature(word_order, lowercase)).alias("signature"))


def sentence_chrf(
    df: DataFrame,
    hypothesis: str = "hypothesis",
    reference: str = "reference",
    word_order: int = 0,
    lowercase: bool = False,
    out: str = "chrf",
) -> DataFrame:
    """Each row with its own chrF; no shuffle."""
    width = 3 * (CHAR_ORDER + word_order)
    scored = df.withColumn("_s", statistics(hypothesis, reference, word_order, lowercase))
    return scored.withColumn(out, chrf_column([F.get("_s", F.lit(i)) for i in range(width)])).drop("_s")
