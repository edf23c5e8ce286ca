"""Corpus, grouped, k-fold and sentence BLEU (Papineni 2002, settings after Post 2018)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import SPACE, SPACES, as_column, bind
from glossmill.operators.ngrams import COUNTS, as_lists, chunks, lengths, match_table
from glossmill.operators.scoring import sum_statistics

ORDER = 4
WIDTH = 2 + 2 * ORDER

# Entities and separators of the published 13a and international tokenizers.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
SIGN = r"[!-&(-+/:-@\[-`{-~]|(?<=[0-9])-"
POINT_AFTER_TEXT = r"([^0-9])([.,])"
POINT_BEFORE_TEXT = r"([.,])([^0-9])"
SIGN_OR_POINT = r"[!-&(-/:-@\[-`{-~](?<![0-9][.,](?=[0-9]))(?<![^0-9]-|^-)"
INTERNATIONAL = [(r"(\P{N})(\p{P})", "$1 $2 "), (r"(\p{P})(\P{N})", " $1 $2"), (r"(\p{S})", " $1 ")]
# The blocks of Chinese characters and signs that the ``zh`` tokenizer sets apart.
HAN_BLOCKS = [
    ("3400", "4db5"), ("4e00", "9fbb"), ("f900", "fa2d"), ("fa30", "fa6a"), ("fa70", "fad9"),
    ("20000", "2a6d6"), ("2f800", "2fa1d"), ("ff00", "ffef"), ("2e80", "2eff"), ("3000", "303f"),
    ("31c0", "31ef"), ("2f00", "2fdf"), ("2ff0", "2fff"), ("3100", "312f"), ("31a0", "31bf"),
    ("fe10", "fe1f"), ("fe30", "fe4f"), ("2600", "26ff"), ("2700", "27bf"), ("3200", "33ff"),
]
HAN = "([" + "".join(rf"\x{{{first}}}-\x{{{last}}}" for first, last in HAN_BLOCKS) + "])"


@dataclass(frozen=True)
class BleuSettings:
    """What a score depends on besides the texts."""

    tokenizer: str = "13a"
    lowercase: bool = False
    effective_order: bool = False

    @property
    def signature(self) -> str:
        case = "lc" if self.lowercase else "mixed"
        effective = "yes" if self.effective_order else "no"
        return f"nrefs:1|case:{case}|eff:{effective}|tok:{self.tokenizer}|smooth:exp"


DEFAULT = BleuSettings()


def _set_apart(text: Column) -> Column:
    """13a: signs stand alone, and so do points and commas unless they lie between two digits.

    The two point rules only act on each other where points follow one another; elsewhere one pass
    over the text does the work of three.
    """
    alone = F.regexp_replace(text, SIGN_OR_POINT, " $0 ")
    chained = F.concat(F.lit(" "), F.regexp_replace(text, SIGN, " $0 "), F.lit(" "))
    chained = F.regexp_replace(chained, POINT_AFTER_TEXT, "$1 $2 ")
    chained = F.regexp_replace(chained, POINT_BEFORE_TEXT, " $1 $2")
    return F.when(text.rlike("[.,]{2}"), chained).otherwise(alone)


def _decoded(text: Column) -> Column:
    """13a: without line-end hyphens and with the four entities resolved."""
    plain = F.replace(F.rtrim(text, F.lit(SPACES)), F.lit("<skipped>"), F.lit(""))
    plain = F.replace(plain, F.lit("-\n"), F.lit(""))

    def resolved(t: Column) -> Column:
        full = t
        for old, new in ENTITIES:
            full = F.replace(full, F.lit(old), F.lit(new))
        return F.when(t.contains("&"), full).otherwise(t)

    return bind(plain, resolved)


def tokens(c: Column | str, settings: BleuSettings = DEFAULT) -> Column:
    """Words of a text under one of the tokenizers ``13a``, ``intl``, ``zh`` and ``none``."""
    text = F.coalesce(as_column(c), F.lit(""))
    if settings.lowercase:
        text = F.lower(text)
    if settings.tokenizer == "13a":
        text = bind(_decoded(text), _set_apart)
    elif settings.tokenizer == "zh":
        text = bind(F.regexp_replace(text, HAN, " $1 "), _set_apart)
    elif settings.tokenizer == "intl":
        for pattern, replacement in INTERNATIONAL:
            text = F.regexp_replace(text, pattern, replacement)
    return F.array_remove(F.split(text, f"(?U){SPACE}+"), "")


def count_matrix(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """A row per pair: hypothesis length, reference length, then matches and n-grams for each order."""
    parts = []
    for left, right in chunks(hyp, ref):
        columns = [lengths(left), lengths(right)]
        for total, _, matched in match_table(left, right, ORDER):
            columns += [matched, total]
        parts.append(np.column_stack(columns))
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), dtype=np.int64)


@F.arrow_udf(COUNTS)
def bleu_statistics(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return as_lists(count_matrix(hyp, ref))


def statistics(hypothesis: str, reference: str, settings: BleuSettings = DEFAULT) -> Column:
    return bleu_statistics(tokens(hypothesis, settings), tokens(reference, settings))


def bleu_columns(sums: list[Column], settings: BleuSettings = DEFAULT) -> list[Column]:
    """Score, precisions, brevity penalty and lengths from summed statistics.

    The k-th order without a match counts as 1 / 2^k matches. No match at all gives 0, and so does a
    text shorter than the highest order unless ``effective_order`` is set.
    """
    hyp_len, ref_len = sums[0], sums[1]
    matched, total = sums[2::2], sums[3::2]
    misses = F.lit(0)
    precisions, logs, orders = [], F.lit(0.0), F.lit(0)
    any_match = F.lit(False)
    for hits, grams in zip(matched, total):
        any_match = any_match | (hits > 0)
        misses = misses + F.when(hits == 0, 1).otherwise(0)
        smoothed = F.when(hits == 0, F.lit(100.0) / (F.pow(F.lit(2.0), misses) * grams)).otherwise(100.0 * hits / grams)
        precision = F.when(grams == 0, F.lit(0.0)).otherwise(smoothed)
        precisions.append(precision)
        logs = logs + F.when(grams > 0, F.ln(precision)).otherwise(F.lit(0.0))
        orders = orders + F.when(grams > 0, 1).otherwise(0)
    penalty = F.when(hyp_len >= ref_len, F.lit(1.0)).when(hyp_len > 0, F.exp(1 - ref_len / hyp_len)).otherwise(F.lit(0.0))
    usable = any_match if settings.effective_order else any_match & (orders == ORDER)
    value = F.when(usable, penalty * F.exp(logs / orders)).otherwise(F.lit(0.0))
    shown = [F.when(any_match, p).otherwise(F.lit(0.0)) for p in precisions]
    return [
        value.alias("bleu"),
        *[p.alias(f"precision_{n}") for n, p in enumerate(shown, 1)],
        penalty.alias("brevity_penalty"),
        hyp_len.alias("sys_len"),
        ref_len.alias("ref_len"),
    ]


def corpus_bleu(
    df: DataFrame,
    by: list[str] | None = None,
    hypothesis: str = "hypothesis",
    reference: str = "reference",
    settings: BleuSettings = DEFAULT,
) -> DataFrame:
    """BLEU of all rows, or of each group: score, precisions, penalty, lengths and settings."""
    sums = sum_statistics(df, statistics(hypothesis, reference, settings), WIDTH, by)
    columns = bleu_columns([F.col(f"s{i}") for i in range(WIDTH)], settings)
    return sums.select(*(by or []), *columns, F.lit(settings.signature).alias("signature"))


def sentence_bleu(
    df: DataFrame,
    hypothesis: str = "hypothesis",
    reference: str = "reference",
    settings: BleuSettings = DEFAULT,
    out: str = "bleu",
) -> DataFrame:
    """Each row with its own BLEU score; no shuffle."""
    scored = df.withColumn("_s", statistics(hypothesis, reference, settings))
    value = bleu_columns([F.get("_s", F.lit(i)) for i in range(WIDTH)], settings)[0]
    return scored.withColumn(out, value).drop("_s")


def worst_and_best(df: DataFrame, n: int = 10, key: str = "id", column: str = "bleu") -> DataFrame:
    """The ``n`` lowest and ``n`` highest rows; each task keeps its own ``n``, nothing is sorted whole.

    Keys and scores pass one exchange that both ends read, so rows are scored once. The other columns are
    fetched for the chosen rows only, of which there are at most ``2 n``. Nothing runs while the query is built.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scores = df.select(key, column).repartition(parts)
    worst = scores.orderBy(F.col(column).asc(), F.col(key).asc()).limit(n).withColumn("side", F.lit("worst"))
    best = scores.orderBy(F.col(column).desc(), F.col(key).desc()).limit(n).withColumn("side", F.lit("best"))
    chosen = worst.unionByName(best)
    if set(df.columns) == {key, column}:
        return chosen
    return df.drop(column).join(chosen, key)


def kfold_bleu(df: DataFrame, fold: str = "fold", settings: BleuSettings = DEFAULT, **columns: str) -> DataFrame:
    """Overall BLEU, and mean and population deviation over folds: one row.

    The statistics are summed per fold once; the overall score adds the folds up.
    """
    names = {"hypothesis": "hypothesis", "reference": "reference", **columns}
    folds = sum_statistics(df, statistics(names["hypothesis"], names["reference"], settings), WIDTH, [fold])
    per_fold = bleu_columns([F.col(f"s{i}") for i in range(WIDTH)], settings)[0]
    totals = folds.withColumn("_fold_bleu", per_fold).agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(WIDTH)],
        F.count(F.lit(1)).alias("folds"),
        F.avg("_fold_bleu").alias("mean_bleu"),
        F.stddev_pop("_fold_bleu").alias("std_bleu"),
    )
    overall = bleu_columns([F.col(f"s{i}") for i in range(WIDTH)], settings)[0]
    return totals.select("folds", overall.alias("overall_bleu"), "mean_bleu", "std_bleu")
