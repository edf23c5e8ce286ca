"""Scores of a run: fallbacks, combined score, bands and advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import as_column
from glossmill.functions.numbers import to_fixed

# The names a chrF score is stored under, first non-zero one wins.
CHRF_NAMES = ["chrf++", "chrf_pp", "chrf"]

# Upper bounds (exclusive) of the score bands.
BLEU_BANDS = [(10.0, "very_low"), (15.0, "below_baseline"), (20.0, "near_baseline"), (25.0, "competitive")]


def first_nonzero(metrics: Column | str, names: list[str]) -> Column:
    """First of the named metrics that is neither missing nor 0; the last name keeps its 0."""
    values = [F.try_element_at(as_column(metrics), F.lit(name)) for name in names]
    tested = [F.nullif(value, F.lit(0.0)) for value in values[:-1]]
    return F.coalesce(*tested, values[-1])


def combined_score(bleu: Column | str, chrf: Column | str, missing: str = "null") -> Column:
    """Geometric mean of the two scores. A missing or zero part gives NULL, or 0 with ``missing="zero"``."""
    product = F.nullif(as_column(bleu), F.lit(0.0)) * F.nullif(as_column(chrf), F.lit(0.0))
    score = F.sqrt(product)
    return F.coalesce(score, F.lit(0.0)) if missing == "zero" else score


def bleu_band(c: Column | str) -> Column:
    score = as_column(c)
    band = F.lit("strong")
    for bound, name in reversed(BLEU_BANDS):
        band = F.when(score < bound, F.lit(name)).otherwise(band)
    return F.when(score.isNotNull(), band)


def loss_band(c: Column | str) -> Column:
    """``high`` above 2, ``moderate`` above 1, ``low`` under 0.5, ``normal`` between."""
    loss = as_column(c)
    return (
        F.when(loss > 2, F.lit("high"))
        .when(loss > 1, F.lit("moderate"))
        .when(loss < 0.5, F.lit("low"))
        .when(loss.isNotNull(), F.lit("normal"))
    )


def slow_epochs(hours: Column | str, epochs: Column | str) -> Column:
    """Whether training takes more than one hour per epoch."""
    return as_column(hours) / F.nullif(as_column(epochs).cast("double"), F.lit(0.0)) > 1


def advice(bleu: Column | str, loss: Column | str, hours: Column | str, epochs: Column | str) -> Column:
    """Codes of what to do next, in a fixed order."""
    score = as_column(bleu)
    return F.array_compact(
        F.array(
            F.when(score < 20, F.lit("tune_hyperparameters")),
            F.when(score < 20, F.lit("augment_data")),
            F.when(score < 20, F.lit("try_larger_model")),
            F.when(score >= 20, F.lit("submit_for_official_score")),
            F.when(score >= 20, F.lit("try_ensemble")),
            F.when(score >= 20, F.lit("optimise_inference")),
            F.when(loss_band(loss) == "high", F.lit("underfitting")),
            F.when(loss_band(loss) == "low", F.lit("check_overfitting")),
            F.when(slow_epochs(hours, epochs), F.lit("speed_up_training")),
            F.lit("analyse_worst_predictions"),
            F.lit("compare_with_baselines"),
        )
    )


def metrics_text(metrics: Column | str, digits: int = 4) -> Column:
    """``bleu=0.1234, chrf=0.5000`` in the map's own order; missing values are dropped."""
    entries = F.map_entries(F.map_filter(as_column(metrics), lambda _, value: value.isNotNull()))
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), to_fixed(e["value"], digits)))
    return F.array_join(parts, ", ")
