"""Batch inference with a user's model, and comparison of several models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import as_column
from glossmill.functions.text import clean_translation, with_prefix
from glossmill.operators.bleu import DEFAULT, BleuSettings
from glossmill.operators.evaluation import evaluate, named

Predict = Callable[[list[str]], list[str]]


def copy_predictor() -> Predict:
    """Gives back its input; for testing an evaluation without a model."""
    return lambda texts: texts


def predict_column(c: Column | str, make_predict: Callable[[], Predict], batch_size: int = 16) -> Column:
    """Predictions for a text column. The model is made once per task; only this column goes to Python."""

    @F.pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_predict()
        for texts in batches:
            values = texts.tolist()
            found: list[str] = []
            for start in range(0, len(values), batch_size):
                batch = values[start : start + batch_size]
                answer = model(batch)
                if len(answer) != len(batch):
                    raise ValueError(f"model gave {len(answer)} answers to {len(batch)} texts")
                found.extend(answer)
            yield pd.Series(found, dtype=object)

    return predict(as_column(c))


def batch_infer(
    df: DataFrame,
    make_predict: Callable[[], Predict],
    source: str = "source",
    out: str = "prediction",
    batch_size: int = 16,
    prefix: str = "",
    clean: str | None = None,
) -> DataFrame:
    """Rows with their prediction: prefix, batches of fixed size, optional cleaning."""
    text = with_prefix(source, prefix) if prefix else F.col(source)
    predicted = df.withColumn(out, predict_column(text, make_predict, batch_size))
    return predicted.withColumn(out, clean_translation(out, clean)) if clean else predicted


def stack_models(
    df: DataFrame, models: dict[str, Column], keep: list[str], weights: dict[str, float] | None = None
) -> DataFrame:
    """One row per model and input row: model, weight, hypothesis. Weights default to equal shares.

    The input is read once; each row fans out into the listed models without a join.
    """
    share = weights or dict.fromkeys(models, 1.0 / len(models))
    entries = [
        F.struct(F.lit(name).alias("model"), F.lit(share[name]).alias("weight"), column.alias("hypothesis"))
        for name, column in models.items()
    ]
    return df.select(*keep, F.inline(F.array(*entries)))


def compare_models(
    df: DataFrame,
    models: dict[str, Column],
    reference: str = "reference",
    samples: int | None = None,
    order: list[str] | None = None,
    settings: BleuSettings = DEFAULT,
    secondary: list[str] | None = None,
) -> DataFrame:
    """BLEU per model, best first, and the ``secondary`` metrics beside it, all from one pass over the rows.

    ``samples`` limits the evaluation rows, taken in the given order.
    """
    if samples is not None:
        df = df.orderBy(*(order or [])).limit(samples)
    stacked = stack_models(df, models, [reference])
    metrics = named(["bleu", *[m for m in secondary or [] if m != "bleu"]], settings)
    scores = evaluate(stacked, metrics, ["model", "weight"], "hypothesis", reference)
    return scores.withColumn("signature", F.col("signatures")["bleu"]).orderBy(F.col("bleu").desc(), "model")
