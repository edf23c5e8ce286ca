"""Hyperparameter studies and votes of several models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.keyed import top_per_key

COMPLETE = "COMPLETE"


def _maximize() -> Column:
    return F.upper("direction") == "MAXIMIZE"


def study_summary(trials: DataFrame) -> DataFrame:
    """Direction, number of trials and best value of the completed ones, per study."""
    done = F.when(F.col("state") == COMPLETE, F.col("value"))
    sums = trials.groupBy("study", "direction").agg(
        F.count(F.lit(1)).alias("n_trials"), F.max(done).alias("_max"), F.min(done).alias("_min")
    )
    best = F.when(_maximize(), F.col("_max")).otherwise(F.col("_min"))
    return sums.select("study", "direction", "n_trials", best.alias("best_value"))


def study_best(trials: DataFrame, prefix: str = "") -> DataFrame:
    """Best completed trial per study with its parameters; the earliest trial wins a tie.

    A study without a completed trial has no row. ``prefix`` goes before every parameter name.
    """
    done = trials.where((F.col("state") == COMPLETE) & F.col("value").isNotNull())
    merit = F.when(_maximize(), F.col("value")).otherwise(-F.col("value"))
    best = top_per_key(done, ["study"], [merit.desc(), F.col("number").asc()], 1)
    params = F.col("params")
    if prefix:
        params = F.transform_keys(params, lambda key, _: F.concat(F.lit(prefix), key))
    return best.select("study", F.col("number").alias("best_trial"), F.col("value").alias("best_value"), params.alias("best_params"))


def last_trials(trials: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` trials with the highest number per study."""
    return top_per_key(trials, ["study"], [F.col("number").desc()], n)


def weighted_vote(predictions: DataFrame, key: str = "id", prediction: str = "prediction", weight: str = "weight") -> DataFrame:
    """Per key the prediction with the highest total weight; a tie goes to the smallest text."""
    votes = predictions.groupBy(key, prediction).agg(F.sum(weight).alias("votes"))
    return top_per_key(votes, [key], [F.col("votes").desc(), F.col(prediction).asc()], 1)
