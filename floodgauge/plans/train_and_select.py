"""Training of several models on a prepared table and choice of the one to use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.ml.registry import ModelPackage
from floodgauge.ml.training import train_and_compare, with_probability
from floodgauge.operators import metrics


def train_and_select(
    prepared: DataFrame, features: Sequence[str], label: str, estimators: dict, tune_threshold: bool = True
) -> tuple[ModelPackage, DataFrame]:
    """The model with the highest weighted accuracy, its threshold, and all metrics."""
    train, test = prepared.filter("split = 'train'"), prepared.filter("split = 'test'")
    fitted, table = train_and_compare(train, test, features, label, estimators, scale=False)
    ranked = table.withColumn("weighted", metrics.weighted_accuracy(F.col("model"), F.col("accuracy")))
    winner = metrics.best_by(ranked.select("model", "weighted"), [], "weighted", "model").first()["model"]
    threshold = metrics.DEFAULT_THRESHOLD
    if tune_threshold:
        scored = with_probability(fitted[winner], train).select(F.col(label).alias("y"), "score")
        threshold = metrics.best_threshold(scored, []).first()["threshold"]
    return ModelPackage(fitted[winner], list(features), threshold, winner), table
