"""Evaluation of scored rows and comparison of models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.operators.ordered import cumulate_by_value, exact_percentiles, grouped_percentiles
from floodgauge.session import checkpointed, null_safe_join


def _safe(numerator: Column, denominator: Column) -> Column:
    """Zero when the denominator is zero."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def confusion(df: DataFrame, keys: Sequence[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    truth, guess = F.col(y) == 1, F.col(predicted) == 1
    return df.groupBy(*keys).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(truth & ~guess).alias("fn"),
    )


def binary_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall, F1, false positive rate and false discovery rate per key."""
    return metrics_of_counts(confusion(df, keys, y, predicted), keys)


def metrics_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *keys, "tp", "fp", "tn", "fn",
        _safe(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _safe(tp, tp + fp).alias("precision"),
        _safe(tp, tp + fn).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _safe(fp, fp + tn).alias("false_positive_rate"),
        F.when(tp + fp > 0, fp / (tp + fp)).otherwise(F.lit(1.0)).alias("false_discovery_rate"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Exact area under the curve, ties counted half; 0 when a class is missing.

    Equal scores are counted first; the running count of negatives below each score is built over
    range partitions.
    """
    keys = list(keys)
    per_score = df.groupBy(*keys, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    ranked = cumulate_by_value(per_score, keys, score, ["neg"])
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*keys).agg(_safe(F.sum(wins), pairs).alias("auc_roc"))


def class_report(df: DataFrame, keys: Sequence[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    keys = list(keys)
    pairs = df.groupBy(*keys, F.col(y).alias("_y"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # Each pair counts once for the true class and once for the predicted one.
    sides = pairs.select(
        *keys, "_n", (F.col("_y") == F.col("_p")).alias("_hit"),
        F.inline(F.array(
            F.struct(F.col("_y").cast("string").alias("label"), F.lit(1).alias("_true")),
            F.struct(F.col("_p").cast("string").alias("label"), F.lit(0).alias("_true")),
        )),
    )
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))
    actual = F.col("_true") == 1
    counted = sides.groupBy(*keys, "label").agg(
        n(actual & F.col("_hit")).alias("_tp"), n(actual).alias("support"), n(~actual).alias("_guessed")
    )
    per_class = counted.select(
        *keys, "label",
        _safe(F.col("_tp"), F.col("_guessed")).alias("precision"),
        _safe(F.col("_tp"), F.col("support")).alias("recall"),
        _safe(2 * F.col("_tp"), F.col("_guessed") + F.col("support")).alias("f1_score"),
        "support",
    )
    names = ("precision", "recall", "f1_score")
    macro = per_class.groupBy(*keys).agg(
        F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")
    )
    weighted = per_class.groupBy(*keys).agg(
        F.lit("weighted avg").alias("label"),
        *[_safe(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return per_class.unionByName(macro).unionByName(weighted)


def weighted_f1(df: DataFrame, keys: Sequence[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    report = class_report(df, keys, y, predicted).filter("label = 'weighted avg'")
    return report.select(*keys, F.col("f1_score").alias("weighted_f1"))


def confidence_stats(df: DataFrame, keys: Sequence[str], probability: str = "score") -> DataFrame:
    """Statistics of the attack probability and of the probability of the chosen class."""
    p = F.col(probability)
    chosen = F.greatest(p, 1 - p)
    return df.groupBy(*keys).agg(
        F.avg(p).alias("mean_confidence"),
        F.min(p).alias("min_confidence"),
        F.max(p).alias("max_confidence"),
        F.avg((p > 0.9).cast("double")).alias("high_confidence_ratio"),
        F.avg(chosen).alias("mean_max_probability"),
        F.min(chosen).alias("min_max_probability"),
        F.count_if(chosen > 0.8).alias("n_confident"),
    )


def anomaly_stats(df: DataFrame, keys: Sequence[str], decision: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(decision).alias("mean_score"),
        F.min(decision).alias("min_score"),
        F.max(decision).alias("max_score"),
        F.avg((F.col(predicted) == 1).cast("double")).alias("anomalies_detected"),
    )


def latency_stats(df: DataFrame, value: str = "latency", keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, extremes, sample deviation (0 for one value), p95 and p99."""
    keys = list(keys)
    # One narrow column, read several times below.
    df = checkpointed(df.select(*keys, value))
    basic = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_dev"),
    )
    percents = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    if keys:
        return null_safe_join(basic, grouped_percentiles(df, keys, value, percents), keys, "left")
    found = exact_percentiles(df, {value: list(percents.values())})[value]
    # Without a single value there is no row, as with empty statistics.
    return basic.filter(F.col("count") > 0).select(
        "*", *[F.lit(found[p]).cast("double").alias(n) for n, p in percents.items()]
    )


def performance_report(stats: DataFrame, test_type: str = "test_type") -> DataFrame:
    """Mean, best and worst over the mean, p95 and p99 of all tests, and the kinds of test."""
    pooled = stats.select(test_type, F.explode(F.array("mean", "p95", "p99")).alias("_v"))
    summary = pooled.agg(
        F.avg("_v").alias("mean_of_means"), F.min("_v").alias("best_latency"), F.max("_v").alias("worst_latency"),
        F.countDistinct(test_type).alias("n_test_types"), (F.count(F.lit(1)) / 3).cast("long").alias("total_tests"),
    )
    return summary


# Tried thresholds and weights of precision and recall.
THRESHOLDS = tuple(round(0.30 + 0.05 * i, 2) for i in range(10))
DEFAULT_THRESHOLD = 0.5


def threshold_sweep(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Metrics at every threshold, from one pass with two counters per threshold."""
    truth, p = F.col(y) == 1, F.col(score)
    counts = df.groupBy(*keys).agg(
        F.count_if(truth).alias("_pos"),
        *[F.count_if(truth & (p >= t)).alias(f"_tp{i}") for i, t in enumerate(THRESHOLDS)],
        *[F.count_if(~truth & (p >= t)).alias(f"_fp{i}") for i, t in enumerate(THRESHOLDS)],
    )
    rows = [
        F.struct(
            F.lit(t).alias("threshold"),
            _safe(F.col(f"_tp{i}"), F.col(f"_tp{i}") + F.col(f"_fp{i}")).alias("precision"),
            _safe(F.col(f"_tp{i}"), F.col("_pos")).alias("recall"),
        )
        for i, t in enumerate(THRESHOLDS)
    ]
    swept = counts.select(*keys, F.inline(F.array(*rows)))
    both = (F.col("precision") > 0) & (F.col("recall") > 0)
    return swept.withColumn(
        "sweep_score", F.when(both, F.col("precision") * 0.7 + F.col("recall") * 0.3).otherwise(F.lit(0.0))
    )


def best_threshold(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Lowest threshold with the highest score; 0.5 when no threshold scores above zero."""
    best = threshold_sweep(df, keys, y, score).groupBy(*keys).agg(
        F.max(F.struct("sweep_score", (-F.col("threshold")).alias("_t"))).alias("_b")
    )
    found = F.col("_b.sweep_score") > 0
    return best.select(
        *keys,
        F.when(found, -F.col("_b._t")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.col("_b.sweep_score").alias("sweep_score"),
    )


def production_score(precision: Column, recall: Column, accuracy: Column, rows_per_second: Column) -> Column:
    speed = F.least(F.coalesce(rows_per_second, F.lit(0.0)) / 10_000, F.lit(1.0))
    return precision * 0.4 + recall * 0.3 + accuracy * 0.2 + speed * 0.1


# Weight of each kind of model in the choice.
MODEL_WEIGHTS = {"random_forest": 0.7, "logistic_regression": 1.0, "isolation_forest": 0.8}


def weighted_accuracy(model: Column, accuracy: Column, weights: dict[str, float] = MODEL_WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    return accuracy * F.coalesce(table[model], F.lit(1.0))


def best_by(df: DataFrame, keys: Sequence[str], metric: str, tie: str) -> DataFrame:
    """Row with the highest metric per key; of equals the one with the smallest tie value.

    Only metrics above zero count.
    """
    order = F.struct(F.col(metric).alias("_m"))
    top = df.filter(F.col(metric) > 0).groupBy(*keys).agg(F.max(order).alias("_top"))
    held = null_safe_join(df, top, list(keys)) if keys else df.withColumn("_top", top.select("_top").scalar())
    first = F.min(F.struct(F.col(tie), *[c for c in df.columns if c not in (*keys, tie)]))
    return (
        held.filter(F.col(metric) == F.col("_top._m")).groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*")
    )


def improvements(df: DataFrame, model: str = "model", version: str = "version", metric: str = "f1_score") -> DataFrame:
    """Change in percent from the first to the last version (by name), for models with several.

    NULL when the first value is zero.
    """
    return (
        df.groupBy(model)
        .agg(
            F.count(F.lit(1)).alias("n_versions"),
            F.min_by(metric, version).alias("first_value"),
            F.max_by(metric, version).alias("last_value"),
        )
        .filter("n_versions > 1")
        .withColumn("improvement_pct", F.try_divide(F.col("last_value") - F.col("first_value"), F.col("first_value")) * 100)
    )


def comparison_table(parts: dict[str, DataFrame], version: str = "version") -> DataFrame:
    """Metric rows of several versions under one another; metrics a version lacks are NULL."""
    tagged = [t.withColumn(version, F.lit(name)) for name, t in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# Limits of the quality gates.
def quality_gates(metrics: DataFrame) -> DataFrame:
    """Verdict on accuracy, on the gap between test and cross-validated F1, and on confidence."""
    accuracy = F.col("accuracy")
    grade = (
        F.when(accuracy >= 1.0, "overfit_suspect")
        .when(accuracy >= 0.99, "good")
        .when(accuracy >= 0.90, "acceptable")
        .otherwise("low")
    )
    gap = F.abs(F.col("f1_score") - F.col("cv_f1_mean")) > 0.05
    return metrics.withColumns(
        {
            "grade": grade,
            "cv_gap": F.coalesce(gap, F.lit(False)).cast("int"),
            "overconfident": F.coalesce(F.col("high_confidence_ratio") > 0.95, F.lit(False)).cast("int"),
        }
    )


def quality_summary(graded: DataFrame) -> DataFrame:
    """Number of models, of good and of suspect ones, success rate and overall verdict."""
    counts = graded.agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count_if((F.col("accuracy") >= 0.90) & (F.col("accuracy") < 1.0)).alias("n_good"),
        F.count_if(F.col("accuracy") >= 1.0).alias("n_overfit"),
    )
    verdict = (
        F.when(F.col("n_overfit") == 0, "excellent")
        .when(F.col("n_overfit") <= F.col("n_models") * 0.2, "good")
        .otherwise("attention")
    )
    return counts.select(
        "*", _safe(F.col("n_good"), F.col("n_models")).alias("success_rate"), verdict.alias("verdict")
    )
