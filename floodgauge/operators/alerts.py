"""Alert rules of the kind "a rate over a range stays above a limit for some time"."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``kind`` is ``rate`` (per second), ``ratio`` (of two counts), ``below`` or ``above`` (a gauge)."""

    name: str
    metric: str
    kind: str
    limit: float
    range_seconds: int
    hold_seconds: int
    severity: str
    denominator: str | None = None


# The rules with their limits, ranges and hold times.
RULES = (
    Rule("HighThreatDetectionRate", "threats_detected_total", "rate", 10, 300, 120, "warning"),
    Rule("MLProcessorDown", "up:ml-processor", "below", 1, 60, 60, "critical"),
    Rule("BGPControllerDown", "up:bgp-controller", "below", 1, 60, 60, "critical"),
    Rule("HighFalsePositiveRate", "false_positives_total", "ratio", 0.1, 600, 300, "warning",
         "threats_detected_total"),
    Rule("BGPAnnouncementsFailed", "bgp_announcements_failed_total", "rate", 0, 300, 60, "critical"),
    Rule("KafkaConsumerLag", "kafka_consumer_lag_max", "above", 1000, 60, 120, "warning"),
)

STEP_SECONDS = 60


def _steps(samples: DataFrame, metric: str, range_seconds: int, step: int, value: str) -> DataFrame:
    """Sum of the samples of the last ``range_seconds`` at every step.

    Samples are summed per step before they are copied into the ranges they belong to.
    """
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (step * 1_000_000)).cast("long")
    sums = (
        samples.filter(F.col("metric") == metric)
        .groupBy("instance", bucket.alias("_b"))
        .agg(F.sum("value").alias("_v"))
    )
    spread = sums.select(
        "instance", "_v", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + range_seconds // step)).alias("step")
    )
    return spread.groupBy("instance", "step").agg(F.sum("_v").alias(value))


def evaluate(samples: DataFrame, rule: Rule, step: int = STEP_SECONDS) -> DataFrame:
    """Value of the rule per instance and step, for the steps at which it is above the limit.

    ``samples`` has ``metric``, ``instance``, ``ts`` and ``value`` (an increment of a counter, or
    the reading of a gauge).
    """
    if rule.kind == "rate":
        series = _steps(samples, rule.metric, rule.range_seconds, step, "_v")
        breach = series.select("instance", "step", (F.col("_v") / rule.range_seconds).alias("value")).filter(
            F.col("value") > rule.limit
        )
    elif rule.kind == "ratio":
        top = _steps(samples, rule.metric, rule.range_seconds, step, "_v")
        bottom = _steps(samples, rule.denominator, rule.range_seconds, step, "_d")
        breach = (
            top.join(bottom, ["instance", "step"])
            .filter(F.col("_d") > 0)
            .select("instance", "step", (F.col("_v") / F.col("_d")).alias("value"))
            .filter(F.col("value") > rule.limit)
        )
    else:
        bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (step * 1_000_000)).cast("long")
        # The reading of a step is the last one before it.
        series = (
            samples.filter(F.col("metric") == rule.metric)
            .groupBy("instance", (bucket + 1).alias("step"))
            .agg(F.max_by("value", "ts").alias("value"))
        )
        bad = F.col("value") < rule.limit if rule.kind == "below" else F.col("value") > rule.limit
        breach = series.filter(bad)
    return breach.select(F.lit(rule.name).alias("alertname"), F.lit(rule.severity).alias("severity"),
                         "instance", "step", "value")


def firing(samples: DataFrame, rule: Rule, step: int = STEP_SECONDS) -> DataFrame:
    """One row per stretch of breaching steps that lasts at least the hold time.

    Times are epoch seconds: first breach, moment of firing, last breaching step. The series holds
    one row per instance and step, so its windows are bounded by the time span.
    """
    breach = evaluate(samples, rule, step)
    in_order = W.partitionBy("alertname", "instance").orderBy("step")
    stretches = (
        breach.withColumn("_island", F.col("step") - F.row_number().over(in_order))
        .groupBy("alertname", "severity", "instance", "_island")
        .agg(F.min("step").alias("_from"), F.max("step").alias("_to"), F.max("value").alias("peak_value"))
    )
    held = (F.col("_to") - F.col("_from")) * step
    return stretches.filter(held >= rule.hold_seconds).select(
        "alertname", "severity", "instance",
        (F.col("_from") * step).alias("pending_since"),
        (F.col("_from") * step + rule.hold_seconds).alias("firing_since"),
        (F.col("_to") * step).alias("last_seen"),
        "peak_value",
    )


def inhibit(
    alerts: DataFrame, equal: Sequence[str] = ("alertname", "instance"), source: str = "critical",
    target: str = "warning",
) -> DataFrame:
    """Drops ``target`` alerts for which a ``source`` alert with the same labels fires."""
    loud = alerts.filter(F.col("severity") == source).select(*equal).distinct()
    muted = alerts.filter(F.col("severity") == target).join(loud, list(equal), "left_anti")
    return muted.select(*alerts.columns).unionByName(alerts.filter(F.col("severity") != target))


def group_alerts(alerts: DataFrame, by: Sequence[str] = ("alertname",)) -> DataFrame:
    """One notification per group: number of alerts, instances and worst severity."""
    rank: Column = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = F.max(F.struct(rank.alias("r"), F.col("severity").alias("s")))
    return alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_alerts"), F.countDistinct("instance").alias("n_instances"),
        worst["s"].alias("worst_severity"), F.min("firing_since").alias("first_firing"),
    )
