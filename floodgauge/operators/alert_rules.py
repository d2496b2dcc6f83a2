"""All alert rules over one pass of the samples: the rules are a table, joined to sums per metric and step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.functions.expressions import epoch_micros
from floodgauge.operators.alerts import RULES, STEP_SECONDS, Rule
from floodgauge.operators.ordered import CHUNK_SECONDS, with_neighbours

#: Kinds of rules that look at increases over a range; the others look at the last reading.
COUNTED = ("rate", "ratio")


def increases(samples: DataFrame, labels: Sequence[str] = ("instance",), tie: Sequence[str] = (), chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Adds ``increase``: what a counter grew by since its sample before.

    A counter that reads less than before was reset and has grown from zero to its reading. The first sample of a series tells nothing. Series are cut
    into pieces of time, so one with very many samples is spread over many tasks.
    """
    linked = with_neighbours(samples, ["metric", *labels], ["ts", *tie], ["value"], chunk_seconds)
    before = F.col("previous.value")
    grown = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return linked.withColumn("increase", grown.cast("double")).drop("previous", "following")


def step_sums(samples: DataFrame, labels: Sequence[str] = ("instance",), tie: Sequence[str] = (), step: int = STEP_SECONDS) -> DataFrame:
    """``metric, labels, bucket, increase, last``: one row per series and step."""
    bucket = F.floor(epoch_micros(F.col("ts")) / F.lit(step * 1_000_000)).cast("long")
    return samples.groupBy("metric", *labels, bucket.alias("bucket")).agg(
        F.sum("increase").alias("increase"), F.max_by("value", F.struct("ts", *tie)).alias("last"))


def rule_table(spark, rules: Sequence[Rule], step: int = STEP_SECONDS) -> DataFrame:
    """One row for each metric that a rule reads: ``top`` tells the numerator, ``steps`` how many steps a reading counts in."""
    rows = []
    for r in rules:
        steps = r.range_seconds // step if r.kind in COUNTED else 1
        rows += [(r.name, r.severity, r.kind, float(r.limit), r.range_seconds, r.hold_seconds, m, top, max(1, steps)) for m, top in ((r.metric, True), (r.denominator, False)) if m]
    return spark.createDataFrame(rows, "alertname string, severity string, kind string, limit double, range_seconds int, hold_seconds int, metric string, top boolean, steps int")


def breaches(samples: DataFrame, rules: Sequence[Rule] = RULES, labels: Sequence[str] = ("instance",), tie: Sequence[str] = (), step: int = STEP_SECONDS) -> DataFrame:
    """``alertname, severity, hold_seconds, labels, step, value`` of every step at which a rule's value is beyond its limit.

    ``samples``: ``metric``, labels, ``ts``, ``value`` and ``increase``. At a step the ranges and readings up to it count.
    """
    # As many rows as the rules have metrics, whatever the samples hold.
    table = F.broadcast(rule_table(samples.sparkSession, rules, step))
    wanted = samples.filter(F.col("metric").isin(*{m for r in rules for m in (r.metric, r.denominator) if m}))
    read = step_sums(wanted, labels, tie, step).join(table, "metric")
    placed = read.withColumn("step", F.explode(F.sequence(F.col("bucket") + 1, F.col("bucket") + F.col("steps"))))
    values = placed.groupBy("alertname", "severity", "kind", "limit", "range_seconds", "hold_seconds", *labels, "step").agg(
        F.sum(F.when(F.col("top"), F.col("increase"))).alias("upper"), F.sum(F.when(~F.col("top"), F.col("increase"))).alias("lower"), F.max("last").alias("last"))
    kind = F.col("kind")
    value = F.when(kind == "rate", F.col("upper") / F.col("range_seconds")).when(kind == "ratio", F.when(F.col("lower") > 0, F.col("upper") / F.col("lower"))).otherwise(F.col("last"))
    beyond = F.when(kind == "below", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    return values.withColumn("value", value).filter(beyond).select("alertname", "severity", "hold_seconds", *labels, "step", "value")


def fired(samples: DataFrame, rules: Sequence[Rule] = RULES, labels: Sequence[str] = ("instance",), tie: Sequence[str] = (), step: int = STEP_SECONDS) -> DataFrame:
    """One row per stretch of breaching steps that lasts at least its rule's hold time, in epoch seconds, as ``alerts.firing`` gives for one rule."""
    in_order = W.partitionBy("alertname", *labels).orderBy("step")
    stretches = (
        breaches(samples, rules, labels, tie, step).withColumn("_island", F.col("step") - F.row_number().over(in_order))
        .groupBy("alertname", "severity", "hold_seconds", *labels, "_island")
        .agg(F.min("step").alias("_from"), F.max("step").alias("_to"), F.max("value").alias("peak_value"))
    )
    return stretches.filter((F.col("_to") - F.col("_from")) * step >= F.col("hold_seconds")).select(
        "alertname", "severity", *labels, (F.col("_from") * step).alias("pending_since"), (F.col("_from") * step + F.col("hold_seconds")).alias("firing_since"),
        (F.col("_to") * step).alias("last_seen"), "peak_value")
