"""Detection decisions from model scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.functions.expressions import clamp

# Limits of the two detectors, life of a threat, weights of the documented ensemble.
ATTACK_THRESHOLD = 0.7
# A decision value of a forest lies near +-0.5, so this limit hardly ever fires; 0 is the natural one.
ANOMALY_THRESHOLD = -0.5
THREAT_TTL = 3600
ENSEMBLE_WEIGHTS = (0.7, 0.3)


def ensemble_score(probabilities: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Mean of the attack probabilities, or their weighted sum."""
    shares = weights or [1.0 / len(probabilities)] * len(probabilities)
    if weights is None:
        total = probabilities[0]
        for p in probabilities[1:]:
            total = total + p
        return total / len(probabilities)
    total = probabilities[0] * shares[0]
    for p, w in zip(probabilities[1:], shares[1:]):
        total = total + p * w
    return total


def anomaly_score(decision: Column, threshold: float = ANOMALY_THRESHOLD) -> Column:
    return clamp((F.lit(threshold) - decision) / 2, 0.0, 1.0)


def detect(
    df: DataFrame, probabilities: Sequence[str], decision: str, ip: str = "src_ip", ts: str = "ts",
    attack_threshold: float = ATTACK_THRESHOLD, anomaly_threshold: float = ANOMALY_THRESHOLD,
    weights: Sequence[float] | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Threat rows: known attacks first, else anomalies; rows with neither give nothing."""
    supervised = ensemble_score([F.col(p) for p in probabilities], weights)
    known, strange = F.col("_p") > attack_threshold, F.col(decision) < anomaly_threshold
    scored = df.withColumn("_p", supervised).withColumn("_a", anomaly_score(F.col(decision), anomaly_threshold))
    score = F.when(known, F.col("_p")).otherwise(F.col("_a"))
    return scored.filter(F.coalesce(known, F.lit(False)) | F.coalesce(strange, F.lit(False))).select(
        *keep,
        F.coalesce(F.col(ip), F.lit("")).alias("ip"),
        score.alias("score"),
        F.when(known, "known_ddos").otherwise("zero_day").alias("attack_type"),
        score.alias("confidence"),
        F.when(known, "supervised").otherwise("unsupervised").alias("detection_method"),
        F.col(ts).alias("ts"),
        F.lit(THREAT_TTL).alias("ttl"),
    )


def predict(probability: Column, threshold: float, hard_label: Column | None = None) -> Column:
    """1 when the probability reaches the threshold; without a probability the hard label."""
    chosen = (probability >= threshold).cast("int")
    return chosen if hard_label is None else F.coalesce(chosen, hard_label.cast("int"))
