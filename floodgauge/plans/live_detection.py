"""From traffic logs to route updates; every hop is a table-to-table step usable on its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.ml.isolation_forest import IsolationForest
from floodgauge.ml.registry import ModelPackage
from floodgauge.operators.detection import ANOMALY_THRESHOLD, ATTACK_THRESHOLD, detect
from floodgauge.operators.features import FLOW_FEATURES, flow_features
from floodgauge.operators.mitigation import announcements, route_updates, withdrawals
from floodgauge.operators.ordered import chunk_for
from floodgauge.operators.reputation import malicious_messages, reputation_history


def score_flows(
    logs: DataFrame, supervised: Sequence[ModelPackage], forest: IsolationForest, key: str, ip: str, ts: str
) -> DataFrame:
    """Attack probability of every supervised model and the decision value of the forest."""
    # The feature names repeat log columns, so identity travels under names of its own.
    named = logs.withColumns({"_key": F.col(key), "_ip": F.col(ip), "_ts": F.col(ts)})
    scored = flow_features(named, keep=("_key", "_ip", "_ts"))
    for i, package in enumerate(supervised):
        scored = package.score(scored).withColumnRenamed("score", f"p{i}").drop("predicted")
    scored = forest.score(scored).drop("predicted")
    return scored.select(
        F.col("_key").alias(key), F.col("_ip").alias(ip), F.col("_ts").alias(ts),
        *[f"p{i}" for i in range(len(supervised))], "decision",
    )


def detect_flows(
    logs: DataFrame, supervised: Sequence[ModelPackage], forest: IsolationForest, key: str = "flow_id",
    ip: str = "src_ip", ts: str = "ts", attack_threshold: float = ATTACK_THRESHOLD,
    anomaly_threshold: float = ANOMALY_THRESHOLD, weights: Sequence[float] | None = None,
) -> DataFrame:
    scored = score_flows(logs, supervised, forest, key, ip, ts)
    names = [f"p{i}" for i in range(len(supervised))]
    return detect(scored, names, "decision", ip, ts, attack_threshold, anomaly_threshold, weights, keep=(key,))


def plan_mitigation(threats: DataFrame, tie: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Route updates (announce and withdraw) that follow from a table of threats."""
    chunk = chunk_for(threats, "ts")
    blocked = malicious_messages(reputation_history(threats, tie, chunk_seconds=chunk))
    announced = announcements(blocked, keep=tuple(tie))
    return route_updates(announced, withdrawals(announced, tie=tie, chunk_seconds=chunk))


__all__ = ["FLOW_FEATURES", "detect_flows", "plan_mitigation", "score_flows"]
