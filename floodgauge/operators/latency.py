"""Time from the start of a flow to the update it led to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.functions.expressions import epoch_micros
from floodgauge.operators.ordered import CHUNK_SECONDS, with_neighbours


def flow_latencies(
    starts: DataFrame, completions: DataFrame, key: str = "flow_id", ts: str = "ts",
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """One row per completion that directly follows a start of the same flow.

    A start is used up by its first completion and replaced by a later start. Starts and
    completions are lined up per flow, so no pair is formed that is not part of the result, and a
    flow with very many events is cut into time chunks.
    """
    rows = starts.select(key, ts, F.lit(0).alias("_kind")).unionByName(
        completions.select(key, ts, F.lit(1).alias("_kind"))
    )
    linked = with_neighbours(rows, [key], [ts, "_kind"], [ts, "_kind"], chunk_seconds)
    hit = (F.col("_kind") == 1) & (F.col("previous._kind") == 0)
    seconds = (epoch_micros(F.col(ts)) - epoch_micros(F.col(f"previous.{ts}"))) / 1_000_000
    return linked.filter(hit).select(
        key, F.col(f"previous.{ts}").alias("start_ts"), F.col(ts).alias("end_ts"), seconds.alias("latency")
    )
