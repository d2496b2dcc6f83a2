"""Time from the start of a flow to the update it led to, on streams."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.streaming.event_order import Columns, in_event_order, micros
from floodgauge.streaming.windows import WATERMARK_SECONDS, event_time

DAY = 86_400


class OpenStart:
    """The start of a flow that waits for its completion."""

    def __init__(self, wait_seconds: int):
        self.wait = wait_seconds * 1_000_000

    def step(self, key: tuple, kept: Any, rows: Columns):
        out, start = [], kept
        for moment, kind in zip(micros(rows["ts"]).tolist(), rows["kind"].tolist()):
            if kind == 0:
                start = moment
            elif start is not None:
                if moment - start <= self.wait:
                    out.append((key[0], start, moment))
                start = None  # used up, or too old
        return start, dict(zip(("flow", "start", "end"), map(list, zip(*out)))) if out else None

    def due(self, kept: Any) -> int:
        return kept + self.wait

    def expire(self, key: tuple, kept: Any, now: int):
        return None, None


def stream_latencies(
    starts: DataFrame, completions: DataFrame, key: str = "flow_id", ts: str = "ts", late_seconds: int = WATERMARK_SECONDS, wait_seconds: int = DAY,
) -> DataFrame:
    """One row per completion that directly follows a start of the same flow, as ``flow_latencies`` gives.

    Both inputs meet in one state per flow. A start is used up by its first completion and replaced by a later start; of the same instant the start comes first. A start that
    finds no completion within ``wait_seconds`` is forgotten. Rows without flow or time are left out.
    """
    kind = starts.schema[key].dataType.simpleString()
    rows = starts.select(F.col(key).alias("flow"), F.col(ts).alias("ts"), F.lit(0).alias("kind")).unionByName(
        completions.select(F.col(key).alias("flow"), F.col(ts).alias("ts"), F.lit(1).alias("kind")))
    timed = event_time(rows.filter("flow IS NOT NULL AND ts IS NOT NULL"), "ts", late_seconds)
    found = in_event_order(timed, ["flow"], "ts", ["kind"], OpenStart(wait_seconds), f"flow {kind}, start long, end long")
    seconds = (F.col("end") - F.col("start")) / 1_000_000
    return found.select(F.col("flow").alias(key), F.timestamp_micros("start").alias("start_ts"), F.timestamp_micros("end").alias("end_ts"), seconds.alias("latency"))
