"""Windowed aggregates and rates on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.operators.windows import THROUGHPUT_SECONDS, WATERMARK_SECONDS, WINDOW_SECONDS, window_features, window_features_by_value


def event_time(df: DataFrame, ts: str = "ts", late_seconds: int = WATERMARK_SECONDS) -> DataFrame:
    """Event time as a zoned timestamp with a watermark; later rows are dropped and counted by Spark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{late_seconds} seconds")


def stream_window_features(
    flows: DataFrame, ts: str = "ts", window_seconds: int = WINDOW_SECONDS,
    late_seconds: int = WATERMARK_SECONDS, distinct: str = "approx",
) -> DataFrame:
    """Window features in append mode: a window is emitted once the watermark has passed its end.

    Distinct counts use sketches, so the state of a window stays small. ``distinct='exact'`` keeps an entry per window and
    value, spread over all state partitions; ``distinct='set'`` keeps all values of a window in one entry.
    """
    if distinct == "exact":
        return window_features_by_value(event_time(flows, ts, late_seconds), ts, window_seconds)
    return window_features(event_time(flows, ts, late_seconds), ts, window_seconds, distinct)


def stream_throughput(
    events: DataFrame, ts: str, kind: str, seconds: int = THROUGHPUT_SECONDS, slide: int = 10,
    late_seconds: int = WATERMARK_SECONDS,
) -> DataFrame:
    """Events per second and type in sliding windows."""
    w = F.window(ts, f"{seconds} seconds", f"{slide} seconds")
    counted = event_time(events, ts, late_seconds).groupBy(w.alias("w"), F.col(kind).alias("event_type")).agg(
        F.count(F.lit(1)).alias("n_events")
    )
    return counted.select(
        "event_type", F.col("w.start").alias("window_start"), "n_events", (F.col("n_events") / seconds).alias("per_second")
    )


def stream_hourly_counters(threats: DataFrame, false_positive, ts: str = "ts", late_seconds: int = 3600) -> DataFrame:
    """Threats and false positives per hour."""
    counted = event_time(threats, ts, late_seconds).groupBy(F.window(ts, "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("threats"), F.count_if(false_positive).alias("false_positives")
    )
    return counted.select(F.col("w.start").alias("hour_start"), "threats", "false_positives")
