"""Route withdrawals on streams."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.operators.mitigation import DEFAULT_TTL, withdraw_text
from floodgauge.streaming.event_order import Columns, in_event_order, micros
from floodgauge.streaming.windows import event_time


class Life:
    """The end of a route's life and its type; every announcement sets both anew, be it earlier or later than before."""

    columns = ("ip", "route_type", "micros")

    def _withdrawn(self, key: tuple, kept: Any) -> list[tuple]:
        return [(key[0], kept[1], kept[0])]

    def _columns(self, rows: list[tuple]) -> dict:
        return dict(zip(self.columns, map(list, zip(*rows))))

    def step(self, key: tuple, kept: Any, rows: Columns):
        out = []
        for moment, kind, ttl in zip(micros(rows["timestamp"]).tolist(), rows["route_type"].tolist(), rows["ttl"].tolist()):
            if kept is not None and moment > kept[0]:  # an announcement exactly at the end still counts
                out += self._withdrawn(key, kept)
            kept = (moment + int(ttl) * 1_000_000, kind)
        return kept, self._columns(out) if out else None

    def due(self, kept: Any) -> int:
        return kept[0]

    def expire(self, key: tuple, kept: Any, now: int):
        return None, self._columns(self._withdrawn(key, kept))


def stream_withdrawals(
    announced: DataFrame, late_seconds: int = 10, tie: Sequence[str] = ("route_type", "ttl"), per_type: bool = False, default_ttl: int = DEFAULT_TTL,
) -> DataFrame:
    """Withdraw record for every route that was not announced again within the time to live of its last announcement.

    Each route has a timer of its own; a later announcement moves it, also to an earlier time. Of announcements of the same instant the
    last in the order of ``tie`` decides, as in the batch form. With ``per_type`` each type of route of an address lives on its own. A missing time to live
    is the default one; announcements without address or time name no route and are left out.
    """
    columns = dict.fromkeys(["ip", "timestamp", "route_type", "ttl", *tie])
    rows = announced.withColumn("ttl", F.coalesce("ttl", F.lit(default_ttl))).select(*columns)
    rows = event_time(rows.filter("ip IS NOT NULL AND timestamp IS NOT NULL"), "timestamp", late_seconds)
    ended = in_event_order(rows, ["ip", "route_type"] if per_type else ["ip"], "timestamp", tie, Life(), "ip string, route_type string, micros long")
    return ended.select(
        F.lit("withdraw").alias("action"), "ip", "route_type", F.timestamp_micros("micros").alias("timestamp"),
        F.lit("ttl_expired").alias("reason"), withdraw_text(F.col("ip"), F.col("route_type")).alias("command"),
    )
