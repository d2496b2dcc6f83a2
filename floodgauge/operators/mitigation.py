"""Mitigation plan: strategy, rule text, route updates and withdrawals after the time to live."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.functions.expressions import add_seconds, epoch_micros
from floodgauge.operators.ordered import CHUNK_SECONDS, with_neighbours

# Strategy per attack type, score that forces a blackhole.
STRATEGIES = {
    "volumetric": "blackhole",
    "amplification": "blackhole",
    "application_layer": "flowspec",
    "protocol": "flowspec",
    "zero_day": "flowspec",
    "known_ddos": "flowspec",
}
DEFAULT_STRATEGY = "flowspec"
BLACKHOLE_SCORE = 0.95

# Rule actions with their communities.
COMMUNITIES = {
    "rate_limit_1mbps": "65000:1",
    "rate_limit_10mbps": "65000:10",
    "rate_limit_100mbps": "65000:100",
    "redirect_vrf": "65000:9999",
    "discard": "65000:666",
}
BLACKHOLE_COMMUNITY = "65000:666"
BLACKHOLE_NEXT_HOP = "192.0.2.1"
PREFIX_LENGTH = 32

# What a message without these fields means.
DEFAULT_ATTACK = "unknown"
DEFAULT_SCORE = 0.5
DEFAULT_TTL = 3600

SWEEP_SECONDS = 60


def strategy(attack_type: Column, score: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in STRATEGIES.items() for v in pair])
    return F.when(score > BLACKHOLE_SCORE, "blackhole").otherwise(
        F.coalesce(table[attack_type], F.lit(DEFAULT_STRATEGY))
    )


def rule_action(attack_type: Column, score: Column) -> Column:
    drop = attack_type.isin("volumetric", "amplification") | (score > 0.9)
    slow = (attack_type == "application_layer") | (score > 0.7)
    return F.when(drop, "discard").when(slow, "rate_limit_1mbps").otherwise("rate_limit_10mbps")


def rule_community(action: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in COMMUNITIES.items() for v in pair])[action]


def rule_text(ip: Column, action: Column) -> Column:
    template = (
        "flow route {\n    match {\n        source %s/32;\n    }\n    then {\n        %s;\n"
        "        community %s;\n    }\n}"
    )
    return F.format_string(template, ip, action, rule_community(action))


def blackhole_text(ip: Column) -> Column:
    template = f"announce route %s/32 next-hop {BLACKHOLE_NEXT_HOP} community [{BLACKHOLE_COMMUNITY}]"
    return F.format_string(template, ip)


def withdraw_text(ip: Column, route_type: Column) -> Column:
    kind = F.when(route_type == "blackhole", "withdraw route ").otherwise("withdraw flow route ")
    return F.concat(kind, ip, F.lit("/32"))


def announcements(malicious: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Announce record with its command for every malicious-address message."""
    attack = F.coalesce(F.col("attack_type"), F.lit(DEFAULT_ATTACK))
    score = F.coalesce(F.col("threat_score"), F.lit(DEFAULT_SCORE))
    filled = malicious.select(
        *keep, "ip", attack.alias("attack_type"), score.alias("threat_score"), "timestamp",
        F.coalesce(F.col("ttl"), F.lit(DEFAULT_TTL)).alias("ttl"),
    )
    planned = filled.withColumn("strategy", strategy(F.col("attack_type"), F.col("threat_score"))).withColumn(
        "action_taken", rule_action(F.col("attack_type"), F.col("threat_score"))
    )
    command = F.when(F.col("strategy") == "blackhole", blackhole_text(F.col("ip"))).otherwise(
        rule_text(F.col("ip"), F.col("action_taken"))
    )
    return planned.select(
        *keep, F.lit("announce").alias("action"), "ip", F.col("strategy").alias("route_type"), "strategy",
        "attack_type", "threat_score", "timestamp", "ttl", F.lit(None).cast("string").alias("reason"),
        command.alias("command"),
    )


def routes(announced: DataFrame) -> DataFrame:
    """Route records: prefix, next hop and community of each announcement."""
    return announced.select(
        "ip", F.lit(PREFIX_LENGTH).alias("prefix_length"), F.lit(BLACKHOLE_NEXT_HOP).alias("next_hop"),
        F.lit(BLACKHOLE_COMMUNITY).alias("community"), "action", "route_type", "timestamp", "ttl",
        "attack_type", "threat_score",
    )


def active_routes(announced: DataFrame, now: Column | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Last announcement per address; with ``now`` only those that have not expired."""
    rest = [c for c in announced.columns if c not in ("ip", "timestamp", *tie)]
    last = announced.groupBy("ip").agg(F.max(F.struct("timestamp", *tie, *rest)).alias("_l")).select("ip", "_l.*")
    last = last.select(*announced.columns)
    if now is None:
        return last
    return last.filter(epoch_micros(now) <= epoch_micros(F.col("timestamp")) + F.col("ttl").cast("long") * 1_000_000)


def withdrawals(
    announced: DataFrame, now: Column | None = None, tie: Sequence[str] = (), sweep_seconds: int | None = None,
    per_type: bool = False, chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Withdraw record for every route that was not announced again within its time to live.

    A new announcement exactly at the end still refreshes the route. The type withdrawn is that of
    the last announcement; with ``per_type`` each type of route of an address lives on its own.
    ``sweep_seconds`` moves the time to the first sweep after the expiry. ``now`` leaves out what
    has not expired yet.
    """
    keys = ["ip", "route_type"] if per_type else ["ip"]
    linked = with_neighbours(announced, keys, ["timestamp", *tie], ["timestamp"], chunk_seconds)
    expiry = epoch_micros(F.col("timestamp")) + F.col("ttl").cast("long") * 1_000_000
    following = epoch_micros(F.col("following.timestamp"))
    ended = linked.withColumn("_end", expiry).filter(following.isNull() | (following > F.col("_end")))
    if now is not None:
        ended = ended.filter(epoch_micros(now) > F.col("_end"))
    moment = F.col("_end")
    if sweep_seconds:
        step = sweep_seconds * 1_000_000
        moment = ((F.floor(moment / step) + 1) * step).cast("long")
    return ended.select(
        F.lit("withdraw").alias("action"), "ip", "route_type",
        F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("string").alias("attack_type"),
        F.lit(None).cast("double").alias("threat_score"), F.timestamp_micros(moment).alias("timestamp"),
        F.lit(None).cast("int").alias("ttl"), F.lit("ttl_expired").alias("reason"),
        withdraw_text(F.col("ip"), F.col("route_type")).alias("command"),
    )


def route_updates(announced: DataFrame, withdrawn: DataFrame) -> DataFrame:
    return announced.select(*withdrawn.columns).unionByName(withdrawn)


def remove_routes(active: DataFrame, removed: DataFrame) -> DataFrame:
    """Active routes without the addresses on the removal list."""
    return active.join(removed.select("ip").distinct(), "ip", "left_anti")


def expiry_time(timestamp: Column, ttl: Column) -> Column:
    return add_seconds(timestamp, ttl)
