"""Reputation of source addresses with a time to live that grows with the score.

Every threat adds ``0.3 * score`` (up to 1) and one validation to its address. The entry lives for
``int(3600 * (1 + score))`` seconds after its last update; a threat that comes later starts anew.

Batch form. A gap below one hour never resets and a gap of two hours always does, so an address'
timeline falls into segments with gaps of an hour or more between them. Threats are first summed
per address and minute (or a shorter piece, where traffic is dense); the segments and the reset decisions are worked out on these sums, whose
number depends on the time span and not on the number of threats. The rows themselves are only
sorted inside a minute, so an address with a third of all threats is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.functions.expressions import epoch_micros
from floodgauge.operators.ordered import CHUNK_SECONDS, time_chunk

# Weight of a new score, base time to live, block limits.
SCORE_WEIGHT = 0.3
BASE_TTL_SECONDS = 3600
BLOCK_SCORE = 0.7
BLOCK_VALIDATIONS = 3
BLOCK_SCORE_ALONE = 0.9
# Running sums are rounded so that decisions do not depend on the order of additions.
DIGITS = 9


def ttl_seconds(score: Column) -> Column:
    return F.floor(F.lit(BASE_TTL_SECONDS) * (1 + score)).cast("int")


def folded_score(total: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.lit(SCORE_WEIGHT) * F.coalesce(total, F.lit(0.0))), DIGITS)


def should_block(score: Column, validations: Column) -> Column:
    """Both limits strict; an address without an entry is never blocked."""
    test = ((score > BLOCK_SCORE) & (validations >= BLOCK_VALIDATIONS)) | (score > BLOCK_SCORE_ALONE)
    return F.coalesce(test, F.lit(False))


def reputation_history(
    threats: DataFrame, tie: Sequence[str] = (), initial: DataFrame | None = None,
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Adds the state after each threat: ``reputation_score``, ``validations``, ``reputation_ttl``.

    ``threats`` has ``ip``, ``ts`` and ``score``; ``tie`` orders threats of the same instant.
    ``initial`` is a state table to start from (``ip``, ``score``, ``validations``, ``last_seen``).
    ``chunk_seconds`` is the length of the pieces a timeline is cut into, at most a minute (see
    ``ordered.chunk_for``). A missing score counts as 0. A threat without address or time cannot be
    placed: it comes back without a state and adds nothing to others.
    """
    if not 0 < chunk_seconds <= CHUNK_SECONDS:
        raise ValueError("chunks last at most a minute, so that no entry can expire inside one")
    micros = epoch_micros(F.col("ts"))
    placed = F.col("ip").isNotNull() & F.col("ts").isNotNull()
    unplaced = threats.filter(~placed).withColumns({
        "reputation_score": F.lit(None).cast("double"), "validations": F.lit(None).cast("long"), "reputation_ttl": F.lit(None).cast("int"),
    })
    threats = threats.filter(placed)
    cut = threats.withColumn("_chunk", time_chunk(F.col("ts"), chunk_seconds))
    sums = cut.groupBy("ip", "_chunk").agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"),
        F.sum(F.coalesce("score", F.lit(0.0))).alias("_s"), F.count(F.lit(1)).alias("_n"),
    ).withColumn("_kind", F.lit(1))
    if initial is not None:
        seen = epoch_micros(F.col("last_seen"))
        known = initial.select(
            "ip", time_chunk(F.col("last_seen"), chunk_seconds).alias("_chunk"), seen.alias("_first"), seen.alias("_last"),
            (F.col("score") / SCORE_WEIGHT).alias("_s"), F.col("validations").cast("long").alias("_n"),
            F.lit(0).alias("_kind"),
        )
        sums = sums.unionByName(known.join(threats.select("ip").distinct(), "ip", "left_semi"))

    timeline = W.partitionBy("ip").orderBy("_kind", "_chunk")
    gap = (F.col("_first") - F.lag("_last").over(timeline)) / 1_000_000
    chunks = sums.withColumn("_gap", gap).withColumn(
        "_segment", F.sum((F.coalesce(F.col("_gap"), F.lit(0.0)) >= BASE_TTL_SECONDS).cast("int")).over(timeline)
    )
    segments = chunks.groupBy("ip", "_segment").agg(
        F.min_by("_gap", F.struct("_kind", "_chunk")).alias("_gap"), F.sum("_s").alias("_s"), F.sum("_n").alias("_n")
    )
    by_segment = W.partitionBy("ip").orderBy("_segment")
    certain = F.coalesce(F.col("_gap"), F.lit(0.0)) >= 2 * BASE_TTL_SECONDS
    islands = segments.withColumn("_island", F.sum(certain.cast("int")).over(by_segment))
    carried = (
        islands.groupBy("ip", "_island")
        .agg(F.sort_array(F.collect_list(F.struct("_segment", "_gap", "_s", "_n"))).alias("_list"))
        .select("ip", F.explode(_carry_over(F.col("_list"))).alias("_c"))
        .select("ip", "_c.*")
    )
    earlier = W.partitionBy("ip", "_segment").orderBy("_kind", "_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = (
        chunks.join(carried, ["ip", "_segment"])
        .withColumn("_base_s", F.col("_carry_s") + F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)))
        .withColumn("_base_n", F.col("_carry_n") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter("_kind = 1")
        .select("ip", "_chunk", "_base_s", "_base_n")
    )
    inside = W.partitionBy("ip", "_chunk").orderBy("ts", *tie).rowsBetween(W.unboundedPreceding, 0)
    total = F.col("_base_s") + F.sum(F.coalesce("score", F.lit(0.0))).over(inside)
    return (
        cut.join(base, ["ip", "_chunk"])
        .withColumn("reputation_score", folded_score(total))
        .withColumn("validations", F.col("_base_n") + F.count(F.lit(1)).over(inside))
        .withColumn("reputation_ttl", ttl_seconds(F.col("reputation_score")))
        .select(*threats.columns, "reputation_score", "validations", "reputation_ttl")
        .unionByName(unplaced)
    )


def _carry_over(segments: Column) -> Column:
    """Sum and count each segment inherits: those before it, or zero after a reset.

    The list is bounded by the time span: its entries lie at least an hour apart.
    """
    start = F.struct(
        F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"),
        F.expr("CAST(array() AS array<struct<_segment: bigint, _carry_s: double, _carry_n: bigint>>)").alias("out"),
    )

    def step(acc: Column, seg: Column) -> Column:
        lifetime = ttl_seconds(folded_score(acc["s"]))
        reset = F.coalesce(seg["_gap"] >= lifetime, F.lit(False))
        s = F.when(reset, F.lit(0.0)).otherwise(acc["s"])
        n = F.when(reset, F.lit(0).cast("long")).otherwise(acc["n"])
        entry = F.struct(seg["_segment"].alias("_segment"), s.alias("_carry_s"), n.alias("_carry_n"))
        return F.struct(
            (s + seg["_s"]).alias("s"), (n + seg["_n"]).alias("n"), F.concat(acc["out"], F.array(entry)).alias("out")
        )

    return F.aggregate(segments, start, step, lambda acc: acc["out"])


def latest_state(history: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """State table after the last threat of every address."""
    fields = F.struct(
        "ts", *tie, "reputation_score", "validations", "attack_type", "detection_method"
    )
    last = history.groupBy("ip").agg(F.max(fields).alias("_l"))
    return last.select(
        "ip", F.col("_l.reputation_score").alias("score"), F.col("_l.validations").alias("validations"),
        F.col("_l.ts").alias("last_seen"), F.array("_l.attack_type").alias("attack_types"),
        F.array("_l.detection_method").alias("detection_methods"),
    )


def with_reputation(events: DataFrame, state: DataFrame, now: Column, key: str = "ip") -> DataFrame:
    """Left join of events with a state table; entries past their time to live do not count."""
    age = epoch_micros(now) - epoch_micros(F.col("last_seen"))
    alive = state.filter(age < ttl_seconds(F.col("score")).cast("long") * 1_000_000)
    known = alive.select(
        F.col("ip").alias(key), F.col("score").alias("reputation_score"), "validations"
    )
    return events.join(known, key, "left").withColumn(
        "should_block", should_block(F.col("reputation_score"), F.col("validations")).cast("int")
    )


def malicious_messages(history: DataFrame) -> DataFrame:
    """One message per threat after which its address is blocked."""
    blocked = history.filter(should_block(F.col("reputation_score"), F.col("validations")))
    extra = [c for c in ("flow_id",) if c in history.columns]
    return blocked.select(
        *extra, "ip", F.col("score").alias("threat_score"), "reputation_score", "attack_type", "confidence",
        "detection_method", F.col("ts").alias("timestamp"), "ttl", "validations",
    )
