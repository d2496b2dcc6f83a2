"""Time-window traffic aggregates and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.functions.expressions import (
    PROTO_ICMP,
    PROTO_TCP,
    PROTO_UDP,
    TCP_ACK,
    TCP_FIN,
    TCP_RST,
    TCP_SYN,
    has_bit,
    or_empty,
    or_zero,
)

# Window length, lateness (two windows) and ports that are counted on their own.
WINDOW_SECONDS = 5
WATERMARK_SECONDS = 10
NAMED_PORTS = (80, 443, 53)
HIGH_PORT = 1024


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def _sums() -> dict[str, Column]:
    """Aggregates of flows that add up over parts of a window."""
    size, packets = or_zero(F.col("bytes")), or_zero(F.col("packets"))
    flags, protocol = F.col("tcp_flags"), or_zero(F.col("protocol"))
    port = or_zero(F.col("dst_port"))
    return {
        "total_bytes": F.sum(size),
        "total_packets": F.sum(packets),
        "total_flows": F.count(F.lit(1)),
        "syn_flag_count": F.sum(has_bit(flags, TCP_SYN)),
        "ack_flag_count": F.sum(has_bit(flags, TCP_ACK)),
        "fin_flag_count": F.sum(has_bit(flags, TCP_FIN)),
        "rst_flag_count": F.sum(has_bit(flags, TCP_RST)),
        "tcp_flows": _count(protocol == PROTO_TCP),
        "udp_flows": _count(protocol == PROTO_UDP),
        "icmp_flows": _count(protocol == PROTO_ICMP),
        **{f"port_{p}_flows": _count(port == p) for p in NAMED_PORTS},
        "high_port_flows": _count((port > HIGH_PORT) & ~port.isin(*NAMED_PORTS)),
    }


def _measured() -> dict[str, Column]:
    """Values whose mean and deviation are wanted; NULL is left out."""
    duration = F.when(F.col("duration") > 0, F.col("duration").cast("double"))
    return {"bytes": or_zero(F.col("bytes")), "packets": or_zero(F.col("packets")), "duration": duration}


def _counted_values() -> dict[str, Column]:
    return {
        "unique_src_ips": or_empty(F.col("src_ip")),
        "unique_dst_ips": or_empty(F.col("dst_ip")),
        "unique_src_ports": or_zero(F.col("src_port")),
        "unique_dst_ports": or_zero(F.col("dst_port")),
    }


def _features(total: dict[str, Column], unique: dict[str, Column], mean, deviation, window_seconds: float) -> list[Column]:
    """The 27 features in their order, from sums, distinct counts, and means and deviations by name."""
    size, packets, n = total["total_bytes"], total["total_packets"], total["total_flows"]
    found = {
        "total_bytes": size,
        "total_packets": packets,
        "total_flows": n,
        "avg_bytes_per_flow": size / n,
        "avg_packets_per_flow": packets / n,
        "bytes_per_second": size / window_seconds,
        "packets_per_second": packets / window_seconds,
        "flows_per_second": n / window_seconds,
        **unique,
        **{name: c for name, c in total.items() if name not in ("total_bytes", "total_packets", "total_flows")},
        "bytes_std": deviation("bytes"),
        "packets_std": deviation("packets"),
        "duration_mean": F.coalesce(mean("duration"), F.lit(0.0)),
        "duration_std": F.coalesce(deviation("duration"), F.lit(0.0)),
    }
    return [c.alias(name) for name, c in found.items()]


def traffic_aggregates(window_seconds: float, distinct: str = "exact") -> list[Column]:
    """The 27 aggregates of one window.

    ``distinct``: ``exact`` (two-step distinct aggregation), ``approx`` (sketch, constant memory)
    or ``set`` (exact; state grows with the number of values).
    """
    unique = {
        "exact": F.countDistinct,
        "approx": lambda c: F.approx_count_distinct(c, 0.02),
        "set": lambda c: F.size(F.collect_set(c)).cast("long"),
    }[distinct]
    measured = _measured()
    return _features(
        _sums(), {name: unique(c) for name, c in _counted_values().items()},
        lambda name: F.avg(measured[name]), lambda name: F.stddev_pop(measured[name]), window_seconds,
    )


def _parts() -> list[Column]:
    """Aggregates of a part of a window from which ``_merged`` makes those of the whole."""
    moments = [
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("squares")).alias(f"_{name}")
        for name, c in _measured().items()
    ]
    return [*[c.alias(name) for name, c in _sums().items()], *moments]


def _pooled(parts: Column) -> Column:
    """Count, mean and squared deviations of the union of parts, by pairwise updates, which do not cancel digits."""
    def add(a, x):
        n, away = a["n"] + x["n"], x["mean"] - a["mean"]
        return F.when(x["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + away * x["n"] / n).alias("mean"),
            (a["squares"] + x["squares"] + away * away * a["n"] * x["n"] / n).alias("squares"),
        ))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(parts, start, add)


def _merged(unique: dict[str, Column], window_seconds: float, part: Column | None = None) -> list[Column]:
    """The 27 features from the parts of a window; ``part`` tells which rows hold parts, if not all do."""
    def own(c: Column) -> Column:
        return c if part is None else F.when(part, c)

    pooled = {name: _pooled(F.collect_list(own(F.col(f"_{name}")))) for name in _measured()}
    mean = {name: F.when(c["n"] > 0, c["mean"]) for name, c in pooled.items()}
    deviation = {name: F.when(c["n"] > 0, F.sqrt(c["squares"] / c["n"])) for name, c in pooled.items()}
    return _features({name: F.sum(own(F.col(name))) for name in _sums()}, unique, mean.get, deviation.get, window_seconds)


def _keyed(out: DataFrame, window_seconds: int) -> DataFrame:
    """Key, bounds and flow count in front of the features of the window ``w``."""
    start = F.unix_micros(F.col("w.start").cast("timestamp"))
    key = F.floor(start / (window_seconds * 1_000_000)).cast("long")
    return out.select(
        key.alias("window_key"),
        F.col("w.start").alias("start_time"),
        F.col("w.end").alias("end_time"),
        F.col("total_flows").alias("flow_count"),
        *[c for c in out.columns if c != "w"],
    )


def window_features(
    flows: DataFrame, ts: str = "ts", window_seconds: int = WINDOW_SECONDS, distinct: str = "exact"
) -> DataFrame:
    """One row per epoch-aligned window with its key, bounds, flow count and 27 features."""
    if distinct == "exact":
        return window_features_by_value(flows, ts, window_seconds)
    grouped = flows.groupBy(F.window(ts, f"{window_seconds} seconds").alias("w"))
    return _keyed(grouped.agg(*traffic_aggregates(window_seconds, distinct)), window_seconds)


def _counted_aside(flows: DataFrame, ts: str, window_seconds: int) -> DataFrame:
    """Sums of windows joined with their distinct counts."""
    placed, values, measured = flows.withColumn("w", F.window(ts, f"{window_seconds} seconds")), _counted_values(), _measured()
    kinds = [F.struct(F.lit(i).alias("kind"), c.cast("string").alias("value")) for i, c in enumerate(values.values())]
    each = placed.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("_start"), F.inline(F.array(*kinds))).distinct()
    counts = each.groupBy("_start").agg(*[F.count_if(F.col("kind") == i).alias(name) for i, name in enumerate(values)])
    sums = placed.groupBy("w").agg(
        *[c.alias(name) for name, c in _sums().items()],
        *[F.avg(c).alias(f"_mean_{name}") for name, c in measured.items()], *[F.stddev_pop(c).alias(f"_deviation_{name}") for name, c in measured.items()],
    )
    whole = sums.withColumn("_start", F.unix_micros(F.col("w.start").cast("timestamp"))).join(counts, "_start")
    found = _features(
        {name: F.col(name) for name in _sums()}, {name: F.col(name) for name in values},
        lambda name: F.col(f"_mean_{name}"), lambda name: F.col(f"_deviation_{name}"), window_seconds,
    )
    return _keyed(whole.select("w", *found), window_seconds)


def window_features_by_value(flows: DataFrame, ts: str = "ts", window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``window_features`` with exact distinct counts by two aggregations, also on a stream with a watermark.

    The first has a row per window and distinct value, the second counts those rows. So the values of a busy window are spread over all tasks and state
    partitions, and none of them holds a set. Values that occur often are reduced before the shuffle. Off a stream the distinct rows carry nothing but
    their key, as a task may hold several for each flow, and the sums are made aside, a row per window.
    """
    if not flows.isStreaming:
        return _counted_aside(flows, ts, window_seconds)
    size = f"{window_seconds} seconds"
    values = _counted_values()
    kinds = [F.struct(F.lit(0).alias("kind"), F.lit("").alias("value"))]
    kinds += [F.struct(F.lit(i).alias("kind"), c.cast("string").alias("value")) for i, c in enumerate(values.values(), 1)]
    rows = flows.withColumn("w", F.window(ts, size)).withColumn("_v", F.explode(F.array(*kinds)))
    distinct = rows.groupBy("w", F.col("_v.kind").alias("_kind"), F.col("_v.value").alias("_value")).agg(*_parts())
    unique = {name: F.count_if(F.col("_kind") == i) for i, name in enumerate(values, 1)}
    whole = distinct.groupBy(F.window("w", size).alias("w")).agg(*_merged(unique, window_seconds, F.col("_kind") == 0))
    return _keyed(whole, window_seconds)


#: Registers of a sketch, as a power of two: a standard error of 0.8 %. Ports are held in bit maps of so many bits.
SKETCH_POWER = 14
MAP_BITS = 32_768


def step_summaries(flows: DataFrame, step_seconds: int, ts: str = "ts") -> DataFrame:
    """One row per step with everything from which the features of any window made of steps can be told.

    Addresses are in sketches, ports in bit maps, which are exact; what is no port (outside 0 to 65535) is in a sketch of its own. A row has at most 80 KB,
    however many flows the step has, so summaries can be kept in place of flows. Flows without time are left out.
    """
    values = _counted_values()
    # A sketch passes over empty strings, which are a value here.
    sketches = [F.hll_sketch_agg(F.concat(F.lit("="), values[f"unique_{side}_ips"]), SKETCH_POWER).alias(f"_{side}_ips") for side in ("src", "dst")]
    for side in ("src", "dst"):
        port = values[f"unique_{side}_ports"].cast("long")
        sketches += [
            F.bitmap_construct_agg(F.when(F.floor(port / MAP_BITS) == half, F.pmod(port, F.lit(MAP_BITS)))).alias(f"_{side}_ports_{half}") for half in (0, 1)
        ]
        sketches.append(F.hll_sketch_agg(F.when(~port.between(0, 2 * MAP_BITS - 1), port), SKETCH_POWER).alias(f"_{side}_ports_other"))
    step = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (step_seconds * 1_000_000)).cast("long")
    placed = flows.withColumn("_step", step).filter(F.col("_step").isNotNull())
    return placed.groupBy("_step").agg(*_parts(), *sketches)


def windows_from_steps(steps: DataFrame, step_seconds: int, window_seconds: int, slide_seconds: int | None = None) -> DataFrame:
    """Bounds and the 27 features of all windows of ``window_seconds`` that start at a multiple of ``slide_seconds`` (default: windows side by side) and hold a flow.

    Both lengths are multiples of the step. Only summaries are copied into several windows. Counts of addresses are estimates, the rest is exact.
    """
    slide_seconds = slide_seconds or window_seconds
    if window_seconds % step_seconds or slide_seconds % step_seconds or slide_seconds > window_seconds:
        raise ValueError("windows and slides are made of whole steps, and a slide is at most a window")
    length, slide = window_seconds // step_seconds, slide_seconds // step_seconds
    first = (F.floor((F.col("_step") - length) / slide) + 1) * slide
    last = F.floor(F.col("_step") / slide) * slide
    placed = steps.withColumn("_start", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(slide).cast("long"))))
    unique = {f"unique_{side}_ips": F.hll_sketch_estimate(F.hll_union_agg(F.col(f"_{side}_ips"))) for side in ("src", "dst")}
    for side in ("src", "dst"):
        halves = [F.bitmap_count(F.bitmap_or_agg(F.col(f"_{side}_ports_{half}"))) for half in (0, 1)]
        unique[f"unique_{side}_ports"] = halves[0] + halves[1] + F.hll_sketch_estimate(F.hll_union_agg(F.col(f"_{side}_ports_other")))
    found = placed.groupBy("_start").agg(*_merged(unique, window_seconds))
    start = F.col("_start") * step_seconds
    return found.select(
        F.timestamp_seconds(start).alias("start_time"), F.timestamp_seconds(start + window_seconds).alias("end_time"),
        *[c for c in found.columns if c != "_start"],
    )


def distinct_in_windows(rows: DataFrame, columns: list[str], step_seconds: int, window_seconds: int, ts: str = "ts") -> DataFrame:
    """Start and exact distinct counts of each column, for all windows of ``window_seconds`` that start at a multiple of the step and hold a value.

    A value of a step is counted in the windows that reach the step and no earlier step with the value. These follow one another, so nothing is copied into
    windows but counts. NULL is left out.
    """
    length = window_seconds // step_seconds
    step = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (step_seconds * 1_000_000)).cast("long")
    kinds = [F.struct(F.lit(i).alias("_kind"), F.col(c).cast("string").alias("_value")) for i, c in enumerate(columns)]
    each = rows.select(step.alias("_step"), F.inline(F.array(*kinds))).filter("_step IS NOT NULL AND _value IS NOT NULL").distinct()
    before = F.lag("_step").over(W.partitionBy("_kind", "_value").orderBy("_step"))
    counts = each.withColumn("_first", F.greatest(F.col("_step") - (length - 1), before + 1)).groupBy("_kind", "_first", "_step").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.withColumn("_start", F.explode(F.sequence("_first", "_step")))
    return placed.groupBy(F.timestamp_seconds(F.col("_start") * step_seconds).alias("start_time")).agg(
        *[F.coalesce(F.sum(F.when(F.col("_kind") == i, F.col("_n"))), F.lit(0)).alias(c) for i, c in enumerate(columns)])


def recent_windows(windows: DataFrame, count: int = 10) -> DataFrame:
    """The latest windows, newest first."""
    return windows.orderBy(F.col("window_key").desc()).limit(count)


def window_status(
    flows: DataFrame, ts: str = "ts", window_seconds: int = WINDOW_SECONDS,
    late_seconds: int = WATERMARK_SECONDS,
) -> DataFrame:
    """How many windows the watermark has closed and how many are still open: one row."""
    key = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (window_seconds * 1_000_000))
    windows = flows.groupBy(key.cast("long").alias("window_key")).agg(
        F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("latest")
    )
    watermark = windows.agg(F.max("latest") - F.lit(late_seconds * 1_000_000).cast("long")).scalar()
    closed = (F.col("window_key") + 1) * (window_seconds * 1_000_000) <= watermark
    return windows.agg(
        F.count_if(~closed).alias("active_windows"),
        F.count_if(closed).alias("completed_windows"),
        F.lit(window_seconds).alias("window_size_seconds"),
    )


# Fixed value: length of the throughput window.
THROUGHPUT_SECONDS = 60


def trailing_throughput(
    events: DataFrame, ts: str, kind: str, now: Column, seconds: int = THROUGHPUT_SECONDS
) -> DataFrame:
    """Events per second and type over the last ``seconds`` before ``now``, and in total.

    An event exactly ``seconds`` old is out.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    recent = events.filter((age >= 0) & (age < seconds * 1_000_000))
    return recent.rollup(kind).agg(F.count(F.lit(1)).alias("n_events"), F.grouping(kind).alias("_total")).select(
        F.when(F.col("_total") == 1, "total").otherwise(F.col(kind)).alias("event_type"),
        "n_events",
        (F.col("n_events") / seconds).alias("per_second"),
    )


def sliding_throughput(
    events: DataFrame, ts: str, kind: str, seconds: int = THROUGHPUT_SECONDS, slide: int = 10
) -> DataFrame:
    """Rate per type for every window of ``seconds`` that starts at a multiple of ``slide``.

    Rows are first counted per slide step, so only the counts are copied into several windows.
    """
    step = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slide * 1_000_000)).cast("long")
    counts = events.groupBy(F.col(kind).alias("event_type"), step.alias("_step")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    copies = seconds // slide
    spread = counts.select(
        "event_type", "_n", F.explode(F.sequence(F.col("_step") - (copies - 1), F.col("_step"))).alias("_start")
    )
    return spread.groupBy("event_type", (F.col("_start") * slide).alias("window_start")).agg(
        F.sum("_n").alias("n_events"), (F.sum("_n") / seconds).alias("per_second")
    )


def hourly_counters(events: DataFrame, ts: str, false_positive: Column) -> DataFrame:
    """Threats and false positives per hour."""
    hour = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 3_600_000_000).cast("long")
    return events.groupBy((hour * 3600).alias("hour_start")).agg(
        F.count(F.lit(1)).alias("threats"), _count(false_positive).alias("false_positives")
    )
