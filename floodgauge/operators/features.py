"""Feature columns for live flows, IDS events and labelled NetFlow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.functions.expressions import (
    EPSILON,
    PROTO_ICMP,
    PROTO_TCP,
    PROTO_UDP,
    TCP_ACK,
    TCP_FIN,
    TCP_RST,
    TCP_SYN,
    at_least,
    has_bit,
    or_zero,
    ratio,
    stable_code,
)
from floodgauge.operators.ordered import exact_percentiles

FLOW_FEATURES = (
    "bytes_per_second", "packets_per_second", "avg_packet_size", "protocol", "src_port", "dst_port",
    "tcp_flags", "syn_flag", "ack_flag", "fin_flag", "rst_flag", "flow_duration", "inter_arrival_time",
)
IDS_FEATURES = (
    "alert_severity", "alert_category", "flow_bytes_toclient", "flow_bytes_toserver",
    "flow_pkts_toclient", "flow_pkts_toserver", "proto", "app_proto",
)


def _present(df: DataFrame, name: str) -> Column:
    return or_zero(F.col(name)) if name in df.columns else F.lit(0)


def flow_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """13 features per flow. Durations and packet counts below one count as one."""
    seconds = at_least(F.coalesce(F.col("duration"), F.lit(1.0)).cast("double"), 1.0)
    packets = F.coalesce(F.col("packets"), F.lit(1))
    size = or_zero(F.col("bytes")).cast("double")
    flags = F.col("tcp_flags")
    columns = {
        "bytes_per_second": size / seconds,
        "packets_per_second": or_zero(F.col("packets")) / seconds,
        "avg_packet_size": size / F.greatest(packets, F.lit(1)),
        "protocol": _present(df, "protocol"),
        "src_port": _present(df, "src_port"),
        "dst_port": _present(df, "dst_port"),
        "tcp_flags": or_zero(flags),
        "syn_flag": has_bit(flags, TCP_SYN),
        "ack_flag": has_bit(flags, TCP_ACK),
        "fin_flag": has_bit(flags, TCP_FIN),
        "rst_flag": has_bit(flags, TCP_RST),
        "flow_duration": or_zero(F.col("duration")).cast("double"),
        "inter_arrival_time": _present(df, "inter_arrival_time").cast("double"),
    }
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def ids_features(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """8 features per IDS event; names are turned into stable codes."""
    flow = lambda field: or_zero(F.col(f"flow.{field}"))
    return events.select(
        *keep,
        or_zero(F.col("alert.severity")).alias("alert_severity"),
        stable_code(F.col("alert.category"), 1000).alias("alert_category"),
        flow("bytes_toclient").alias("flow_bytes_toclient"),
        flow("bytes_toserver").alias("flow_bytes_toserver"),
        flow("pkts_toclient").alias("flow_pkts_toclient"),
        flow("pkts_toserver").alias("flow_pkts_toserver"),
        stable_code(F.col("proto"), 100).alias("proto"),
        stable_code(F.col("app_proto"), 100).alias("app_proto"),
    )


def route_by_type(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alert rows, all other rows): the two kinds carry different feature sets."""
    is_alert = F.coalesce(F.col("event_type") == "alert", F.lit(False))
    return logs.filter(is_alert), logs.filter(~is_alert)


def temporal_features(df: DataFrame) -> DataFrame:
    """7 features. Day 0 is a Thursday, the first day of the epoch."""
    start = F.col("FLOW_START_MILLISECONDS")
    every = lambda ms, size: (F.floor(start / ms) % size).cast("int")
    packets = F.col("IN_PKTS") + F.col("OUT_PKTS")
    return df.withColumns(
        {
            "flow_start_hour": every(3_600_000, 24),
            "flow_start_day_of_week": every(86_400_000, 7),
            "duration_ratio": ratio(F.col("DURATION_OUT"), F.col("DURATION_IN")),
            "flow_efficiency": ratio(F.col("FLOW_DURATION_MILLISECONDS"), packets),
            "iat_variability": ratio(F.col("SRC_TO_DST_IAT_STDDEV"), F.col("SRC_TO_DST_IAT_AVG")),
            "iat_asymmetry": ratio(F.col("SRC_TO_DST_IAT_AVG"), F.col("DST_TO_SRC_IAT_AVG")),
            "burst_indicator": burst_test().cast("int"),
        }
    )


def traffic_features(df: DataFrame) -> DataFrame:
    """11 features of volume, throughput, packet sizes and retransmission."""
    col = F.col
    both = col("IN_BYTES") + col("OUT_BYTES")
    sized = (
        col("NUM_PKTS_UP_TO_128_BYTES")
        + col("NUM_PKTS_128_TO_256_BYTES")
        + col("NUM_PKTS_256_TO_512_BYTES")
        + col("NUM_PKTS_512_TO_1024_BYTES")
        + col("NUM_PKTS_1024_TO_1514_BYTES")
    )
    retransmitted = col("RETRANSMITTED_IN_BYTES") + col("RETRANSMITTED_OUT_BYTES")
    return df.withColumns(
        {
            "bytes_ratio": ratio(col("OUT_BYTES"), col("IN_BYTES")),
            "bytes_per_packet_in": ratio(col("IN_BYTES"), col("IN_PKTS")),
            "bytes_per_packet_out": ratio(col("OUT_BYTES"), col("OUT_PKTS")),
            "bytes_asymmetry": ratio(F.abs(col("IN_BYTES") - col("OUT_BYTES")), both),
            "throughput_ratio": ratio(col("DST_TO_SRC_AVG_THROUGHPUT"), col("SRC_TO_DST_AVG_THROUGHPUT")),
            "throughput_stability": ratio(col("SRC_TO_DST_AVG_THROUGHPUT"), col("SRC_TO_DST_SECOND_BYTES")),
            "small_packets_ratio": ratio(col("NUM_PKTS_UP_TO_128_BYTES"), sized),
            "large_packets_ratio": ratio(col("NUM_PKTS_1024_TO_1514_BYTES"), sized),
            "packet_size_diversity": ratio(col("MAX_IP_PKT_LEN") - col("MIN_IP_PKT_LEN"), col("MAX_IP_PKT_LEN")),
            "retrans_ratio": ratio(retransmitted, both),
            "retrans_efficiency": ratio(col("RETRANSMITTED_IN_PKTS"), col("RETRANSMITTED_IN_BYTES")),
        }
    )


def protocol_features(df: DataFrame) -> DataFrame:
    """7 features of TCP flags and window, protocol and application use."""
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    return df.withColumns(
        {
            "tcp_flag_diversity": F.coalesce(F.bit_count("TCP_FLAGS"), F.lit(0)),
            "tcp_window_efficiency": ratio(F.col("TCP_WIN_MAX_OUT"), F.col("TCP_WIN_MAX_IN")),
            "is_tcp": flag(F.col("PROTOCOL") == PROTO_TCP),
            "is_udp": flag(F.col("PROTOCOL") == PROTO_UDP),
            "is_icmp": flag(F.col("PROTOCOL") == PROTO_ICMP),
            "has_dns": flag(F.col("DNS_QUERY_ID") > 0),
            "has_ftp": flag(F.col("FTP_COMMAND_RET_CODE") > 0),
        }
    )


# Columns that get a z-score, and the outlier and throughput limits.
ZSCORE_COLUMNS = ("IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS")
OUTLIER_ZSCORE = 3
HIGH_THROUGHPUT_QUANTILE = 0.95


def anomaly_features(df: DataFrame) -> DataFrame:
    """13 features measured against the whole table.

    Means and deviations come from one aggregate row and the throughput limit from
    ``exact_percentiles``; both enter the row expressions as literals.
    """
    throughput = "SRC_TO_DST_AVG_THROUGHPUT"
    present = [c for c in ZSCORE_COLUMNS if c in df.columns]
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in present], *[F.stddev_samp(c).alias(f"s_{c}") for c in present]
    ).first()
    limit = exact_percentiles(df, {throughput: [HIGH_THROUGHPUT_QUANTILE]})[throughput][HIGH_THROUGHPUT_QUANTILE]
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    columns: dict[str, Column] = {}
    for c in present:
        z = F.abs((F.col(c) - F.lit(stats[f"m_{c}"])) / (F.lit(stats[f"s_{c}"]) + F.lit(EPSILON)))
        columns[f"{c}_zscore"] = z
        columns[f"{c}_is_outlier"] = flag(z > OUTLIER_ZSCORE)
    columns["suspicious_port"] = flag(low_port_test())
    columns["high_throughput"] = flag(F.col(throughput) > F.lit(limit))
    columns["unusual_packet_size"] = flag(unusual_size_test())
    return df.withColumns(columns)


# Fixed values of the three threshold tests.
def unusual_size_test() -> Column:
    return (F.col("MIN_IP_PKT_LEN") < 40) | (F.col("MAX_IP_PKT_LEN") > 1500)


def low_port_test() -> Column:
    return (F.col("L4_SRC_PORT") < 1024) | (F.col("L4_DST_PORT") < 1024)


def burst_test() -> Column:
    return (F.col("SRC_TO_DST_IAT_MIN") < 10) & (F.col("SRC_TO_DST_IAT_MAX") > 1000)
