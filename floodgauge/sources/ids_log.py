"""IDS event log: one JSON document per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.functions.expressions import iso_time, or_empty, or_zero
from floodgauge.schemas import IDS_EVENT, TRAFFIC_LOG

# Event types that carry traffic.
TRAFFIC_EVENTS = ("alert", "flow", "netflow")

# Protocol names used by the IDS.
PROTOCOL_NUMBERS = {"TCP": 6, "UDP": 17, "ICMP": 1}


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.text(path)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed events; blank lines are dropped, unreadable ones keep their text in ``_corrupt``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    text = F.trim(F.col(column))
    kept = lines.filter(text != "").withColumn("raw_data", text)
    # As a generator the document is parsed once, however many filters and columns follow.
    document = F.inline(F.array(F.from_json("raw_data", IDS_EVENT, options)))
    return kept.select(*[c for c in lines.columns if c != column], "raw_data", document)


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Lines that could not be read, for a side table."""
    return parsed.filter(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("line"))


def keep_traffic(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(*TRAFFIC_EVENTS))


def protocol_number(name: Column) -> Column:
    expr = F.lit(0)
    for text, number in PROTOCOL_NUMBERS.items():
        expr = F.when(F.upper(name) == text, number).otherwise(expr)
    return expr


def normalize_events(events: DataFrame, default_time: Column | None = None) -> DataFrame:
    """Common traffic-log rows from IDS events.

    ``default_time`` stands in for a missing timestamp. Flow totals are the sums of both
    directions and the flow age is the duration.
    """
    kept = keep_traffic(events)
    is_alert, is_flow = F.col("event_type") == "alert", F.col("event_type") == "flow"
    of_alert = lambda c: F.when(is_alert, c)
    of_flow = lambda c: F.when(is_flow, c)
    to_server, to_client = or_zero(F.col("flow.bytes_toserver")), or_zero(F.col("flow.bytes_toclient"))
    pkts_server, pkts_client = or_zero(F.col("flow.pkts_toserver")), or_zero(F.col("flow.pkts_toclient"))
    moment = iso_time(F.col("timestamp"))
    columns = {
        "timestamp": moment if default_time is None else F.coalesce(moment, default_time),
        "source": F.lit("suricata"),
        "event_type": F.col("event_type"),
        "src_ip": or_empty(F.col("src_ip")),
        "dst_ip": or_empty(F.col("dest_ip")),
        "src_port": or_zero(F.col("src_port")),
        "dst_port": or_zero(F.col("dest_port")),
        "protocol": protocol_number(F.col("proto")),
        "packets": pkts_server + pkts_client,
        "bytes": to_server + to_client,
        "duration": or_zero(F.col("flow.age")),
        "tcp_flags": F.lit(0),
        "app_proto": or_empty(F.col("app_proto")),
        "alert_signature": of_alert(or_empty(F.col("alert.signature"))),
        "alert_category": of_alert(or_empty(F.col("alert.category"))),
        "alert_severity": of_alert(or_zero(F.col("alert.severity"))),
        "alert_signature_id": of_alert(or_zero(F.col("alert.signature_id"))),
        "bytes_toserver": of_flow(to_server),
        "bytes_toclient": of_flow(to_client),
        "pkts_toserver": of_flow(pkts_server),
        "pkts_toclient": of_flow(pkts_client),
        "flow_age": of_flow(or_zero(F.col("flow.age"))),
        "flow_state": of_flow(or_empty(F.col("flow.state"))),
        "raw_data": F.col("raw_data"),
    }
    return conform(kept, columns)


def conform(df: DataFrame, columns: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """The declared traffic-log columns in order; whatever a source lacks is NULL."""
    return df.select(
        *keep,
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TRAFFIC_LOG.fields
        ],
    )
