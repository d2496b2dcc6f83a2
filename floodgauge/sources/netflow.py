"""NetFlow v5 datagrams held in a binary column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.functions.expressions import at_least, dotted_quad
from floodgauge.sources.ids_log import conform

# Wire sizes, and name -> (byte offset, length) of the fields of one record.
VERSION = 5
HEADER_BYTES = 24
RECORD_BYTES = 48
RECORD_FIELDS = {
    "src_addr": (0, 4),
    "dst_addr": (4, 4),
    "next_hop_addr": (8, 4),
    "input_snmp": (12, 2),
    "output_snmp": (14, 2),
    "packets": (16, 4),
    "bytes": (20, 4),
    "first_switched": (24, 4),
    "last_switched": (28, 4),
    "src_port": (32, 2),
    "dst_port": (34, 2),
    "tcp_flags": (37, 1),
    "protocol": (38, 1),
    "tos": (39, 1),
    "src_as": (40, 2),
    "dst_as": (42, 2),
    "src_mask": (44, 1),
    "dst_mask": (45, 1),
}


def _unsigned(hex_text: Column, offset: int, length: int) -> Column:
    """Big-endian unsigned integer at a byte offset of a hex string."""
    return F.conv(F.substring(hex_text, 2 * offset + 1, 2 * length), 16, 10).cast("long")


def decode_datagrams(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per complete record of every version 5 datagram.

    Datagrams shorter than the header or of another version yield nothing; a record cut off at
    the end of the datagram is left out, however many the header announces.
    """
    size = F.length(payload)
    header = F.hex(F.substring(payload, 1, HEADER_BYTES))
    fitting = F.floor((size - HEADER_BYTES) / RECORD_BYTES).cast("long")
    kept = (
        df.filter(size >= HEADER_BYTES)
        .withColumn("_header", header)
        .filter(_unsigned(F.col("_header"), 0, 2) == VERSION)
        .withColumn("unix_secs", _unsigned(F.col("_header"), 8, 4))
        .withColumn("_records", F.least(_unsigned(F.col("_header"), 2, 2), fitting))
        .filter(F.col("_records") > 0)
    )
    rows = kept.withColumn("record_index", F.explode(F.sequence(F.lit(0), F.col("_records").cast("int") - 1)))
    start = F.lit(HEADER_BYTES + 1) + F.col("record_index") * RECORD_BYTES
    rows = rows.withColumn("_record", F.hex(F.substring(F.col(payload), start, F.lit(RECORD_BYTES))))
    fields = [_unsigned(F.col("_record"), o, n).alias(name) for name, (o, n) in RECORD_FIELDS.items()]
    others = [c for c in df.columns if c != payload]
    return rows.select(*others, "unix_secs", "record_index", *fields)


def normalize_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Common traffic-log rows; a flow lasts at least one second."""
    elapsed = (F.col("last_switched") - F.col("first_switched")) / 1000
    raw = F.to_json(F.struct("unix_secs", *RECORD_FIELDS))
    columns = {
        "timestamp": F.timestamp_seconds("unix_secs"),
        "source": F.lit("netflow"),
        "event_type": F.lit("flow"),
        "src_ip": dotted_quad(F.col("src_addr")),
        "dst_ip": dotted_quad(F.col("dst_addr")),
        "next_hop": dotted_quad(F.col("next_hop_addr")),
        "duration": at_least(elapsed, 1.0),
        "raw_data": raw,
    }
    for name in ("src_port", "dst_port", "protocol", "packets", "bytes", "tcp_flags", "src_as", "dst_as"):
        columns[name] = F.col(name)
    return conform(records, columns, keep)
