"""JSON messages on a log broker; the same functions serve any batch or streaming table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Topic names of the three hops.
TOPIC_TRAFFIC = "traffic-logs"
TOPIC_MALICIOUS = "malicious-ips"
TOPIC_ROUTES = "bgp-updates"


# Microseconds survive the trip.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def encode(df: DataFrame, key: str | None = None) -> DataFrame:
    """``key`` and ``value`` columns, the value being the whole row as JSON."""
    value = F.to_json(F.struct(*df.columns), {"timestampFormat": TIME_FORMAT}).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


_CORRUPT = "_corrupt"


def _parsed(df: DataFrame, schema: T.StructType, value: str) -> DataFrame:
    wide = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "timestampFormat": TIME_FORMAT}
    text = F.col(value).cast("string")
    return df.select(text.alias("_text"), F.from_json(text, wide, options).alias("_m"))


def decode(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Typed rows of the JSON messages; ``unreadable`` has the others."""
    return _parsed(df, schema, value).filter(F.col(f"_m.{_CORRUPT}").isNull() & F.col("_m").isNotNull()).select("_m.*").drop(_CORRUPT)


def unreadable(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """``value``: the messages that ``decode`` leaves out, for a side table. No message is in both, none in neither."""
    return _parsed(df, schema, value).filter(F.col(f"_m.{_CORRUPT}").isNotNull() | F.col("_m").isNull()).select(F.col("_text").alias("value"))


def read_topic(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, streaming: bool = True,
    starting: str = "earliest",
) -> DataFrame:
    """Needs the broker connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    raw = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )
    return decode(raw, schema)


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    """Starts a compressed, keyed stream of JSON messages; returns the running query."""
    return (
        encode(df, key)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.compression.type", "gzip")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )
