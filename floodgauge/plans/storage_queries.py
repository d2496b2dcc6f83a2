"""Queries that write to the shared folder and read back: file scans, exports, state, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.operators import mitigation, reputation, sampling
from floodgauge.plans.live_queries import _FOLD
from floodgauge.plans.registry import query, tidy
from floodgauge.plans.views import FEATURES, FLOW_KEY, flows, labelled, table, threats, with_views
from floodgauge.session import scratch_path
from floodgauge.sources import export, tables
from floodgauge.sources.keyed_state import KeyedState
from floodgauge.streaming.routes import stream_withdrawals
from floodgauge.streaming.windows import stream_window_features

WAIT_SECONDS = 1800


def _csv_folder(spark, folder) -> str:
    """Line items as CSV below one folder, with two different headers and a feature dictionary."""
    target = scratch_path(spark, "csv")
    rows = table(spark, folder, "lineitem")
    rows.filter("l_linestatus = 'O'").select("l_orderkey", "l_quantity", "l_tax").write.option("header", "true").csv(f"{target}/a")
    rows.filter("l_linestatus = 'F'").select("l_quantity", "l_orderkey", "l_discount").write.option("header", "true").csv(f"{target}/b/c")
    return target


@query("csv_union_scan", """
SELECT l_linestatus AS part, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_quantity), 2) AS quantity,
  round(coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_tax END), 0), 2) AS tax,
  round(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_discount END), 0), 2) AS discount
FROM lineitem GROUP BY 1""")
def csv_union_scan(spark, folder):
    schema = table(spark, folder, "lineitem").schema
    rows = tables.scan_csv(spark, _csv_folder(spark, folder), schema)
    part = F.when(F.col("l_tax").isNotNull(), "O").otherwise("F")
    return tidy(rows.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_quantity").alias("quantity"),
        F.coalesce(F.sum("l_tax"), F.lit(0.0)).alias("tax"), F.coalesce(F.sum("l_discount"), F.lit(0.0)).alias("discount")), 2)


@query("largest_csv", """
SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, round(sum(c_acctbal), 2) AS balance FROM customer""")
def largest_csv(spark, folder):
    """Of the customers and the nations, each in a file of its own, the larger file."""
    target, customers = scratch_path(spark, "largest"), table(spark, folder, "customer")
    for name, rows in (("a", table(spark, folder, "nation")), ("b/c", customers)):
        rows.coalesce(1).write.option("header", "true").csv(f"{target}/{name}")
    found = tables.scan_csv(spark, target, customers.schema, which="largest")
    return tidy(found.agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.sum("c_acctbal").alias("balance")), 2)


@query("preferred_formats", """
SELECT 'parquet' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders
UNION ALL SELECT 'json', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer""")
def preferred_formats(spark, folder):
    """Folders that hold several formats, each with another table: Parquet comes before JSON, JSON before CSV."""
    orders, customers, nations = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    found = []
    for held in ({"csv": nations, "json": customers, "parquet": orders}, {"csv": nations, "json": customers}):
        target = scratch_path(spark, "formats")
        for kind, rows in held.items():
            rows.write.mode("append").option("header", "true").format(kind).save(target)
        rows, kind = tables.scan_preferred(spark, target)
        key = next(c for c in ("o_orderkey", "c_custkey", "n_nationkey") if c in rows.columns)
        found.append(rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")))
    return tidy(found[0].unionByName(found[1]))


@query("exported_split", with_views(("labelled",), """
SELECT split, count(*) AS n, CAST(sum(is_attack) AS BIGINT) AS attacks, round(sum(l_quantity), 2) AS quantity
FROM (SELECT *, CASE WHEN rk <= round_even(n_class * 0.2e0, 0) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', flow_key))) AS rk,
    count(*) OVER (PARTITION BY label) AS n_class FROM labelled) r) x GROUP BY 1"""))
def exported_split(spark, folder):
    target = scratch_path(spark, "export")
    split = sampling.stratified_split(labelled(spark, folder), "label", 0.2, key=(FLOW_KEY,))
    export.export_prepared(split, target, "labelled", FEATURES, "is_attack")
    return tidy(spark.read.parquet(f"{target}/data").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_attack").alias("attacks"), F.sum("l_quantity").alias("quantity")), 2)


@query("written_report", with_views(("labelled",), """
SELECT label, count(*) AS n, round(avg(l_quantity), 4) AS quantity FROM labelled GROUP BY 1"""))
def written_report(spark, folder):
    target = scratch_path(spark, "report")
    rows = labelled(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity"))
    export.write_report(rows, target)
    return tidy(spark.read.schema(rows.schema).json(target), 4)


@query("state_snapshot", with_views(("threats",), """
SELECT ip, round(reputation_score, 6) AS score, validations FROM (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts DESC, flow_id DESC) AS r FROM history) x
WHERE r = 1 AND epoch_us(ts) + floor(3600 * (1 + reputation_score)) * 1000000 > (SELECT max(epoch_us(ts)) FROM threats) - 3600000000
""", _FOLD, recursive=True))
def state_snapshot(spark, folder):
    target = scratch_path(spark, "state")
    rows = threats(spark, folder)
    state = reputation.latest_state(reputation.reputation_history(rows, ("flow_id",)), ("flow_id",))
    export.write_snapshot(state, target, 0, "ip", 4)
    # An hour before the last threat.
    now = rows.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).scalar()
    kept = export.valid_now(export.read_snapshot(spark, target), now, reputation.ttl_seconds(F.col("score")).cast("long"))
    return tidy(kept.select("ip", "score", "validations"))


#: Batches of five days, and the versions that are read back.
DAYS, READ_VERSIONS = 5, (1, 3, 5)


@query("keyed_state_versions", with_views(("flows",), f"""
SELECT version, src_ip, flow_id, bytes FROM (
  SELECT v.version, f.*, row_number() OVER (PARTITION BY v.version, src_ip ORDER BY batch DESC, ts DESC, flow_id DESC) AS r
  FROM (SELECT *, least(5, (day(ts) - 1) // {DAYS}) AS batch FROM flows) f JOIN (VALUES (1), (3), (5)) v(version) ON f.batch <= v.version) x
WHERE r = 1 AND event_type <> 'error'""".replace("SELECT version,", "SELECT CAST(version AS BIGINT) AS version,", 1)))
def keyed_state_versions(spark, folder):
    """The last flow of every source after three of six batches, read when all have been written; a source whose last flow is an error has no state."""
    rows = flows(spark, folder).withColumn("batch", F.least(F.lit(5), F.floor((F.dayofmonth("ts") - 1) / DAYS)))
    state = KeyedState(spark, scratch_path(spark, "keyed-state"), "src_ip string, flow_id long, bytes long", ["src_ip"])
    for version in range(READ_VERSIONS[-1] + 1):
        state.write(rows.filter(F.col("batch") == version), version, [F.col("ts"), F.col("flow_id")], removed=F.col("event_type") == "error")
    found = [state.read(v).select(F.lit(v).alias("version"), "*") for v in READ_VERSIONS]
    return tidy(found[0].unionByName(found[1]).unionByName(found[2]))


def _streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all available input into files and reads them."""
    target = scratch_path(spark, name)
    running = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{target}/out")
        .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    )
    if not running.awaitTermination(WAIT_SECONDS):
        running.stop()
        raise TimeoutError(f"stream {name} did not end")
    return spark.read.schema(stream.schema).parquet(f"{target}/out")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query("stream_windows_1h", with_views(("flows",), """
SELECT w AS window_key, count(*) AS total_flows, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(DISTINCT src_ip) AS unique_src_ips,
  count(*) FILTER (tcp_flags & 2 <> 0) AS syn_flag_count, round(stddev_pop(bytes), 4) AS bytes_std
FROM (SELECT *, epoch_us(ts) // 3600000000 AS w FROM flows) x
WHERE (w + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) FROM flows) - 10000000 GROUP BY 1"""))
def stream_windows_1h(spark, folder):
    source = flows(spark, folder, _event_stream(spark, folder))
    found = _streamed(spark, stream_window_features(source, window_seconds=3600, distinct="exact"), "windows")
    return tidy(found.select("window_key", "total_flows", "total_bytes", "unique_src_ips", "syn_flag_count", "bytes_std"), 4)


_EPISODES = """
direct AS (
  SELECT *, CASE WHEN score > 0.95e0 OR attack_type IN ('volumetric','amplification') THEN 'blackhole' ELSE 'flowspec' END
    AS route_type, lead(ts) OVER (PARTITION BY ip ORDER BY ts, flow_id) AS next_ts FROM threats)"""


@query("stream_withdrawals", with_views(("threats",), """
SELECT ip, route_type, epoch_us(ts) + ttl * 1000000 AS timestamp,
  concat(CASE WHEN route_type = 'blackhole' THEN 'withdraw route ' ELSE 'withdraw flow route ' END, ip, '/32') AS command
FROM direct WHERE (next_ts IS NULL OR epoch_us(next_ts) > epoch_us(ts) + ttl * 1000000)
  AND epoch_us(ts) + ttl * 1000000 <= (SELECT max(epoch_us(ts)) FROM threats) - 10000000""", _EPISODES))
def stream_withdrawals_query(spark, folder):
    source = threats(spark, folder, _event_stream(spark, folder))
    messages = source.select("ip", F.col("score").alias("threat_score"), "attack_type", F.col("ts").alias("timestamp"), "ttl")
    found = _streamed(spark, stream_withdrawals(mitigation.announcements(messages)), "withdrawals")
    return tidy(found.select("ip", "route_type", "timestamp", "command"))


