"""Queries on streams whose rows arrive out of order, over several micro-batches."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.functions.expressions import epoch_micros
from floodgauge.ml import registry, training
from floodgauge.ml.isolation_forest import fit_isolation_forest
from floodgauge.operators import mitigation
from floodgauge.operators.features import FLOW_FEATURES, flow_features
from floodgauge.plans.live_queries import _FOLD, _IDS, _LATENCY
from floodgauge.plans.registry import query, tidy
from floodgauge.plans.storage_queries import WAIT_SECONDS, _streamed
from floodgauge.plans.views import flows, ids_lines, pick, table, threats, with_views
from floodgauge.session import checkpointed, scratch_path
from floodgauge.sources import ids_log
from floodgauge.sources.log_tail import tail_lines
from floodgauge.streaming.detection import LiveDetection
from floodgauge.streaming.latency import stream_latencies
from floodgauge.streaming.reputation import FIELDS, ReputationBatches, stream_reputation
from floodgauge.streaming.routes import stream_withdrawals

#: Micro-batches, and seconds by which rows are late at most.
BATCHES, LATE_SECONDS = 5, 7200
END = "(end)"
#: Pieces a log is made of, and looks at it while it grows to one of them.
PIECES, LOOKS = 4, 2


#: Rows of a micro-batch that one task writes, and reads again.
FILE_ROWS = 500_000


def delivered(spark: SparkSession, placed: DataFrame, part: str, parts: int, target: str, file_rows: int = FILE_ROWS) -> int:
    """Writes the rows of each part, in the order of the parts, in the same number of files; gives that number, which makes each part a micro-batch."""
    rows = placed.drop(part)
    sizes = [r["count"] for r in placed.filter(F.col(part).between(0, parts - 1)).groupBy(part).count().collect()]
    files = max(1, -(-max(sizes, default=0) // file_rows))
    # One after the other: files are read in the order of their times.
    for k in range(parts):
        chosen = placed.filter(F.col(part) == k).drop(part)
        (chosen.coalesce(1) if files == 1 else chosen.repartition(files)).write.mode("append").parquet(target)
        # A task without rows writes no file.
        for _ in range(len(spark.read.schema(rows.schema).parquet(target).inputFiles()), (k + 1) * files):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(target)
    return files


def disordered(spark: SparkSession, rows: DataFrame, ts: str, key: str, batches: int = BATCHES, late_seconds: int = LATE_SECONDS, closing: dict | None = None) -> DataFrame:
    """A stream of the rows in so many micro-batches; each row comes up to ``late_seconds`` after its time, so neighbours overlap and nothing is in order.

    Last comes a row far in the future with the values of ``closing``, which lets the watermark pass all others.
    """
    target = scratch_path(spark, "disordered")
    moment = epoch_micros(F.col(ts))
    first, last = rows.agg(F.min(moment), F.max(moment)).first()
    step = ((last or 0) - (first or 0)) // batches + 1
    delay = F.pmod(F.xxhash64(F.col(key), moment), F.lit(late_seconds * 1_000_000))
    placed = rows.withColumn("_part", F.greatest(F.lit(0), F.floor((moment + delay - F.lit(first or 0)) / step)).cast("int"))
    files = delivered(spark, placed, "_part", batches + 1, target)
    if closing is not None:
        end = [F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != ts]
        far = F.timestamp_micros(F.lit((last or 0) + 1_000_000_000_000)).cast(rows.schema[ts].dataType).alias(ts)
        spark.range(1).select(*end, far).select(rows.columns).coalesce(1).write.mode("append").parquet(target)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(target)


@query("stream_reputation", with_views(("threats",), """
SELECT flow_id, ip, round(reputation_score, 6) AS reputation_score, validations FROM history""", _FOLD, recursive=True))
def stream_reputation_query(spark, folder):
    """Reputation after every threat, from threats that arrive out of order."""
    source = disordered(spark, threats(spark, folder).select(*FIELDS), "ts", "flow_id", closing={"ip": END})
    found = _streamed(spark, stream_reputation(source, LATE_SECONDS), "reputation")
    return tidy(found.filter(F.col("ip") != END).select("flow_id", "ip", "reputation_score", "validations"))


@query("reputation_batches", with_views(("threats",), """
SELECT flow_id, ip, round(reputation_score, 6) AS reputation_score, validations FROM history""", _FOLD, recursive=True))
def reputation_batches(spark, folder):
    """The same through the batch operator, micro-batch by micro-batch, with the state table left by the one before."""
    rows = threats(spark, folder).select(*FIELDS)
    target = scratch_path(spark, "reputation-batches")
    batches, last = ReputationBatches(target, late_seconds=LATE_SECONDS), []

    def each(batch, batch_id):
        batches(batch, batch_id)
        last.append(batch_id)

    running = disordered(spark, rows, "ts", "flow_id").writeStream.foreachBatch(each).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    if not running.awaitTermination(WAIT_SECONDS):
        running.stop()
        raise TimeoutError("the stream did not end")
    batches.finish(spark, last[-1] if last else -1, rows.schema)
    return tidy(spark.read.parquet(f"{target}/history").select("flow_id", "ip", "reputation_score", "validations"))


_OWN_TTL = """
routes AS (
  SELECT concat('198.51.100.', user_id % 20) AS ip, ts, flow_id,
    CASE k % 3 WHEN 0 THEN 600 WHEN 1 THEN 3600 ELSE 1800 END AS ttl, CASE k % 2 WHEN 0 THEN 'blackhole' ELSE 'flowspec' END AS route_type
  FROM flows),
lives AS (SELECT *, lead(ts) OVER (PARTITION BY ip ORDER BY ts, flow_id) AS next_ts FROM routes)"""


def own_ttl_routes(spark, folder) -> DataFrame:
    """Announcements of twenty addresses whose time to live changes from one to the next."""
    f = flows(spark, folder)
    ttl = F.element_at(F.array(F.lit(600), F.lit(3600), F.lit(1800)), F.col("k") % 3 + 1)
    return f.select(
        F.concat(F.lit("198.51.100."), F.col("user_id") % 20).alias("ip"), F.col("ts").cast("timestamp").alias("timestamp"), "flow_id", ttl.alias("ttl"),
        pick(F.col("k"), "blackhole", "flowspec").alias("route_type"),
    )


@query("stream_withdrawals_own_ttl", with_views(("flows",), """
SELECT ip, route_type, epoch_us(ts) + CAST(ttl AS BIGINT) * 1000000 AS timestamp,
  concat(CASE WHEN route_type = 'blackhole' THEN 'withdraw route ' ELSE 'withdraw flow route ' END, ip, '/32') AS command
FROM lives WHERE next_ts IS NULL OR epoch_us(next_ts) > epoch_us(ts) + CAST(ttl AS BIGINT) * 1000000""", _OWN_TTL))
def stream_withdrawals_own_ttl(spark, folder):
    """Withdrawals by each route's own time to live, also where a later announcement shortens it, from announcements out of order."""
    source = disordered(spark, own_ttl_routes(spark, folder), "timestamp", "flow_id", closing={"ip": END, "ttl": 0, "route_type": END})
    found = _streamed(spark, stream_withdrawals(source, LATE_SECONDS, tie=("flow_id",)), "withdrawals")
    return tidy(found.filter(F.col("ip") != END).select("ip", "route_type", "timestamp", "command"))


@query("withdrawals_own_ttl", with_views(("flows",), """
SELECT ip, route_type, epoch_us(ts) + CAST(ttl AS BIGINT) * 1000000 AS timestamp,
  concat(CASE WHEN route_type = 'blackhole' THEN 'withdraw route ' ELSE 'withdraw flow route ' END, ip, '/32') AS command
FROM lives WHERE next_ts IS NULL OR epoch_us(next_ts) > epoch_us(ts) + CAST(ttl AS BIGINT) * 1000000""", _OWN_TTL))
def withdrawals_own_ttl(spark, folder):
    """The batch form over the same announcements."""
    found = mitigation.withdrawals(own_ttl_routes(spark, folder), tie=("flow_id",))
    return tidy(found.select("ip", "route_type", "timestamp", "command"))


@query("stream_latencies", with_views((), """
SELECT flow_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, round(latency, 6) AS latency
FROM latencies""", _LATENCY))
def stream_latencies_query(spark, folder):
    """Latencies of flows that are started and completed again and again, from two streams out of order."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("flow_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    sides = (e.filter(F.col("event_type").isin("view", "click")), e.filter("event_type = 'purchase'"))
    starts, ends = (disordered(spark, side.select("flow_id", "ts", "event_id"), "ts", "event_id", closing={"flow_id": -1}) for side in sides)
    month = 31 * 86_400
    return tidy(_streamed(spark, stream_latencies(starts, ends, late_seconds=2 * LATE_SECONDS + _slack(sides), wait_seconds=month), "latencies"))


_FOLLOWED = """
SELECT kind AS event_type, count(*) AS n, CAST(sum(src_port) AS BIGINT) AS src_ports, CAST(sum(CASE WHEN kind = 'flow' THEN bytes END) AS BIGINT) AS bytes FROM ids GROUP BY 1
UNION ALL SELECT '(bad)', count(*), NULL, NULL FROM events WHERE event_id % 97 <> 0 AND event_id % 89 = 0"""


@query("followed_log", with_views(("flows",), _FOLLOWED, _IDS))
def followed_log(spark, folder):
    """Events and unreadable lines of a log that grows, is rotated and truncated between looks, each line exactly once."""
    target, pieces = scratch_path(spark, "log"), scratch_path(spark, "log-pieces")
    ids_lines(spark, folder).select("value").repartition(PIECES).write.text(pieces)
    system, at = fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)
    out, mark = f"{target}-out", f"{target}-mark"
    source = sorted(f.path for f in system.get_file_info(fs.FileSelector(_inner(pieces))) if f.base_name.startswith("part-"))
    system.create_dir(at)

    def look():
        stream = tail_lines(spark, target)
        running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        if not running.awaitTermination(WAIT_SECONDS):
            running.stop()
            raise TimeoutError("the log was not read")

    log = f"{at}/eve.json"
    for k, piece in enumerate(source):
        with system.open_input_file(piece) as stream:
            size = stream.size()
            for part in range(LOOKS):  # cut anywhere, also inside lines
                _append(system, log, stream, (part + 1) * size // LOOKS, new=part == 0)
                look()
        if k % 2 == 0:  # renamed; every other file is truncated and written anew
            system.move(log, f"{log}.{k}")
    lines = spark.read.schema("file string, position bigint, value string").parquet(out)
    parsed = ids_log.parse_lines(lines)
    good = ids_log.valid_events(parsed).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("src_port").alias("src_ports"), F.sum(F.when(F.col("event_type") == "flow", F.col("flow.bytes_toserver"))).alias("bytes"))
    bad = ids_log.quarantine(parsed).agg(F.lit("(bad)").alias("event_type"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("src_ports"), F.lit(None).cast("long").alias("bytes"))
    return tidy(good.unionByName(bad))


def _inner(path: str) -> str:
    return fs.FileSystem.from_uri(path)[1] if "://" in path or path.startswith("file:") else path


def _append(system, log: str, stream, stop: int, new: bool) -> None:
    """Bytes of the stream up to ``stop``, block by block, as a writer of logs would leave them."""
    with (system.open_output_stream if new else system.open_append_stream)(log) as out:
        while stream.tell() < stop:
            out.write(stream.read(min(1 << 20, stop - stream.tell())))


def _slack(sides) -> int:
    """Seconds by which the parts of two inputs lie apart: each is cut by its own first and last row."""
    moment = epoch_micros(F.col("ts"))
    edges = [side.agg(F.min(moment), F.max(moment)).first() for side in sides]
    known = [e for e in edges if e[0] is not None]
    return 0 if len(known) < 2 else (abs(known[0][0] - known[1][0]) + abs(known[0][1] - known[1][1])) // 1_000_000 + 1


#: Detectors in the order they are saved: level, version, and the kinds of events they were taught. One comes before each micro-batch.
_TAUGHT = (("simple", 1, ("error",)), ("simple", 2, ("signup",)), ("optimized", 1, ("error", "signup")))


@query("live_detection_versions", with_views(("flows",), """
SELECT flow_id, src_ip AS ip, level AS model_level, CAST(version AS BIGINT) AS model_version, 'known_ddos' AS attack_type
FROM flows JOIN (VALUES (0, 'simple', 1, 'error'), (1, 'simple', 2, 'signup'), (2, 'optimized', 1, 'error'), (2, 'optimized', 1, 'signup')) t(part, level, version, kind)
  ON flow_id % 3 = part AND event_type = kind"""))
def live_detection_versions(spark, folder):
    """Flows in three micro-batches; before each comes a newer or better detector of supervised models, scalers and forest, taught other kinds of events."""
    rows = flows(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    logs = rows.drop("event_type", "user_id", "value", "k")
    target, source = scratch_path(spark, "detection"), scratch_path(spark, "detection-input")
    files = delivered(spark, logs.withColumn("_part", F.col("flow_id") % len(_TAUGHT)), "_part", len(_TAUGHT), source)
    known = checkpointed(flow_features(rows.withColumn("_kind", F.col("event_type")), keep=("flow_id", "_kind")))
    forest = fit_isolation_forest(known, FLOW_FEATURES, key=["flow_id"])
    found = LiveDetection(f"{target}/models", target)

    def each(batch, batch_id):
        level, version, kinds = _TAUGHT[batch_id]
        taught = known.withColumn("y", F.col("_kind").isin(*kinds).cast("int"))
        # The protocol tells the kinds apart, so trees with leaves of any size learn them without error.
        models = [training.decision_tree("y", depth=depth, leaf=1) for depth in (8, 10)]
        packages = [registry.ModelPackage(training.assembled(FLOW_FEATURES, m, taught).fit(taught), list(FLOW_FEATURES)) for m in models]
        registry.save_detector(spark, registry.Detector(packages, forest, level, version), f"{target}/models")
        found(batch, batch_id)

    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", files).parquet(source)
    running = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    if not running.awaitTermination(WAIT_SECONDS):
        running.stop()
        raise TimeoutError("the stream did not end")
    threats_found = spark.read.parquet(f"{target}/threats").filter("detection_method = 'supervised'")
    return tidy(threats_found.select("flow_id", "ip", "model_level", "model_version", "attack_type"))
