import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgauge.operators import latency, mitigation, reputation, windows
from floodgauge.plans.stream_queries import delivered, disordered
from floodgauge.plans.views import flows, threats
from floodgauge.streaming.reputation import FIELDS, ReputationBatches, stream_reputation
from floodgauge.streaming.routes import stream_withdrawals
from floodgauge.streaming.latency import stream_latencies
from floodgauge.streaming.windows import (
    stream_hourly_counters,
    stream_throughput,
    stream_window_features,
)

LAST = "2030-01-01 00:00:00"


def as_stream(spark, df, order="ts", parts=4):
    """File stream that delivers the rows in time order, one file per micro-batch."""
    path = tempfile.mkdtemp(prefix="run-")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema)
        chunk.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode="append"):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", tempfile.mkdtemp(prefix="run-")).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(180)
    return stream.sparkSession.table(name)


def with_end(spark, df, ts="ts", **values):
    """A last row far in the future moves the watermark past everything else."""
    end = df.limit(1).withColumn(ts, F.lit(LAST).cast(df.schema[ts].dataType))
    for c, v in values.items():
        end = end.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
    return df.unionByName(end)


@pytest.mark.parametrize("distinct", ["set", "exact"])
def test_window_features_match_batch(spark, folder, distinct):
    rows = flows(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")).select(
        "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "duration", "tcp_flags")
    got = run(stream_window_features(as_stream(spark, with_end(spark, rows)), window_seconds=3600, distinct=distinct), f"w_{distinct}")
    want = windows.window_features(rows, window_seconds=3600)
    names = want.columns
    a = {tuple(r) for r in got.select(*names).filter("window_key < 500000").collect()}
    b = {tuple(r) for r in want.collect()}
    assert len(b) > 300
    rounded = lambda rs: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rs}
    assert rounded(a) == rounded(b)


def test_late_rows_are_dropped(spark):
    early = spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts, 'a' AS kind")
    late = spark.sql("SELECT timestamp'2024-01-01 00:00:02' AS ts, 'a' AS kind")
    path = tempfile.mkdtemp(prefix="run-")
    # Rows count as late from the second micro-batch after the watermark moved.
    end = spark.sql(f"SELECT timestamp'{LAST}' AS ts, 'end' AS kind")
    for part in (early, end, end, late):
        part.coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(early.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(stream_throughput(s, "ts", "kind", 60, 60), "t1").collect()
    assert [(r["event_type"], r["n_events"]) for r in got] == [("a", 1)]


def states(d):
    return sorted((r["flow_id"], None if r["reputation_score"] is None else round(r["reputation_score"], 8), r["validations"]) for r in d.collect())


@pytest.mark.parametrize("batches", [1, 6])
def test_reputation_stream_matches_batch(spark, folder, batches):
    rows = threats(spark, folder).select(*FIELDS)
    lost = rows.limit(2).withColumn("flow_id", F.col("flow_id") + 10**6).withColumn("ip", F.lit(None).cast("string"))
    rows = rows.unionByName(lost).withColumn("score", F.expr("CASE WHEN flow_id % 7 = 0 THEN NULL ELSE score END"))
    source = disordered(spark, rows, "ts", "flow_id", batches, 7200, {"ip": "end"})
    got = run(stream_reputation(source, 7200), f"r{batches}").filter("ip IS NULL OR ip <> 'end'")
    assert states(got) == states(reputation.reputation_history(rows, ("flow_id",)))


def test_rows_wait_until_the_watermark_has_passed_them(spark, folder):
    rows = threats(spark, folder).select(*FIELDS)
    got = run(stream_reputation(as_stream(spark, rows), 3600), "r_wait")
    last = rows.agg(F.max("ts")).first()[0]
    want = reputation.reputation_history(rows, ("flow_id",)).filter(F.col("ts") <= F.lit(last) - F.expr("INTERVAL 3600 SECONDS"))
    assert states(got) == states(want)


def batched(spark, rows, target, stream, late_seconds, fail_on=None):
    function, ids = ReputationBatches(target, late_seconds), []

    def each(batch, batch_id):
        if fail_on == batch_id and batch_id not in ids:  # everything but the last file is there, then the batch is run again
            ids.append(batch_id)
            function(batch, batch_id)
        function(batch, batch_id)
        ids.append(batch_id)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", tempfile.mkdtemp(prefix="run-")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    function.finish(spark, ids[-1], rows.schema)
    return spark.read.parquet(f"{target}/history")


def test_reputation_batches_match_batch(spark, folder):
    rows = threats(spark, folder).select(*FIELDS)
    got = batched(spark, rows, tempfile.mkdtemp(prefix="run-"), disordered(spark, rows, "ts", "flow_id", 3, 7200), 7200, fail_on=1)
    assert states(got) == states(reputation.reputation_history(rows, ("flow_id",)))


def test_reputation_batches_set_late_rows_aside(spark, folder):
    rows = threats(spark, folder).select(*FIELDS).orderBy("ts", "flow_id").limit(60)
    ordered = spark.createDataFrame(rows.collect(), rows.schema)
    target, path = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    late = ordered.limit(3)
    for part in (ordered.exceptAll(late), late):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = batched(spark, rows, target, stream, 0)
    assert states(got) == states(reputation.reputation_history(ordered.exceptAll(late), ("flow_id",)))
    assert sorted(r["flow_id"] for r in spark.read.parquet(f"{target}/late").collect()) == sorted(r["flow_id"] for r in late.collect())


def test_withdrawals_stream_matches_batch(spark, folder):
    rows = threats(spark, folder).select("flow_id", F.col("ip"), F.col("score").alias("threat_score"), "attack_type",
                                         F.col("ts").alias("timestamp"), "ttl")
    announced = mitigation.announcements(rows, keep=("flow_id",)).select("ip", "route_type", "timestamp", "ttl")
    ended = with_end(spark, announced, "timestamp", ip="end")
    got = run(stream_withdrawals(as_stream(spark, ended, "timestamp")), "wd1")
    want = mitigation.withdrawals(announced)
    pick = lambda d: sorted((r["ip"], r["route_type"], r["timestamp"], r["command"]) for r in d.collect())
    assert pick(got) == pick(want)
    assert got.count() > 100


def test_hourly_counters_stream(spark, folder):
    rows = threats(spark, folder)
    got = run(stream_hourly_counters(as_stream(spark, with_end(spark, rows)), F.col("score") < 0.25), "h1")
    want = windows.hourly_counters(rows, "ts", F.col("score") < 0.25)
    a = sorted((int(r["hour_start"].timestamp()), r["threats"], r["false_positives"]) for r in got.collect())
    assert a == sorted(tuple(r) for r in want.collect())


def seconds(spark, values, names, ts="ts"):
    """Rows whose first value is a number of seconds."""
    rows = spark.createDataFrame(values, f"s long, {names}")
    return rows.select((F.timestamp_seconds(F.col("s") + 1_700_000_000)).alias(ts), *[c for c in rows.columns if c != "s"])


def in_files(spark, parts):
    path = tempfile.mkdtemp(prefix="run-")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_withdrawals_follow_each_routes_own_life(spark):
    names = "ip string, ttl int, route_type string"
    announced = [
        (0, "a", 600, "flowspec"), (500, "a", 100, "blackhole"), (601, "a", 50, "flowspec"),  # shortened, then a new life
        (0, "b", 3600, "flowspec"), (3600, "b", 600, "flowspec"),  # exactly at the end
        (100, "c", 600, "flowspec"), (100, "c", 600, "blackhole"), (50, "c", None, "flowspec"),  # same instant; no time of its own
        (10, "d", 3600, "flowspec"), (20, "d", 5, "blackhole"), (22, "d", 3000, "flowspec"), (4000, "d", 60, "blackhole"),
        (9000, "e", 600, "flowspec"), (7, None, 60, "flowspec"),
    ]
    order = [3, 0, 9, 6, 12, 2, 5, 1, 13, 8, 7, 4, 11, 10]
    shuffled = [announced[i] for i in order]
    parts = [seconds(spark, shuffled[i : i + 4], names, "timestamp") for i in range(0, 14, 4)] + [seconds(spark, [(900_000, "end", 60, "x")], names, "timestamp")]
    got = run(stream_withdrawals(in_files(spark, parts), 20_000), "life")
    want = mitigation.withdrawals(seconds(spark, announced, names, "timestamp").fillna({"ttl": 3600}).filter("ip IS NOT NULL"), tie=("route_type", "ttl"))
    pick = lambda d: sorted((r["ip"], r["route_type"], r["timestamp"], r["command"]) for r in d.collect())
    assert pick(got) == pick(want) and len(pick(want)) == 7
    by_type = run(stream_withdrawals(in_files(spark, parts), 20_000, per_type=True), "life_by_type")
    assert pick(by_type) == pick(mitigation.withdrawals(seconds(spark, announced, names, "timestamp").fillna({"ttl": 3600}).filter("ip IS NOT NULL"), tie=("ttl",), per_type=True))


def test_timer_withdraws_without_further_announcements(spark):
    names = "ip string, ttl int, route_type string"
    parts = [seconds(spark, rows, names, "timestamp") for rows in ([(0, "a", 600, "flowspec")], [(300, "b", 5000, "flowspec")], [(1000, "b", 5000, "flowspec")], [(1001, "b", 5000, "flowspec")])]
    got = run(stream_withdrawals(in_files(spark, parts), 10), "timer").collect()
    assert [(r["ip"], int(r["timestamp"].timestamp()) - 1_700_000_000) for r in got] == [("a", 600)]


def test_latency_stream(spark):
    started = [(0, 1), (10, 2), (20, 3), (5, 1), (30, 1), (90_000, 9), (40, 7), (3, None)]
    ended = [(6, 1), (7, 1), (31, 1), (1000, 2), (21, 4), (90_001, 9), (40, 7), (41, 7)]
    far = [(900_000, -1)]
    sides = [in_files(spark, [seconds(spark, rows[::-1][:4], "flow_id long"), seconds(spark, rows[::-1][4:], "flow_id long"), seconds(spark, far, "flow_id long")]) for rows in (started, ended)]
    got = run(stream_latencies(*sides, late_seconds=100_000), "l1")
    want = latency.flow_latencies(seconds(spark, started[:-1], "flow_id long"), seconds(spark, ended, "flow_id long"))
    pick = lambda d: sorted((r["flow_id"], r["start_ts"], r["end_ts"], r["latency"]) for r in d.collect())
    assert pick(got) == pick(want) and [r[3] for r in pick(want)] == [1.0, 1.0, 990.0, 0.0, 1.0]


def test_starts_are_forgotten(spark):
    starts, ends = (in_files(spark, [seconds(spark, rows, "flow_id long"), seconds(spark, [(900_000, -1)], "flow_id long")]) for rows in ([(0, 1), (0, 2)], [(300, 1), (301, 2)]))
    assert [r["flow_id"] for r in run(stream_latencies(starts, ends, wait_seconds=300), "l2").collect()] == [1]


def test_keys_that_share_a_state_stay_apart(spark, monkeypatch):
    """Many keys, one call: no key takes another's rows, and the calls do not grow with the keys."""
    from floodgauge.streaming import event_order

    monkeypatch.setattr(event_order, "SLICE", 3)
    kept, seen = {}, []

    class Last:
        def step(self, key, kept, rows):
            seen.append(len(rows["n"]))
            return rows["n"][-1].item(), {"k": [key[0]] * len(rows["n"]), "before": [kept, *rows["n"][:-1].tolist()]}

        def due(self, kept):
            return None

    n = 40
    rows = {"k": np.array(["a", "b", None, "a"] * 10, object), "ts": np.datetime64("2024-01-01", "ns") + np.arange(n)[::-1] * np.timedelta64(1, "s"), "n": np.arange(n)}
    now = int(rows["ts"].max().astype("datetime64[us]").astype(int)) - 2_000_000  # two rows wait
    found = event_order._table(list(event_order._found(Last(), ["k"], "ts", ["n"], kept, rows, now)))
    assert max(seen) == 3 and len(found) == n - 2
    for k in ("a", "b", None):
        own = [i for i in range(n) if rows["k"][i] == k and (n - 1 - i) <= n - 3][::-1]
        part = found[found["k"].isna() if k is None else found["k"] == k]
        assert [None if b != b else int(b) for b in part["before"]] == [None, *own[:-1]] and kept[(k,)] == own[-1]


def test_each_part_is_as_many_files(spark):
    rows = spark.range(1000).withColumn("part", F.when(F.col("id") < 3, 1).otherwise(0))
    path = tempfile.mkdtemp(prefix="run-")
    files = delivered(spark, rows, "part", 3, path, file_rows=100)
    assert files == 10 and len(spark.read.parquet(path).inputFiles()) == 30
    sizes = []
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", files).parquet(path)
    q = stream.writeStream.foreachBatch(lambda b, i: sizes.append(b.count())).option("checkpointLocation", tempfile.mkdtemp(prefix="run-")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and sizes == [997, 3, 0]


def called(run, blocks, held, now_ms):
    """One call of a state's function, as Spark makes it: its output, and the state that it leaves."""
    from pyspark.sql.streaming.state import GroupState
    from pyspark.sql.types import BinaryType, StructField, StructType

    state = GroupState(
        optionalValue=(held,) if held else None, batchProcessingTimeMs=0, eventTimeWatermarkMs=now_ms, timeoutConf="EventTimeTimeout", hasTimedOut=False, watermarkPresent=True,
        defined=held is not None, updated=False, removed=False, timeoutTimestamp=-1, keyAsUnsafe=b"", valueSchema=StructType([StructField("held", BinaryType())]))
    out = list(run((0,), iter(blocks), state))
    return [r for o in out for r in o.itertuples(index=False)], state.get[0] if state.exists else None


def test_rows_wait_as_numbers_and_pass_by_ranges_of_time(monkeypatch):
    """Rows out of order, in three micro-batches: the same output as of all at once, from a state that holds repeated strings once and is compressed."""
    import pandas as pd

    from floodgauge.streaming import event_order

    class Numbered:
        def step(self, key, kept, rows):
            kept = (kept or 0) + len(rows["n"])
            return kept, {"k": rows["k"], "kind": rows["kind"], "n": rows["n"], "last": [kept] * len(rows["n"])}

        def due(self, kept):
            return None

    size = 6000
    rng = np.random.default_rng(2)
    ms = rng.integers(1, 2000, size)  # many rows of the same moment
    rows = pd.DataFrame({
        "_bucket": 0, "k": np.array(["a", "b", None], object)[rng.integers(0, 3, size)], "ts": pd.to_datetime(ms, unit="ms"), "n": np.arange(size),
        "kind": np.array(["supervised", "unsupervised", None], object)[rng.integers(0, 3, size)]})
    run = event_order._update(Numbered(), ["k"], "ts", ["n"])
    cut = lambda a, b: [rows.iloc[i : i + 100] for i in range(a, b, 100)]
    for name, value in (("SLICE", 1), ("RANGE", 300), ("PART", 250)):
        monkeypatch.setattr(event_order, name, value, raising=False)
    got, held = called(run, cut(0, 4000), None, 0)
    assert got == [] and len(held) < 12 * 4000
    for blocks, now in ((cut(4000, 5900), 1500), (cut(5900, 6000), 1999)):
        found, held = called(run, blocks, held, now)
        got += found
    seen = dict.fromkeys(("a", "b", None), 0)
    early, late = rows[(ms <= 1500) & (rows["n"] < 5900)], rows[(ms > 1500) | (rows["n"] >= 5900)]
    want = []
    for part in (early, late):
        for r in part.sort_values(["ts", "n"]).itertuples(index=False):
            seen[r.k] += 1
            want.append((r.k, r.kind, r.n, seen[r.k]))
    plain = lambda rs: [tuple(None if v is None or v != v else v for v in r) for r in rs]
    assert sorted(plain(got), key=lambda r: r[2]) == sorted(plain(want), key=lambda r: r[2])


def test_blocks_are_let_go():
    """Columns that are views of a large buffer, as those of Spark's batches with the state beside them, do not keep it."""
    import gc
    import weakref

    import pandas as pd

    from floodgauge.streaming import event_order
    from floodgauge.streaming.reputation import Reputation

    alive, most = [], 0

    class Buffer(np.ndarray):
        pass

    def blocks():
        nonlocal most
        for i in range(40):
            buffer = np.zeros(1000).view(Buffer)
            alive.append(weakref.ref(buffer))
            view = lambda: pd.Series(buffer[:10], copy=False)  # noqa: B023, E731
            frame = {c: view() for c in ("score", "confidence")}
            yield pd.concat([pd.Series(v, name=c) for c, v in {
                "ip": ["a"] * 10, "ts": pd.to_datetime(np.arange(10) + i, unit="s"), "flow_id": np.arange(10), **frame, "attack_type": ["x"] * 10, "detection_method": ["y"] * 10, "ttl": [1] * 10,
            }.items()], axis=1, copy=False)
            del buffer, view, frame
            gc.collect()
            most = max(most, sum(r() is not None for r in alive))

    found, held = called(event_order._update(Reputation(), ["ip"], "ts", ["flow_id"]), blocks(), None, 10**6)
    assert len(found) == 400 and most <= 3
