import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from floodgauge.operators import windows
from floodgauge.plans.views import flows

SCHEMA = "ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packets long, bytes long, duration double, tcp_flags int"
START = datetime(2024, 1, 1)


def assert_same(got, want):
    """Equal rows; numbers may differ by the order of additions."""
    assert got.columns == want.columns
    first, second = (sorted(map(tuple, df.collect())) for df in (got, want))
    assert len(first) == len(second)
    for a, b in zip(first, second):
        assert [v == pytest.approx(w, rel=1e-9, abs=1e-9) if isinstance(w, float) else v == w for v, w in zip(a, b)] == [True] * len(a), (a, b)


def flow(second, **values):
    default = dict(src_ip="a", dst_ip="b", src_port=1, dst_port=80, protocol=6, packets=1, bytes=10, duration=1.0, tcp_flags=2)
    return tuple({"ts": START + timedelta(seconds=second), **default, **values}.values())


ODD = [
    flow(0), flow(0), flow(1, src_ip=None, dst_ip="", src_port=None, dst_port=0), flow(2, src_port=65535, dst_port=32767), flow(3, src_port=32768, dst_port=32768),
    flow(4, src_port=-1, dst_port=70000), flow(4, src_port=-1, dst_port=70001), flow(6, bytes=None, packets=None, duration=None, tcp_flags=None, protocol=None),
    flow(7, duration=0.0), flow(21, duration=-1.0), flow(30, bytes=2**40), flow(31, bytes=2**40 + 1), flow(32, bytes=2**40 + 2),
]


@pytest.mark.parametrize("seconds", [5, 10])
def test_counting_by_value_equals_distinct_counts(spark, seconds):
    df = spark.createDataFrame(ODD + [(None, *flow(0)[1:])], SCHEMA)
    want = windows.window_features(df, window_seconds=seconds)
    got = windows.window_features_by_value(df, window_seconds=seconds)
    assert_same(got, want)
    assert windows.window_features_by_value(df.limit(0)).count() == 0


def test_windows_from_steps_equal_windows_of_flows(spark):
    """Also ports at the ends of the maps, what is no port, and large values close to each other."""
    df = spark.createDataFrame(ODD + [(None, *flow(0)[1:])], SCHEMA)
    steps = windows.step_summaries(df, 5)
    for seconds in (5, 10, 30):
        want = windows.window_features(df, window_seconds=seconds).drop("window_key", "flow_count")
        got = windows.windows_from_steps(steps, 5, seconds)
        assert_same(got, want)
    assert windows.windows_from_steps(windows.step_summaries(df.limit(0), 5), 5, 10).count() == 0


def test_summaries_can_be_kept_and_slide(spark, folder):
    rows = flows(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    path = tempfile.mkdtemp(prefix="run-") + "/steps"
    windows.step_summaries(rows, 3600).write.parquet(path)
    got = windows.windows_from_steps(spark.read.parquet(path), 3600, 4 * 3600, 2 * 3600)
    grouped = rows.groupBy(F.window("ts", "4 hours", "2 hours").alias("w")).agg(*windows.traffic_aggregates(4 * 3600))
    want = grouped.select(F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), *[c for c in grouped.columns if c != "w"])
    assert got.count() > 300
    assert_same(got, want)


def test_estimates_stay_within_their_error(spark):
    many = spark.range(200_000).select(
        (F.lit(START).cast("timestamp") + F.make_interval(secs=F.col("id") % 40)).alias("ts"), (F.col("id") % 50_000).cast("string").alias("src_ip"),
        F.col("id").cast("string").alias("dst_ip"), (F.col("id") % 60_000).cast("int").alias("src_port"), F.lit(80).alias("dst_port"), F.lit(6).alias("protocol"),
        F.lit(1).cast("long").alias("packets"), F.col("id").alias("bytes"), F.lit(1.0).alias("duration"), F.lit(2).alias("tcp_flags"))
    steps = windows.step_summaries(many, 5)
    row = windows.windows_from_steps(steps, 5, 40).first()
    assert row["unique_src_ports"] == 60_000 and row["total_flows"] == 200_000
    assert abs(row["unique_src_ips"] - 50_000) < 0.04 * 50_000 and abs(row["unique_dst_ips"] - 200_000) < 0.04 * 200_000
    plan = windows.windows_from_steps(steps, 5, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_lengths_must_fit(spark):
    steps = windows.step_summaries(spark.createDataFrame(ODD, SCHEMA), 5)
    for lengths in ((12, None), (10, 3), (10, 20)):
        with pytest.raises(ValueError):
            windows.windows_from_steps(steps, 5, *lengths)


def test_windows_equal_distinct_aggregates_and_copy_no_sums(spark):
    """The rows that are made for each value hold their key only: no Expand of whole flows."""
    df = spark.createDataFrame(ODD + [(None, *flow(0)[1:])], SCHEMA)
    grouped = df.groupBy(F.window("ts", "10 seconds").alias("w")).agg(*windows.traffic_aggregates(10))
    got = windows.window_features(df, window_seconds=10)
    assert_same(got.select(*[c for c in grouped.columns if c != "w"]), grouped.drop("w"))
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_distinct_values_in_sliding_windows(spark):
    df = spark.createDataFrame(ODD + [flow(47), flow(90, src_ip=None), (None, *flow(0)[1:])], SCHEMA)
    want = df.groupBy(F.window("ts", "20 seconds", "5 seconds").alias("w")).agg(*[F.countDistinct(c).alias(c) for c in ("src_ip", "src_port")])
    want = {r.start: (r.src_ip, r.src_port) for r in want.select("w.start", "src_ip", "src_port").collect()}
    got = {r.start_time: (r.src_ip, r.src_port) for r in windows.distinct_in_windows(df, ["src_ip", "src_port"], 5, 20).collect()}
    assert got == want and len(got) > 10
