import random

import pytest
from pyspark.sql import functions as F

from floodgauge.operators import alerts, detection, features, latency, metrics, mitigation, stats, windows


def scored(spark, rows):
    return spark.createDataFrame([("m", y, float(s), int(s >= 0.5)) for y, s in rows], "model string, y int, score double, predicted int")


def test_auc_against_pairs(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), rng.choice([0.1, 0.5, 0.9, rng.random()])) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    got = metrics.roc_auc(scored(spark, rows), ["model"]).first().auc_roc
    assert got == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    assert metrics.roc_auc(scored(spark, [(1, 0.3), (1, 0.4)]), ["model"]).first().auc_roc == 0.0


def test_zero_divisions(spark):
    row = metrics.binary_metrics(scored(spark, [(0, 0.1), (0, 0.2)]), ["model"]).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score, row.false_positive_rate) == (1.0, 0.0, 0.0, 0.0, 0.0)
    row = metrics.binary_metrics(scored(spark, [(1, 0.9)]), ["model"]).first()
    assert row.false_positive_rate == 0.0 and row.f1_score == 1.0


def test_threshold_ties_and_default(spark):
    assert metrics.best_threshold(scored(spark, [(1, 0.9), (0, 0.1)]), ["model"]).first().threshold == 0.3
    assert metrics.best_threshold(scored(spark, [(1, 0.1), (0, 0.9)]), ["model"]).first().threshold == 0.5
    at = {r.threshold: r.recall for r in metrics.threshold_sweep(scored(spark, [(1, 0.45), (0, 0.1)]), ["model"]).collect()}
    assert at[0.45] == 1.0 and at[0.5] == 0.0 and len(at) == 10


def test_best_by_ties(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "model string, v double")
    assert metrics.best_by(df, [], "v", "model").first().model == "a"
    assert metrics.best_by(df.withColumn("v", F.lit(0.0)), [], "v", "model").filter("model IS NOT NULL").count() == 0


def test_latency_of_repeated_flows(spark):
    df = lambda rows: spark.createDataFrame(rows, "flow_id int, s int").select("flow_id", F.timestamp_seconds("s").alias("ts"))
    got = latency.flow_latencies(df([(1, 0), (1, 50), (2, 10), (3, 7)]), df([(1, 90), (1, 95), (2, 10), (4, 1)])).collect()
    assert sorted((r.flow_id, r.latency) for r in got) == [(1, 40.0), (2, 0.0)]
    one = metrics.latency_stats(spark.createDataFrame([(2.5,)], "latency double")).first()
    assert (one["count"], one.std_dev, one.p95, one.median) == (1, 0.0, 2.5, 2.5)
    assert metrics.latency_stats(spark.createDataFrame([], "latency double")).count() == 0


def test_gates(spark):
    rows = [(1.0, 0.9, 0.84), (0.99, 0.9, 0.9), (0.9, 0.9, None), (0.89, 0.5, 0.5)]
    df = spark.createDataFrame([(a, f, c, 0.95) for a, f, c in rows], "accuracy double, f1_score double, cv_f1_mean double, high_confidence_ratio double")
    got = [(r.grade, r.cv_gap, r.overconfident) for r in metrics.quality_gates(df).orderBy(F.desc("accuracy")).collect()]
    assert got == [("overfit_suspect", 1, 0), ("good", 0, 0), ("acceptable", 0, 0), ("low", 0, 0)]
    s = metrics.quality_summary(df).first()
    assert (s.n_models, s.n_good, s.n_overfit, s.success_rate, s.verdict) == (4, 2, 1, 0.5, "attention")


def test_balance_limits(spark):
    cases = {1.0: "no_normal_samples", 0.95: "very_unbalanced", 0.9: "questionable", 0.8: "well_balanced", 0.3: "well_balanced", 0.29: "questionable"}
    df = spark.createDataFrame([(r,) for r in cases], "r double")
    assert {r[0]: r[1] for r in df.select("r", stats.balance_verdict(F.col("r"))).collect()} == cases


def test_strategy_and_rules(spark):
    cases = [
        ("volumetric", 0.1, "blackhole", "discard"), ("protocol", 0.95, "flowspec", "discard"),
        ("protocol", 0.951, "blackhole", "discard"), ("zero_day", 0.9, "flowspec", "rate_limit_1mbps"),
        ("zero_day", 0.7, "flowspec", "rate_limit_10mbps"), ("application_layer", 0.2, "flowspec", "rate_limit_1mbps"),
        ("new_kind", 0.2, "flowspec", "rate_limit_10mbps"),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "a string, s double")
    got = df.select(mitigation.strategy(F.col("a"), F.col("s")), mitigation.rule_action(F.col("a"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]
    plain = spark.sql("SELECT '1.2.3.4' AS ip, CAST(NULL AS STRING) AS attack_type, CAST(NULL AS DOUBLE) AS threat_score,"
                      " timestamp'2024-01-01 00:00:00' AS timestamp, CAST(NULL AS INT) AS ttl")
    row = mitigation.announcements(plain).first()
    assert (row.attack_type, row.threat_score, row.ttl, row.route_type) == ("unknown", 0.5, 3600, "flowspec")
    assert "rate_limit_10mbps;" in row.command and "community 65000:10;" in row.command and "source 1.2.3.4/32;" in row.command


def routes(spark, rows):
    return spark.createDataFrame(rows, "ip string, s int, ttl int, route_type string").withColumn("timestamp", F.timestamp_seconds("s"))


def test_withdrawal_limits(spark):
    rows = [("a", 0, 100, "flowspec"), ("a", 100, 100, "blackhole"), ("b", 0, 100, "flowspec"), ("b", 101, 50, "blackhole")]
    secs = lambda d: sorted((r.ip, r.route_type, int(r.timestamp.timestamp())) for r in d.collect())
    df = routes(spark, rows)
    assert secs(mitigation.withdrawals(df)) == [("a", "blackhole", 200), ("b", "blackhole", 151), ("b", "flowspec", 100)]
    now = F.timestamp_seconds(F.lit(151))
    assert secs(mitigation.withdrawals(df, now=now)) == [("b", "flowspec", 100)]
    assert secs(mitigation.withdrawals(df, sweep_seconds=60))[0] == ("a", "blackhole", 240)
    assert ("a", "flowspec", 100) in secs(mitigation.withdrawals(df, per_type=True))
    assert sorted(r.ip for r in mitigation.active_routes(df, now).collect()) == ["a", "b"]
    assert sorted(r.ip for r in mitigation.active_routes(df, F.timestamp_seconds(F.lit(152))).collect()) == ["a"]


def test_detection_limits(spark):
    df = spark.createDataFrame([(1, 0.7, 0.7, 0.0), (2, 0.71, 0.7, -0.9), (3, 0.0, 0.0, -0.5), (4, 0.0, 0.0, -0.9), (5, None, None, 1.0)],
                               "id int, p double, q double, d double").withColumns({"src_ip": F.lit("x"), "ts": F.current_timestamp()})
    got = {r.id: (r.attack_type, round(r.score, 6)) for r in detection.detect(df, ["p", "q"], "d", keep=("id",)).collect()}
    assert got == {2: ("known_ddos", 0.705), 4: ("zero_day", 0.2)}


def test_flow_features_limits(spark):
    df = spark.createDataFrame([(100, 0, 0.0, 0x12, 6), (100, 4, 0.5, None, 17), (None, None, None, 0x05, None)],
                               "bytes long, packets long, duration double, tcp_flags int, protocol int")
    rows = features.flow_features(df).collect()
    assert rows[0].avg_packet_size == 100 and rows[0].bytes_per_second == 100 and (rows[0].syn_flag, rows[0].ack_flag) == (1, 1)
    assert rows[1].packets_per_second == 4 and rows[1].tcp_flags == 0
    assert rows[2].bytes_per_second == 0 and (rows[2].fin_flag, rows[2].rst_flag, rows[2].protocol) == (1, 1, 0)


def test_window_edges(spark):
    df = spark.sql("SELECT timestamp_seconds(s) AS ts, CAST(NULL AS STRING) AS src_ip, 'd' AS dst_ip, 1 AS src_port, p AS dst_port,"
                   " 6 AS protocol, 1L AS packets, 10L AS bytes, 0.0D AS duration, 2 AS tcp_flags FROM VALUES (4.999, 1024), (5.0, 1025), (9.5, 80) t(s, p)")
    rows = windows.window_features(df).orderBy("window_key").collect()
    assert [(r.window_key, r.flow_count, r.high_port_flows, r.port_80_flows) for r in rows] == [(0, 1, 0, 0), (1, 2, 1, 1)]
    assert rows[0].unique_src_ips == 1 and rows[0].duration_mean == 0.0 and rows[0].duration_std == 0.0


def test_trailing_cutoff(spark):
    df = spark.sql("SELECT 'a' AS k, timestamp_seconds(s) AS ts FROM VALUES (40), (41), (100), (101) t(s)")
    got = {r.event_type: r.n_events for r in windows.trailing_throughput(df, "ts", "k", F.timestamp_seconds(F.lit(100))).collect()}
    assert got == {"a": 2, "total": 2}


def test_alert_hold_and_inhibition(spark):
    rule = alerts.Rule("Down", "up", "below", 1, 60, 120, "critical")
    df = spark.sql("SELECT 'up' AS metric, i AS instance, timestamp_seconds(s) AS ts, v AS value FROM VALUES"
                   " ('x', 10, 0.0D), ('x', 70, 0.0D), ('x', 130, 0.0D), ('y', 10, 0.0D), ('y', 70, 1.0D), ('y', 130, 0.0D) t(i, s, v)")
    fired = alerts.firing(df, rule)
    assert [(r.instance, r.pending_since, r.firing_since, r.last_seen) for r in fired.collect()] == [("x", 60, 180, 180)]
    both = fired.unionByName(fired.withColumn("severity", F.lit("warning"))).unionByName(
        fired.withColumns({"severity": F.lit("warning"), "instance": F.lit("y")}))
    assert sorted((r.severity, r.instance) for r in alerts.inhibit(both).collect()) == [("critical", "x"), ("warning", "y")]
    assert alerts.group_alerts(both).first().worst_severity == "critical"
