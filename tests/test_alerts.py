"""Rules as a table, muting over time, and notification times, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from floodgauge.operators import alerts
from floodgauge.operators.alert_routing import audible, merged_intervals, notifications
from floodgauge.operators.alert_rules import fired, increases
from floodgauge.plans.alert_queries import declared_alerts

NAMES = "alertname string, severity string, dev string, instance string, since long, until long"


def test_all_declared_rules_fire(spark):
    found = {r["alertname"]: r["n"] for r in declared_alerts(spark, "/root/testdata/sf0.01").groupBy("alertname").agg(F.count("*").alias("n")).collect()}
    assert set(found) == {r.name for r in alerts.RULES}


def test_rules_as_a_table_equal_rules_one_by_one(spark):
    draw = random.Random(3)
    metrics = sorted({m for r in alerts.RULES for m in (r.metric, r.denominator) if m}) + ["unknown"]
    rows = []
    for _ in range(4000):
        metric = draw.choice(metrics)
        value = draw.choice([0, 0, 1]) if metric.startswith(("up", "bgp")) else draw.randrange(0, 4000)
        rows.append((metric, draw.choice(["a", "b", None]), draw.randrange(0, 9000), float(value)))
    samples = spark.createDataFrame(rows, "metric string, instance string, s long, value double").select("metric", "instance", F.timestamp_seconds("s").alias("ts"), "value").dropDuplicates(["metric", "instance", "ts"])
    known = samples.filter("instance IS NOT NULL")
    want = None
    for rule in alerts.RULES:
        one = alerts.firing(known, rule)
        want = one if want is None else want.unionByName(one)
    got = fired(known.withColumn("increase", F.col("value")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_increases_with_resets(spark):
    rows = [("c", "x", 0, 5.0), ("c", "x", 70, 9.0), ("c", "x", 71, 2.0), ("c", "x", 200, 2.0), ("c", "y", 30, 7.0), ("d", "x", 10, 1.0)]
    samples = spark.createDataFrame(rows, "metric string, instance string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["metric"], r["instance"], r["s"]): r["increase"] for r in increases(samples).collect()}
    assert got == {("c", "x", 0): 0.0, ("c", "x", 70): 4.0, ("c", "x", 71): 2.0, ("c", "x", 200): 0.0, ("c", "y", 30): 0.0, ("d", "x", 10): 0.0}


def made(seed, n=80):
    draw, rows = random.Random(seed), []
    for _ in range(n):
        since = draw.randrange(0, 400)
        rows.append((draw.choice(["p", "q"]), draw.choice(["warning", "warning", "critical", "info", None]), draw.choice([None, "d"]), draw.choice(["x", None]), since, since + draw.choice([0, 5, 40, 150])))
    return sorted(set(rows), key=repr)


@pytest.mark.parametrize("bucket", [7, 100, 86_400])
def test_warnings_are_muted_only_while_a_critical_alert_fires(spark, bucket):
    rows = made(bucket)
    want = [r for r in rows if r[1] != "warning"]
    for name, severity, dev, instance, since, until in rows:
        if severity != "warning":
            continue
        loud = {t for r in rows if r[1] == "critical" and r[2:4] == (dev, instance) for t in range(r[4], r[5])}
        free = [t for t in range(since, until) if t not in loud]
        for t in free:
            if t - 1 not in free:
                end = t
                while end in free:
                    end += 1
                want.append((name, severity, dev, instance, t, end))
    frame = spark.createDataFrame(rows, NAMES)
    got = [tuple(r) for r in audible(frame.unionByName(frame.filter("severity = 'warning'").limit(3)), equal=("dev", "instance", "no such label"), bucket_seconds=bucket).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({r[:4] for r in want}) > 5


def test_merged_intervals(spark):
    rows = spark.createDataFrame([("k", 0, 5), ("k", 5, 6), ("k", 2, 3), ("k", 8, 9), (None, 1, 4), (None, 0, 2)], "k string, since long, until long")
    assert sorted(map(tuple, merged_intervals(rows, ["k"]).collect()), key=repr) == [("k", 0, 6), ("k", 8, 9), (None, 0, 4)]


def told(rows, wait, interval, repeat):
    """Notifications by looking at every group again and again."""
    out = []
    for name in {r[0] for r in rows}:
        mine = [(r[4], r[5]) for r in rows if r[0] == name and r[5] > r[4]]
        firing = lambda t, mine=mine: sum(a <= t < b for a, b in mine)
        changes = sorted({t for i in mine for t in i if firing(t) != firing(t - 1) or any(a == t for a, _ in mine)})
        t = 0
        while t < 1000:
            if not firing(t):
                t += 1
                continue
            opened = closed = t
            while firing(closed):
                closed += 1
            look, sent, before = 0, None, opened - 1
            while True:
                due = opened + wait + look * interval
                now = firing(min(due, closed)) if due < closed else 0
                changed = any(before < c <= due for c in changes if c <= closed)
                if now == 0:
                    if sent is not None:
                        out.append((name, opened, due, "resolved", 0))
                    break
                if sent is None or changed:
                    out.append((name, opened, due, "first" if sent is None else "change", now))
                    sent = look
                elif (look - sent) * interval >= repeat:
                    out.append((name, opened, due, "repeat", now))
                    sent = look
                before, look = due, look + 1
            t = closed + 1
    return sorted(out)


@pytest.mark.parametrize("times", [(10, 10, 3600), (3, 7, 20), (0, 1, 1), (30, 50, 60)])
def test_notification_times(spark, times):
    draw, rows = random.Random(5), []
    for _ in range(25):
        since = draw.randrange(0, 900)
        rows.append((draw.choice("pqr"), "warning", None, None, since, since + draw.choice([0, 2, 11, 60, 90])))
    got = sorted(tuple(r) for r in notifications(spark.createDataFrame(rows, NAMES), ("alertname",), *times).collect())
    assert got == told(rows, *times) and len(got) > 10


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], NAMES)
    assert audible(nothing).count() == 0 and notifications(nothing).count() == 0
