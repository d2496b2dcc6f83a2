import random

import pytest
from pyspark.sql import functions as F

from floodgauge.operators.reputation import latest_state, reputation_history, should_block, with_reputation

GAPS = [1, 10, 59, 600, 3599, 3600, 3601, 4319, 4320, 4679, 4680, 5400, 6000, 7199, 7200, 9000]


def fold(events):
    """Plain definition: events of one address in order -> (score, validations) after each."""
    total = count = 0
    last, out = None, []
    for ts, score in events:
        if last is not None and ts - last >= int(3600 * (1 + round(min(1.0, 0.3 * total), 9))):
            total, count = 0.0, 0
        total, count, last = total + score, count + 1, ts
        out.append((round(min(1.0, 0.3 * total), 9), count))
    return out


def timelines(seed, keys=40, length=60):
    rng = random.Random(seed)
    data = {}
    for k in range(keys):
        ts, rows = 1_700_000_000 + rng.randrange(100), []
        for _ in range(rng.randrange(1, length)):
            rows.append((ts, rng.choice([0.1, 0.25, 0.5, 1.0, rng.random()])))
            ts += rng.choice(GAPS)
        data[f"ip{k}"] = rows
    return data


def frame(spark, data):
    rows = [(ip, ts, s, i) for ip, evs in data.items() for i, (ts, s) in enumerate(evs)]
    return spark.createDataFrame(rows, "ip string, t long, score double, flow_id long").withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("seed,chunk", [(1, 60), (2, 60), (3, 0.5)])
def test_history_equals_fold(spark, seed, chunk):
    data = timelines(seed)
    history = reputation_history(frame(spark, data), ("flow_id",), chunk_seconds=chunk)
    got = {(r.ip, r.flow_id): (r.reputation_score, r.validations) for r in history.collect()}
    for ip, events in data.items():
        for i, (score, count) in enumerate(fold(events)):
            assert got[(ip, i)][1] == count and got[(ip, i)][0] == pytest.approx(score, abs=2e-9), (ip, i)


def test_history_continues_from_state(spark):
    data = timelines(9)
    early = {ip: evs[: len(evs) // 2] for ip, evs in data.items()}
    state = latest_state(
        reputation_history(frame(spark, early), ("flow_id",)).withColumn("attack_type", F.lit("a")).withColumn(
            "detection_method", F.lit("d")), ("flow_id",))
    late = frame(spark, data)
    sizes = {ip: len(evs) // 2 for ip, evs in data.items()}
    cut = spark.createDataFrame(list(sizes.items()), "ip string, half int")
    rest = late.join(cut, "ip").filter("flow_id >= half").drop("half")
    got = {(r.ip, r.flow_id): (r.reputation_score, r.validations) for r in reputation_history(rest, ("flow_id",), state).collect()}
    for ip, events in data.items():
        for i, (score, count) in enumerate(fold(events)):
            if i >= sizes[ip] > 0:
                assert got[(ip, i)][1] == count and got[(ip, i)][0] == pytest.approx(score, abs=1e-8), (ip, i)


def test_block_limits(spark):
    cases = [(0.7, 3, False), (0.7000001, 3, True), (0.8, 2, False), (0.9, 2, False), (0.90001, 1, True), (None, None, False)]
    df = spark.createDataFrame([(s, v) for s, v, _ in cases], "s double, v int")
    got = [r[0] for r in df.select(should_block(F.col("s"), F.col("v"))).collect()]
    assert got == [c for _, _, c in cases]


def test_expired_entries_do_not_block(spark):
    state = spark.sql("SELECT 'a' AS ip, 1.0D AS score, 5L AS validations, timestamp'2024-01-01 00:00:00' AS last_seen")
    events = spark.createDataFrame([("a",), ("b",)], "ip string")
    at = lambda t: {r.ip: r.should_block for r in with_reputation(events, state, F.lit(t).cast("timestamp")).collect()}
    assert at("2024-01-01 01:59:59") == {"a": 1, "b": 0}
    assert at("2024-01-01 02:00:00") == {"a": 0, "b": 0}
