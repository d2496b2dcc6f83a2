import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgauge.operators.ordered import (
    chunk_for,
    cumulate_by_value,
    dense_codes,
    exact_percentiles,
    grouped_percentiles,
    with_neighbours,
)


@pytest.mark.parametrize("limit,accuracy", [(100_000, 10_000), (50, 100), (5, 20)])
def test_exact_percentiles(spark, limit, accuracy):
    rng = random.Random(1)
    heavy = [(rng.choice([0.0, 0.0, 0.0, rng.gauss(0, 1)]), rng.lognormvariate(0, 8), None if i % 7 == 0 else float(i % 13))
             for i in range(4000)]
    df = spark.createDataFrame(heavy, "a double, b double, c double").repartition(7)
    wanted = [0.0, 0.01, 0.25, 0.5, 0.777, 0.95, 1.0]
    got = exact_percentiles(df, {c: wanted for c in "abc"}, limit, accuracy)
    for i, c in enumerate("abc"):
        values = [r[i] for r in heavy if r[i] is not None]
        for p in wanted:
            assert got[c][p] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-300), (c, p)


def test_percentiles_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "a double")
    assert exact_percentiles(df, {"a": [0.5]}) == {"a": {0.5: None}}


def test_grouped_percentiles(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("xyz"), rng.choice([1.0, rng.random()])) for _ in range(3000)]
    got = grouped_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "p": 0.95}).collect()
    assert len(got) == 4
    for r in got:
        values = [v for g, v in rows if g == r["g"]]
        assert r["m"] == pytest.approx(np.percentile(values, 50)) and r["p"] == pytest.approx(np.percentile(values, 95))


def test_cumulate(spark):
    rows = [("a" if i % 3 else "b", i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int, n int")
    got = {(r.k, r.v): r.n_before for r in cumulate_by_value(df, ["k"], "v", ["n"]).collect()}
    assert len(got) == 1000
    for k, v, _ in rows[::50]:
        assert got[(k, v)] == sum(n for kk, vv, n in rows if kk == k and vv < v)


def test_dense_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("ab",)], "c string")
    assert {r.c: r.code for r in dense_codes(df, "c").collect()} == {"a": 0, "ab": 1, "b": 2}


def test_neighbours(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("xy"), rng.randrange(0, 4000), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, s int, i int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: (r.previous and r.previous.i, r.following and r.following.i)
           for r in with_neighbours(df, ["k"], ["ts", "i"], ["i"], chunk_seconds=60).collect()}
    for k in ("hot", "x", "y"):
        ids = [i for _, _, i in sorted((kk, s, i) for kk, s, i in rows if kk == k)]
        for n, i in enumerate(ids):
            assert got[i] == (ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None)


def test_chunk_length(spark):
    dense = spark.range(100_000).select(F.timestamp_micros(F.col("id")).alias("ts"))
    assert chunk_for(dense, "ts", rows=50_000) == pytest.approx(0.05, rel=0.01)
    assert chunk_for(dense, "ts", rows=1) == 0.001
    assert chunk_for(spark.range(2).select(F.timestamp_seconds(F.col("id") * 10**6).alias("ts")), "ts") == 60
    assert chunk_for(dense.limit(0), "ts") == 60


def test_percentiles_with_infinite_values_whatever_the_limit(spark):
    import math

    from pyspark.sql import functions as F

    from floodgauge.operators.ordered import exact_percentiles

    rows = spark.range(1000).select(
        F.when(F.col("id") < 100, float("-inf")).when(F.col("id") >= 700, float("inf")).otherwise(F.col("id").cast("double")).alias("x"))
    wanted = [0.0, 0.05, 0.5, 0.8, 1.0]
    want = {0.0: -math.inf, 0.05: -math.inf, 0.5: 499.5, 0.8: math.inf, 1.0: math.inf}
    for limit in (100_000, 50):
        assert exact_percentiles(rows, {"x": wanted}, exact_limit=limit)["x"] == want
