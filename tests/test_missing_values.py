"""Missing values, NaN and missing keys leave operators' results whole."""

import math

from pyspark.sql import functions as F

from floodgauge.functions.expressions import clamp
from floodgauge.operators import clean, integrate, metrics, reputation, sampling, stats
from floodgauge.sources import messages, tables


def test_clipping_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None), (5, float("nan"))], "id int, x double")
    for clipped in (clean.clip_per_column(df, ["x"]), clean.clip_global(df, ["x"])):
        got = {r.id: r.x for r in clipped.collect()}
        assert got[4] is None and math.isnan(got[5]) and got[2] == 2.0 and 1.0 < got[1] < 1.1
    assert df.select(clamp(F.col("x"), 0.0, 1.0).alias("c")).where("c is null").count() == 1


def classes(spark):
    return spark.createDataFrame([(i, None if i % 4 == 0 else "ab"[i % 2]) for i in range(400)], "id int, label string")


def test_missing_class_is_split_like_others(spark):
    split = sampling.stratified_split(classes(spark), "label", 0.2, key=("id",))
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts[None, "test"] == 20 and counts[None, "train"] == 80 and sum(counts.values()) == 400
    folds = sampling.stratified_folds(classes(spark), "label", 5, key=("id",))
    assert [r["count"] for r in folds.where("label is null").groupBy("fold").count().collect()] == [20] * 5


def test_missing_class_is_sampled(spark):
    sample = sampling.proportional_sample(classes(spark), "label", 200, key=("id",))
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {None: 50, "a": 50, "b": 100}
    capped = sampling.cap_per_class(classes(spark), "label", 30, key=("id",))
    assert {r.label: r["count"] for r in capped.groupBy("label").count().collect()} == {None: 30, "a": 30, "b": 30}


def test_missing_key_keeps_its_group(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("k", 1, 0.2), ("k", 0, 0.7)], "g string, y int, score double")
    assert {r.g: r.auc_roc for r in metrics.roc_auc(df, ["g"]).collect()} == {None: 1.0, "k": 0.0}
    assert {r.g: r.median for r in metrics.latency_stats(df, "score", ["g"]).collect()}[None] == 0.5


def test_missing_name_is_not_the_total(spark):
    df = spark.createDataFrame([(None, 1), ("d", 0), ("d", 1)], "dataset string, y int")
    assert sorted((str(r.dataset), r.n) for r in stats.class_totals(df, "dataset", "y").collect()) == [("None", 1), ("d", 2), ("total", 3)]
    rows = integrate.integration_summary(df, "y", "dataset").collect()
    assert sorted((str(r.configuration), r.samples) for r in rows) == [("None", 1), ("combined", 3), ("individual_d", 2)]


def test_repeated_lookup_key_keeps_rows(spark):
    df, names = spark.createDataFrame([(1,), (2,), (1,)], "k int"), spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    assert sorted(tuple(r) for r in clean.lookup(df, names, "k", "v", "none").collect()) == [(1, "a"), (1, "a"), (2, "none")]


def test_threats_without_score_time_or_address(spark):
    rows = [("x", "2024-01-01 00:00:00", 0.5), ("x", None, 0.9), ("x", "2024-01-01 00:01:00", None), (None, "2024-01-01 00:00:00", 0.9)]
    threats = spark.createDataFrame(rows, "ip string, t string, score double").withColumn("ts", F.to_timestamp("t"))
    got = {(r.ip, r.t): (r.reputation_score, r.validations) for r in reputation.reputation_history(threats).collect()}
    assert got == {("x", rows[0][1]): (0.15, 1), ("x", rows[2][1]): (0.15, 2), ("x", None): (None, None), (None, rows[0][1]): (None, None)}


def test_unreadable_messages_are_kept_apart(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType())])
    df = spark.createDataFrame([('{"a": 1}',), ("not json",), (None,)], "value string")
    assert [r.a for r in messages.decode(df, schema).collect()] == [1]
    assert sorted(map(str, (r.value for r in messages.unreadable(df, schema).collect()))) == ["None", "not json"]


def test_csv_types_and_feature_tables(spark, tmp_path):
    (tmp_path / "one.csv").write_text("x,y\n1,2\n")
    (tmp_path / "flow_features_2024.csv").write_text("x,z\nabc,3\n")
    (tmp_path / "features.csv").write_text("Feature,text\nx,about x\n")
    assert sorted((r.x, r.y, r.z) for r in tables.scan_csv(spark, str(tmp_path)).collect()) == [("1", 2, None), ("abc", None, 3)]
