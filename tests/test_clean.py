import pytest
from pyspark.sql import functions as F

from floodgauge.operators import clean, integrate


def test_label_styles(spark):
    df = spark.createDataFrame([(v,) for v in ("BENIGN", "Benign", "benign", "Normal", "0", "10", "Syn", None)], "l string")
    flags = lambda style: [r[0] for r in df.select(clean.attack_flag(F.col("l"), style)).collect()]
    assert flags("mapped") == [0, 0, 1, 1, 1, 1, 1, 1]
    assert flags("upper") == [0, 0, 0, 1, 1, 1, 1, 1]
    assert flags("normal") == [0, 1, 1, 0, 1, 1, 1, 1]
    assert flags("any") == [0, 0, 0, 0, 0, 1, 1, 1]


def test_find_label():
    assert clean.find_label(["x", "Attack", "Label"]) == "Label"
    assert clean.find_label(["x", "my_label_col", "y"]) == "my_label_col"
    assert clean.find_label(["x", "y"]) == "y"
    with pytest.raises(ValueError):
        clean.find_label(["x", "y"], last_resort=False)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 3, 0)], "`Src Port` int, MIN_IP_PKT_LEN double, name string, z long, Label int")
    assert clean.drop_identifiers(df).columns == ["MIN_IP_PKT_LEN", "name", "z", "Label"]
    assert clean.numeric_columns(df) == ["MIN_IP_PKT_LEN", "z"]


def test_narrowing(spark):
    df = spark.createDataFrame([(127, 128, 40000, 2**40, 0.5, 0.1), (-128, 0, -1, 0, None, 1.0)],
                               "a long, b long, c long, d long, e double, f double")
    assert dict(clean.narrow_types(df).dtypes) == {
        "a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "f": "double"}


def test_encoding_and_missing(spark):
    df = spark.createDataFrame([("tcp", "x"), (None, "y"), ("udp", "x"), ("tcp", None)], "proto string, Label string")
    out = clean.encode_categories(df, ["proto", "Label"])
    assert out.columns == ["proto", "Label", "proto_codificada"]
    assert {r.proto: r.proto_codificada for r in out.collect()} == {None: 0, "tcp": 1, "udp": 2}
    wide = spark.range(60).select(F.col("id").cast("string").alias("c"))
    assert clean.encode_categories(wide, ["c"]).columns == ["c"]


def test_median_and_clip(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("-inf"),), (4.0,), (10.0,), (7.0,)], "a double")
    rows = sorted(r.a for r in clean.median_fill(clean.infinite_to_null(df)).collect())
    assert rows == [1.0, 4.0, 5.5, 5.5, 7.0, 10.0]
    clipped = [r.a for r in clean.clip_per_column(spark.range(101).select(F.col("id").cast("double").alias("a")), ["a"]).orderBy("a").collect()]
    assert clipped[0] == 1.0 and clipped[-1] == 99.0


def test_duplicates_with_missing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert clean.drop_duplicate_rows(df).count() == 2
    assert tuple(clean.duplicate_report(df).first()) == (3, 2, 1)


def test_integration(spark):
    a = spark.createDataFrame([(1.0, 2.0, 0)], "x double, y double, label int")
    b = spark.createDataFrame([(3.0, 4.0, 5.0, 1)], "y double, w double, x double, label int")
    by_name = integrate.integrate_by_name({"a": a, "b": b}, "label")
    assert by_name.columns == ["x", "y", "label", "source"]
    assert {tuple(r) for r in by_name.collect()} == {(1.0, 2.0, 0, "a"), (5.0, 3.0, 1, "b")}
    by_place = integrate.integrate_by_position({"a": a, "b": b}, "label")
    assert {tuple(r) for r in by_place.collect()} == {(1.0, 2.0, 0, "a"), (3.0, 4.0, 1, "b")}
    with pytest.raises(ValueError):
        integrate.integrate_by_name({"a": a, "b": b.select("w", "label")}, "label")
    assert integrate.configuration(by_name, "individual_b").count() == 1
