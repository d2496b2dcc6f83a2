from collections import Counter

import pytest
from pyspark.sql import functions as F

from floodgauge.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, "WebDDoS").otherwise("b").alias("label"),
        (F.col("id") % 3 < 2).cast("int").alias("attack"), (F.col("id") % 2).cast("string").alias("source"))


@pytest.fixture(scope="module")
def copies(spark):
    """One row makes up half of the table, another a sixth."""
    return spark.range(6000).select(
        F.when(F.col("id") < 3000, -1).when(F.col("id") < 4000, -2).otherwise(F.col("id")).alias("v"), F.lit("x").alias("label"))


def test_cap_per_class(spark, rows):
    got = sampling.cap_per_class(rows, "label", 700)
    assert Counter(r.label for r in got.collect()) == {"hot": 700, "b": 700}
    again = sampling.cap_per_class(rows.repartition(13), "label", 700)
    assert sorted(got.collect()) == sorted(again.collect())
    assert sampling.cap_per_class(rows, "label", 10**6, ()).count() == 9000


def test_copies_are_split_exactly(spark, copies):
    for n in (1, 1500, 3001, 4500, 5999, 6000):
        got = sampling.capped_sample(copies, n)
        assert got.count() == n and got.exceptAll(copies).count() == 0
    split = sampling.stratified_split(copies, "label", 0.2, 0.25)
    assert Counter(r.split for r in split.collect()) == {"test": 1200, "val": 1200, "train": 3600}
    assert split.drop("split").exceptAll(copies).count() == 0
    folds = sampling.stratified_folds(copies, "label", 7)
    sizes = Counter(r.fold for r in folds.collect())
    assert sum(sizes.values()) == 6000 and max(sizes.values()) - min(sizes.values()) <= 1
    assert folds.drop("fold").exceptAll(copies).count() == 0


def test_mixed_and_ratio(spark, rows):
    assert Counter(r.attack for r in sampling.mixed_sample(rows, "attack", 1000).collect()) == {1: 700, 0: 300}
    assert sampling.mixed_sample(rows.filter("attack = 1"), "attack", 1000).count() == 6000
    assert Counter(r.attack for r in sampling.ratio_sample(rows, "attack", 1000).collect()) == {1: 666, 0: 334}
    assert sampling.ratio_sample(rows, "attack", 10_000).count() == 9000


def test_proportional(spark, rows):
    got = Counter(r.label for r in sampling.proportional_sample(rows, "label", 900).collect())
    assert got == {"hot": 600, "b": 270, "WebDDoS": 30}


def test_source_quota_falls_back(spark, rows):
    poor = rows.filter("source = '0' OR attack = 1")
    got = Counter((r.source, r.attack) for r in sampling.source_quota_sample(poor, "source", "attack", 1000).collect())
    assert got == {("0", 0): 400, ("0", 1): 600, ("1", 1): 1000}


def test_split_and_folds(spark, rows):
    got = Counter((r.label, r.split) for r in sampling.stratified_split(rows, "label", 0.2, 0.1).collect())
    assert got[("hot", "test")] == 1200 and got[("hot", "val")] == 480 and got[("hot", "train")] == 4320
    folds = Counter((r.label, r.fold) for r in sampling.stratified_folds(rows, "label", 7).collect())
    for label in ("hot", "b", "WebDDoS"):
        sizes = [folds[(label, f)] for f in range(7)]
        assert max(sizes) - min(sizes) <= 1
