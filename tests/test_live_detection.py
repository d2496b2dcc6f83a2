import os
import tempfile

import pytest
from pyspark.sql import functions as F

from floodgauge.ml import registry, training
from floodgauge.ml.isolation_forest import fit_isolation_forest
from floodgauge.operators.features import FLOW_FEATURES, flow_features
from floodgauge.streaming.detection import LiveDetection


@pytest.fixture(scope="module")
def logs(spark):
    return spark.range(300).select(
        F.col("id").alias("flow_id"), F.concat(F.lit("10.0.0."), F.col("id") % 3).alias("src_ip"), F.timestamp_seconds(F.col("id") * 10).alias("ts"),
        F.lit(6).alias("protocol"), F.lit(99).alias("src_port"), (F.col("id") % 3 + 53).cast("int").alias("dst_port"), F.lit(16).alias("tcp_flags"),
        F.lit(500).cast("long").alias("bytes"), F.lit(4).cast("long").alias("packets"), F.lit(2.0).alias("duration"))


@pytest.fixture(scope="module")
def detector(logs):
    """Makes a detector that takes one of the three destination ports for attacks."""
    train = flow_features(logs, keep=("flow_id",)).cache()
    forest = fit_isolation_forest(train, list(FLOW_FEATURES), n_trees=5, key=["flow_id"])

    def make(level, version, kind):
        taught = train.withColumn("y", (F.col("flow_id") % 3 == kind).cast("int"))
        model = training.assembled(FLOW_FEATURES, training.decision_tree("y", depth=3), taught).fit(taught)
        return registry.Detector([registry.ModelPackage(model, list(FLOW_FEATURES))], forest, level, version)

    return make


def found(spark, folder):
    rows = spark.read.parquet(f"{folder}/threats").filter("detection_method = 'supervised'")
    return {(r["batch"], r["model_level"], r["model_version"], r["ip"]): r["n"]
            for r in rows.groupBy("batch", "model_level", "model_version", "ip").agg(F.count("*").alias("n")).collect()}


def test_newer_and_better_detectors_take_over(spark, logs, detector):
    models, out = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    live = LiveDetection(models, out)
    with pytest.raises(FileNotFoundError):
        live(logs, 0)
    registry.save_detector(spark, detector("simple", 2, 0), models)
    live(logs, 0)
    registry.save_detector(spark, detector("simple", 1, 1), models)  # older than the one in use
    live(logs, 1)
    registry.save_detector(spark, detector("hybrid", 1, 1), models)
    live(logs, 0)  # again, as after a crash: with its own detector
    live(logs, 2)
    registry.save_detector(spark, detector("optimized", 7, 2), models)
    LiveDetection(models, out)(logs, 3)
    LiveDetection(models, out)(logs, 1)
    assert found(spark, out) == {
        (0, "simple", 2, "10.0.0.0"): 100, (1, "simple", 2, "10.0.0.0"): 100, (2, "hybrid", 1, "10.0.0.1"): 100, (3, "optimized", 7, "10.0.0.2"): 100}


def test_fall_back_and_unfinished_detectors(spark, detector):
    models = tempfile.mkdtemp(prefix="run-")
    with pytest.raises(FileNotFoundError):
        registry.newest_detector(spark, models)
    registry.save_detector(spark, detector("simple", 1, 0), models)
    # An attempt that broke off: parts, and a row not yet in place.
    unfinished = detector("optimized", 1, 1)
    registry.save_package(spark, unfinished.supervised[0], f"{models}/optimized-v1/supervised-0")
    os.makedirs(f"{models}/saved/optimized-v1/_temporary/0")
    assert registry.newest_detector(spark, models) == ("simple", 1)
    registry.save_detector(spark, unfinished, models)
    registry.save_detector(spark, detector("hybrid", 5, 0), models)
    assert registry.newest_detector(spark, models) == ("optimized", 1)
    assert registry.newest_detector(spark, models, ("hybrid", "simple")) == ("hybrid", 5)
    loaded = registry.load_detector(spark, models, "hybrid", 5)
    assert (loaded.level, loaded.version, len(loaded.supervised), len(loaded.forest.trees)) == ("hybrid", 5, 1, 5)
    with pytest.raises(FileNotFoundError):
        registry.load_detector(spark, models, "hybrid", 6)
    with pytest.raises(ValueError, match="already"):
        registry.save_detector(spark, unfinished, models)
    with pytest.raises(ValueError, match="levels"):
        registry.save_detector(spark, registry.Detector([], loaded.forest, "simple", 3), models)
