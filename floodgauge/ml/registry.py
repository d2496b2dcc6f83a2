"""Storage of fitted models with everything needed to score, and choice by priority."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.ml.isolation_forest import IsolationForest
from floodgauge.ml.training import with_probability
from floodgauge.operators.detection import predict
from floodgauge.operators.metrics import DEFAULT_THRESHOLD


@dataclass
class ModelPackage:
    model: PipelineModel
    features: list[str]
    threshold: float = DEFAULT_THRESHOLD
    kind: str = ""
    level: str = ""
    version: str = "1.0"

    def score(self, df: DataFrame) -> DataFrame:
        """Attack probability and the prediction at the package's threshold.

        Features are chosen by name; a table without all of them is refused.
        """
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"model needs columns the table lacks: {missing}")
        scored = with_probability(self.model, df)
        return scored.withColumn("predicted", predict(F.col("score"), self.threshold, F.col("predicted")))

    def metadata(self) -> dict:
        return {"features": self.features, "threshold": self.threshold, "kind": self.kind, "level": self.level,
                "version": self.version, "n_features": len(self.features)}


def save_package(spark: SparkSession, package: ModelPackage, path: str) -> None:
    package.model.write().overwrite().save(f"{path}/model")
    text = spark.createDataFrame([(json.dumps(package.metadata()),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_package(spark: SparkSession, path: str) -> ModelPackage:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    model = PipelineModel.load(f"{path}/model")
    return ModelPackage(model, meta["features"], meta["threshold"], meta["kind"], meta["level"], meta["version"])


# Levels of models, best first.
LEVELS = ("optimized", "hybrid", "simple")


def load_by_priority(spark: SparkSession, folder: str, levels: Sequence[str] = LEVELS) -> ModelPackage:
    """First level that was saved. There is no untrained fallback: without a model nothing is scored."""
    for level in levels:
        try:
            package = load_package(spark, f"{folder}/{level}")
        except AnalysisException:
            continue
        package.level = level
        return package
    raise FileNotFoundError(f"no fitted model below {folder}")


def report_rows(spark: SparkSession, packages: Iterable[ModelPackage]) -> DataFrame:
    rows = [(p.level, p.kind, p.threshold, len(p.features)) for p in packages]
    return spark.createDataFrame(rows, "level string, kind string, threshold double, n_features int")


@dataclass
class Detector:
    """Supervised models, each behind the scaler it was fitted with, and a forest, which are used and replaced together."""

    supervised: list[ModelPackage]
    forest: IsolationForest
    level: str
    version: int


_SAVED = "level string, version long, supervised int"


def saved_detectors(spark: SparkSession, folder: str) -> DataFrame:
    """Levels and versions that have been saved as a whole."""
    try:
        return spark.read.option("recursiveFileLookup", "true").schema(_SAVED).json(f"{folder}/saved")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SAVED)


def save_detector(spark: SparkSession, detector: Detector, folder: str) -> None:
    """Saves the parts and, last, the row that makes them count. A version is written once; an attempt that failed is overwritten."""
    if detector.level not in LEVELS or not detector.supervised:
        raise ValueError(f"a detector needs a supervised model and one of the levels {LEVELS}")
    name = f"{detector.level}-v{detector.version}"
    if not saved_detectors(spark, folder).filter((F.col("level") == detector.level) & (F.col("version") == detector.version)).isEmpty():
        raise ValueError(f"{name} is saved already")
    for i, package in enumerate(detector.supervised):
        save_package(spark, package, f"{folder}/{name}/supervised-{i}")
    detector.forest.save(spark, f"{folder}/{name}/forest")
    row = spark.createDataFrame([(detector.level, detector.version, len(detector.supervised))], _SAVED)
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/saved/{name}")


def newest_detector(spark: SparkSession, folder: str, levels: Sequence[str] = LEVELS) -> tuple[str, int]:
    """Level and version of the last detector of the best level that has one."""
    last = {r["level"]: r["version"] for r in saved_detectors(spark, folder).groupBy("level").agg(F.max("version").alias("version")).collect()}
    for level in levels:
        if level in last:
            return level, last[level]
    raise FileNotFoundError(f"no detector below {folder}")


def load_detector(spark: SparkSession, folder: str, level: str, version: int) -> Detector:
    found = saved_detectors(spark, folder).filter((F.col("level") == level) & (F.col("version") == version)).first()
    if found is None:
        raise FileNotFoundError(f"no detector {level}-v{version} below {folder}")
    path = f"{folder}/{level}-v{version}"
    supervised = [load_package(spark, f"{path}/supervised-{i}") for i in range(found["supervised"])]
    return Detector(supervised, IsolationForest.load(spark, f"{path}/forest"), level, version)
