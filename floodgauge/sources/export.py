"""Writers: split tables with metadata, reports, keyed state snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def describe_export(
    df: DataFrame, dataset: str, features: Sequence[str], label: str, split: str = "split"
) -> DataFrame:
    """Metadata of a prepared table: one row with counts per split and class."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.sum((F.col(label) == 0).cast("long")).alias("normal_samples"),
        F.sum((F.col(label) != 0).cast("long")).alias("attack_samples"),
        F.avg(F.col(label).cast("double")).alias("attack_ratio"),
        *[
            F.sum((F.col(split) == s).cast("long")).alias(f"{s}_samples")
            for s in ("train", "val", "test")
        ],
    )
    return counts.select(
        F.lit(dataset).alias("dataset"),
        "*",
        F.lit(len(features)).alias("n_features"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
    )


def export_prepared(
    df: DataFrame, path: str, dataset: str, features: Sequence[str], label: str, split: str = "split"
) -> None:
    """``<path>/data`` partitioned by split, and ``<path>/metadata`` with one row."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    describe_export(written, dataset, features, label, split).write.mode("overwrite").json(f"{path}/metadata")


def write_report(metrics: DataFrame, path: str, kind: str = "json") -> None:
    metrics.write.mode("overwrite").format(kind).save(path)


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """Last completed keyed state, or the last one up to ``version``; None when there is none."""
    try:
        marks = spark.read.option("recursiveFileLookup", "true").schema("version long").json(f"{folder}/versions")
    except AnalysisException:
        return None
    wanted = marks.filter(F.col("version") <= version) if version is not None else marks
    last = wanted.agg(F.max("version")).first()[0]
    return None if last is None else spark.read.parquet(f"{folder}/state/version={last}")


def write_snapshot(state: DataFrame, folder: str, version: int, keep_key: str, partitions: int) -> None:
    """A complete state table under its own version; the version file is written last.

    Rewriting a version after a failed attempt gives the same table, so replays are harmless.
    """
    target = f"{folder}/state/version={version}"
    state.repartition(partitions, keep_key).write.mode("overwrite").parquet(target)
    mark = state.sparkSession.range(1).select(F.lit(version).cast("long").alias("version"))
    mark.write.mode("overwrite").json(f"{folder}/versions/v{version}")


def valid_now(state: DataFrame, now, ttl_seconds) -> DataFrame:
    """Entries whose time to live has not run out at ``now``."""
    age = F.unix_micros(now) - F.unix_micros(F.col("last_seen"))
    return state.filter(age < ttl_seconds * 1_000_000)
