"""Session building and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

# A table is broadcast only after its row count was checked against this bound.
BROADCAST_ROW_LIMIT = 200_000


def get_session(app: str = "floodgauge", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    A private folder is made only for a local master, where driver and executors are one machine.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="run-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path below the shared folder, unique per call."""
    return os.path.join(shared_folder(spark), f"{name}-{os.urandom(8).hex()}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of an executor and are never recomputed."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Spreads a scan that has fewer tasks than there are cores, for work that is heavy per row.

    Meant for plain scans, whose number of tasks is known without running anything. Tables of many
    files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys come from the left table."""
    renamed = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(renamed)
    condition = [left[f"`{k}`"].eqNullSafe(other[f"`{r}`"]) for k, r in renamed.items()]
    return left.join(other, condition, how).drop(*renamed.values())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint when the table holds at most ``limit`` rows, otherwise the plain table.

    The count stops after ``limit + 1`` rows. Without the hint the join shuffles and the adaptive
    skew join splits hot keys.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
