"""Detection on a stream with models that are replaced while it runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.ml.registry import Detector, load_detector, newest_detector
from floodgauge.plans.live_detection import detect_flows

_CHOICE = "level string, version long"


class LiveDetection:
    """``foreachBatch`` function: threats of the flows of a micro-batch below ``folder``, as ``threats/batch=<id>``.

    Each batch takes the newest detector of the best level saved below ``models`` at that time. The choice is written before the batch is scored, so a batch
    that runs again, after a crash at any point, takes the same detector and overwrites its own rows, although a newer one may have come. Without any detector a batch fails; nothing is scored by
    an unfitted model. ``options`` go to ``detect_flows``.
    """

    def __init__(self, models: str, folder: str, **options):
        self.models, self.folder, self.options = models, folder, options
        self._held: Detector | None = None

    def _choice(self, spark: SparkSession, batch_id: int) -> tuple[str, int]:
        path = f"{self.folder}/choices/batch={batch_id}"
        try:
            made = spark.read.schema(_CHOICE).json(path).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            made = None
        if made is not None:
            return made["level"], made["version"]
        found = newest_detector(spark, self.models)
        spark.createDataFrame([found], _CHOICE).coalesce(1).write.mode("overwrite").json(path)
        return found

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        level, version = self._choice(spark, batch_id)
        if self._held is None or (self._held.level, self._held.version) != (level, version):
            self._held = load_detector(spark, self.models, level, version)
        found = detect_flows(batch, self._held.supervised, self._held.forest, **self.options)
        marked = found.withColumns({"model_level": F.lit(level), "model_version": F.lit(version).cast("long")})
        marked.write.mode("overwrite").parquet(f"{self.folder}/threats/batch={batch_id}")
