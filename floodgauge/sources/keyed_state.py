"""Keyed state as a table of runs: a base and the changes of later batches.

Each batch adds one run with the rows it has changed. A run is merged with the older ones beside it as soon as they are at most ``GROWTH`` times as
long, so the lengths of the runs fall geometrically: there are about as many as the logarithm of the number of keys, a row is rewritten about as often, and a small
batch never rewrites a long base. Which runs make up a version is said by a one-row manifest, written last; a version without one does not exist.

* Reading merges: rows of the newer runs replace those of the base. The base is not shuffled while the newer runs are short enough to be broadcast, which
  their recorded lengths tell.
* A removed key leaves a row with ``_removed`` set, until a merge reaches the base.
* A batch that runs again after a crash at any point overwrites its own files with the same rows; one that had been committed changes nothing.
* ``keep_last`` drops old manifests first and then the runs that no manifest names, also those left by batches that never ended.

A NULL key is a key like any other. Of several rows of a key in one batch the greatest by ``order`` wins, ties by the greatest of the other columns. An empty batch makes a version
without a new run. Columns of the state must be comparable (no maps) and may not be called ``_removed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.session import BROADCAST_ROW_LIMIT, broadcast_if_small, null_safe_join

REMOVED = "_removed"
#: A run is merged with an older one that has at most so many times its rows.
GROWTH = 2
_MANIFEST = "version long, schema string, runs array<struct<path: string, rows: long>>"


def _newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The greatest row of each key. Partial maxima are taken before the shuffle, so a hot key does not meet in one task."""
    others = [c for c in rows.columns if c not in keys and not c.startswith("_order_")]
    ranked = F.struct(*[c.alias(f"_order_{i}") for i, c in enumerate(order)], *others)
    return rows.groupBy(*keys).agg(F.max(ranked).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in others])


class KeyedState:
    """State table below ``folder``, one row per key.

    ``schema`` is that of its rows, keys included, as a DDL string. Only one writer may be at work at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str]):
        self.spark, self.folder, self.keys = spark, folder, list(keys)
        empty = spark.createDataFrame([], schema)
        self.schema, self.columns = schema, empty.columns
        self._typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in empty.schema]
        missing = [k for k in self.keys if k not in self.columns]
        if missing or not self.keys or REMOVED in self.columns:
            raise ValueError(f"keys {self.keys} and columns {self.columns} do not make a keyed state")
        self._stored = f"{schema}, {REMOVED} boolean"

    # -- manifests

    def manifests(self) -> DataFrame:
        """Committed versions, their runs from the oldest to the newest, and the rows of each run."""
        try:
            return self.spark.read.option("recursiveFileLookup", "true").schema(_MANIFEST).json(f"{self.folder}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def _manifest(self, version: int | None = None):
        found = self.manifests()
        if version is not None:
            found = found.filter(F.col("version") <= version)
        last = found.orderBy(F.col("version").desc()).first()
        if last is not None and last["schema"] != self.schema:
            raise ValueError(f"state has the columns {last['schema']}, not {self.schema}")
        return last

    def last_version(self) -> int | None:
        last = self._manifest()
        return None if last is None else last["version"]

    # -- reading

    def _run(self, path: str) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(f"{self.folder}/{path}")

    def _merged(self, runs: Sequence, only: DataFrame | None = None) -> DataFrame:
        """The newest row of each key over the runs, removed ones included; ``only`` holds the keys that are wanted."""
        tables = [self._run(r["path"]) for r in runs]
        if only is not None:
            tables = [null_safe_join(t, only, self.keys, "left_semi") for t in tables]
        base, newer = tables[0], None
        for age, rows in enumerate(tables[1:]):
            marked = rows.withColumn("_age", F.lit(age))
            newer = marked if newer is None else newer.unionByName(marked)
        if newer is None:
            return base
        if len(tables) > 2:
            newer = _newest(newer, self.keys, [F.col("_age")])
        newer = newer.drop("_age")
        replaced = newer.select(*self.keys)
        if sum(r["rows"] for r in runs[1:]) <= BROADCAST_ROW_LIMIT:
            replaced = F.broadcast(replaced)
        return null_safe_join(base, replaced, self.keys, "left_anti").unionByName(newer)

    def read(self, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The last state, or the last one up to ``version``; empty where there is none.

        With ``only``, a table that has the key columns, just the rows of its keys: each run is filtered by them before any merge.
        """
        last = self._manifest(version)
        if last is None or not last["runs"]:
            return self.spark.createDataFrame([], self.schema)
        if only is not None:
            only = broadcast_if_small(only.select(*self.keys).distinct())
        return self._merged(last["runs"], only).filter(~F.col(REMOVED)).select(*self.columns)

    # -- writing

    def write(
        self, changes: DataFrame, version: int, order: Sequence[Column] = (), removed: Column | None = None, expired: Column | None = None,
    ) -> int:
        """Commits the changes of one batch as ``version`` and returns the rows written.

        ``removed`` marks changes that take their key out. Rows for which ``expired`` holds may be left out, and are as soon as a merge reaches the base;
        until then readers filter them, as they must for the moment of reading anyway.
        """
        last = self._manifest()
        if last is not None and last["version"] >= version:
            if self.manifests().filter(F.col("version") == version).isEmpty():
                raise ValueError(f"version {version} is older than the last one, {last['version']}, and was never written")
            return 0
        runs = list(last["runs"]) if last is not None else []
        gone = F.coalesce(removed, F.lit(False)) if removed is not None else F.lit(False)
        marked = changes.select(*self._typed, gone.alias(REMOVED), *[c.alias(f"_order_{i}") for i, c in enumerate(order)])
        added = self._store(_newest(marked, self.keys, [F.col(f"_order_{i}") for i in range(len(order))]), f"runs/v{version}")
        written = added["rows"]
        if added["rows"]:
            runs.append(added)
            runs, rewritten = self._compacted(runs, version, expired)
            written += rewritten
        row = [(version, self.schema, [(r["path"], r["rows"]) for r in runs])]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/log/v{version}")
        return written

    def _store(self, rows: DataFrame, path: str) -> dict:
        """Writes a run; adaptive execution sizes its files, and the footers tell its length."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{path}")
        return {"path": path, "rows": self._run(path).count()}

    def _compacted(self, runs: list, version: int, expired: Column | None) -> tuple[list, int]:
        first, total = len(runs) - 1, runs[-1]["rows"]
        while first and runs[first - 1]["rows"] <= GROWTH * total:
            first -= 1
            total += runs[first]["rows"]
        if first == len(runs) - 1:
            return runs, 0
        rows = self._merged(runs[first:])
        if first == 0:  # nothing older is left that a removed row would have to hide
            rows = rows.filter(~F.col(REMOVED))
            if expired is not None:
                rows = rows.filter(~F.coalesce(expired, F.lit(False)))
        merged = self._store(rows, f"runs/v{version}-merged")
        return runs[:first] + ([merged] if merged["rows"] else []), merged["rows"]

    # -- retention

    def keep_last(self, versions: int) -> int:
        """Forgets all but the last ``versions`` versions and deletes the files nobody needs; returns the number of folders deleted.

        To be called by the writer between two batches. Readers of a forgotten version fail.
        """
        if versions < 1:
            raise ValueError("at least one version stays")
        known = sorted(self.manifests().select("version", "runs.path").collect())
        if not known:
            return 0
        kept = known[-versions:]
        needed = {path for _, paths in kept for path in paths}
        old = [f"log/v{version}" for version, _ in known[:-versions]]
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.folder)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        listed = files.listStatus(hadoop.Path(root, "runs")) if files.exists(hadoop.Path(root, "runs")) else []
        unused = sorted({f"runs/{s.getPath().getName()}" for s in listed} - needed)
        for path in [*old, *unused]:
            files.delete(hadoop.Path(root, path), True)
        return len(old) + len(unused)
