"""Isolation forest (Liu, Ting and Zhou, 2008).

A forest needs a fixed number of sampled rows per tree, however large the table is: one pass keeps
a hashed share of the rows as a pool, trees are grown in parallel from samples of it, and the small
forest is sent to all tasks for scoring.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.functions.expressions import row_hash
from floodgauge.operators.ordered import exact_percentiles
from floodgauge.session import checkpointed

EULER_GAMMA = 0.5772156649015329
DEFAULT_SAMPLES = 256
# A sample of a tree is one task's work; a larger one is refused rather than cut down.
SAMPLE_LIMIT = 1_000_000
TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"
)


def average_path(n: float) -> float:
    """Mean depth at which a search in a tree of n rows ends without a hit."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


@dataclass
class IsolationForest:
    """Fitted forest; lower decision values are more anomalous, below zero is an anomaly."""

    columns: list[str]
    trees: list[dict]
    samples: int
    offset: float = -0.5

    def _normality(self, spark: SparkSession, *columns: Column) -> Column:
        """Negative anomaly score in [-1, 0)."""
        trees = [{k: np.asarray(t[k]) for k in ("feature", "threshold", "left", "right", "depth")} for t in self.trees]
        forest = spark.sparkContext.broadcast(trees)
        usual = average_path(self.samples) or 1.0

        def score(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(dtype=float) for v in values])
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for t in forest.value:
                node = np.zeros(len(x), dtype=np.int64)
                while True:
                    feature = t["feature"][node]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    goes_left = x[rows, np.where(inner, feature, 0)] < t["threshold"][node]
                    node = np.where(inner, np.where(goes_left, t["left"][node], t["right"][node]), node)
                total += t["depth"][node]
            return pd.Series(-np.power(2.0, -total / (len(forest.value) * usual)))

        return F.pandas_udf(score, "double")(*columns)

    def score(self, df: DataFrame, decision: str = "decision", predicted: str = "predicted") -> DataFrame:
        """Adds the decision value and 1 for anomalies."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing or not self.trees:
            raise ValueError(f"forest cannot score this table: no trees or missing columns {missing}")
        value = self._normality(df.sparkSession, *[F.col(f"`{c}`").cast("double") for c in self.columns])
        return df.withColumn(decision, value - F.lit(self.offset)).withColumn(
            predicted, (F.col(decision) < 0).cast("int")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(json.dumps({"columns": self.columns, "samples": self.samples, "offset": self.offset}), t["tree"],
                 json.dumps({k: list(map(float, t[k])) for k in ("feature", "threshold", "left", "right", "depth")}))
                for t in self.trees]
        spark.createDataFrame(rows, "model string, tree int, nodes string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        rows = spark.read.parquet(path).orderBy("tree").collect()
        head = json.loads(rows[0]["model"])
        trees = []
        for r in rows:
            nodes = json.loads(r["nodes"])
            whole = {k: [int(v) for v in nodes[k]] for k in ("feature", "left", "right")}
            trees.append({"tree": r["tree"], **nodes, **whole})
        return cls(head["columns"], trees, head["samples"], head["offset"])


def _grow(x: np.ndarray, rng: np.random.Generator, features: np.ndarray, limit: int) -> dict:
    """One tree as parallel arrays; leaves have feature -1 and their expected depth."""
    out: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "depth": []}

    def add() -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("depth", 0.0)):
            out[k].append(v)
        return len(out["feature"]) - 1

    todo = [(add(), np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        held = x[rows][:, features]
        low, high = (held.min(axis=0), held.max(axis=0)) if len(rows) else (None, None)
        open_features = np.flatnonzero(high > low) if len(rows) > 1 and depth < limit else []
        if len(open_features) == 0:
            out["depth"][node] = depth + average_path(len(rows))
            continue
        pick = rng.choice(open_features)
        cut = rng.uniform(low[pick], high[pick])
        if cut <= low[pick]:
            cut = np.nextafter(low[pick], high[pick])
        goes_left = held[:, pick] < cut
        out["feature"][node], out["threshold"][node] = int(features[pick]), float(cut)
        for side, name in ((goes_left, "left"), (~goes_left, "right")):
            child = add()
            out[name][node] = child
            todo.append((child, rows[side], depth + 1))
    return out


def fit_isolation_forest(
    df: DataFrame, columns: Sequence[str], n_trees: int = 100, max_samples: int | float = DEFAULT_SAMPLES,
    contamination: float | None = 0.1, max_features: float = 1.0, bootstrap: bool = False,
    key: Sequence[str] | None = None, seed: int = 42,
) -> IsolationForest:
    """Trees are grown on ``max_samples`` rows each (a count, or a share of the table).

    ``contamination`` is the share of training rows that shall be anomalies; None keeps the
    natural limit. ``key`` names columns that identify a row, for a repeatable sample.
    """
    columns = list(columns)
    total = df.count()
    samples = int(max_samples * total) if isinstance(max_samples, float) else min(int(max_samples), total)
    if not 1 <= samples <= SAMPLE_LIMIT:
        raise ValueError(f"{samples} rows per tree; choose a count from 1 to {SAMPLE_LIMIT}")
    values = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    hashed = df.select(row_hash(list(key) if key else df.columns, seed).alias("_h"), *values)
    # The pool: enough rows for nearly independent samples, or the whole table when it is small.
    share = min(1.0, 4.0 * samples * n_trees / total) if samples * 4 < total else 1.0
    columns_x = [f"x{i}" for i in range(len(columns))]

    def copies(rows: DataFrame) -> DataFrame:
        """Equal rows are counted and numbered, so that the draws do not depend on partitions."""
        counted = rows.groupBy("_h", *columns_x).agg(F.count(F.lit(1)).alias("_n"))
        return checkpointed(counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n"))

    if share < 1.0:
        # The second is a hash of its own: a split by the same key and seed has left only a range of ``_h``.
        heads = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double"), F.pmod(F.xxhash64("_h", F.lit("pool")), F.lit(1 << 32)).cast("double")
        for head in heads:
            pool = copies(hashed.filter(head / float(1 << 32) < share))
            if pool.count() >= 0.75 * share * total:  # enough for the sample of each tree
                break
        else:  # many equal rows share a hash and are in or out together
            share = 1.0
    if share == 1.0:
        pool = copies(hashed)
    row = ("_h", "_copy", *columns_x)
    chance = min(1.0, 1.5 * samples / max(1.0, share * total) + 32.0 / max(1.0, share * total))
    if chance > 0.9:
        tree_ids = F.sequence(F.lit(0), F.lit(n_trees - 1))
    else:  # each row draws its few trees itself: the work is linear in the drawn rows
        draws = max(1, math.ceil(-n_trees * math.log1p(-chance)))
        number = lambda d: F.pmod(F.xxhash64(*row, d, F.lit(seed)), F.lit(n_trees)).cast("int")
        tree_ids = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(draws)), number))
    drawn = pool.withColumn("tree", F.explode(tree_ids)).withColumn("_r", F.xxhash64(*row, "tree", F.lit(seed)))
    # Ranked inside one tree: at most about twice the sample size per tree.
    ranked = drawn.withColumn("_rank", F.row_number().over(W.partitionBy("tree").orderBy("_r", *row))).filter(
        F.col("_rank") <= samples
    )
    names = [f"x{i}" for i in range(len(columns))]
    n_features = max(1, int(max_features * len(columns)))
    limit = max(1, math.ceil(math.log2(max(samples, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("_rank")[names].to_numpy(dtype=float)
        if bootstrap:
            x = x[rng.integers(0, len(x), len(x))]
        chosen = np.sort(rng.choice(len(names), n_features, replace=False))
        grown = _grow(x, rng, chosen, limit)
        return pd.DataFrame([{"tree": tree, **grown}])

    rows = ranked.select("tree", "_rank", *names).groupBy("tree").applyInPandas(grow, TREE_SCHEMA)
    trees = [r.asDict() for r in rows.orderBy("tree").collect()]
    forest = IsolationForest(columns, trees, samples)
    if contamination is not None:
        normality = df.select(forest._normality(df.sparkSession, *[F.col(f"`{c}`").cast("double") for c in columns]).alias("s"))
        scores = checkpointed(normality)
        forest.offset = exact_percentiles(scores, {"s": [contamination]})["s"][contamination]
    return forest
