import math
import random

import numpy as np
import pytest

from floodgauge.ml import boosting
from floodgauge.ml.boosting import MISSING, _codes, fit_boosted_trees
from floodgauge.session import checkpointed


def plain(xs, ys, ws, cuts, rounds, depth, rate=0.1, l1=0.0, l2=1.0, least_curvature=1.0):
    """Margins by recursion over the rows of each node, all sums taken anew for each cut."""
    codes = _codes(np.array(xs, dtype=float), [np.array(c) for c in cuts])
    ys, ws, margin = np.array(ys, dtype=float), np.array(ws, dtype=float), np.zeros(len(ys))

    def soft(g):
        return math.copysign(max(abs(g) - l1, 0.0), g)

    def grow(rows, level, g, h, out):
        total = (g[rows].sum(), h[rows].sum())
        out[rows] = -rate * soft(total[0]) / (total[1] + l2)
        best = (1e-12, None)
        if level < depth:
            for f in range(codes.shape[1]):
                for missing_left in (False, True):
                    for cut in range(len(cuts[f])):
                        code = codes[rows, f]
                        left = np.where(code == MISSING, missing_left, code <= cut)
                        parts = [(g[rows[s]].sum(), h[rows[s]].sum()) for s in (left, ~left)]
                        if min(b for _, b in parts) < least_curvature:
                            continue
                        won = 0.5 * (sum(soft(a) ** 2 / (b + l2) for a, b in parts) - soft(total[0]) ** 2 / (total[1] + l2))
                        if won > best[0] * (1 + 1e-9):
                            best = (won, left)
        if best[1] is not None:
            grow(rows[best[1]], level + 1, g, h, out)
            grow(rows[~best[1]], level + 1, g, h, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(ys))
        grow(np.arange(len(ys)), 0, ws * (p - ys), ws * p * (1 - p), out)
        margin += out
    return 1 / (1 + np.exp(-margin))


def table(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), float(rng.randrange(6))
        y = int(a * b + rng.gauss(0, 0.5) > 1)
        rows.append((None if rng.random() < 0.1 else a, float("nan") if rng.random() < 0.05 + 0.2 * y else b, rng.random(), y, 1.0 + i % 3, i))
    return rows


SCHEMA = "a double, b double, c double, y int, w double, id long"


def chances(model, df):
    return {r["id"]: r["score"] for r in model.score(df).collect()}


@pytest.mark.parametrize("options", [{}, {"l1": 0.5, "l2": 3.0, "rate": 0.4, "weighted": True, "positive_weight": 4.0}])
def test_equals_a_plain_booster(spark, options):
    """More rounds than a renewal of margins; missing values in two columns, NULL and NaN."""
    rows = table(240)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    weighted, positive = options.pop("weighted", False), options.pop("positive_weight", 1.0)
    model = fit_boosted_trees(df, ["a", "b", "c"], "y", rounds=12, depth=3, bins=12, weight="w" if weighted else None, positive_weight=positive, **options)
    xs = [[math.nan if v is None else v for v in r[:3]] for r in rows]
    ws = [(r[4] if weighted else 1.0) * (positive if r[3] else 1.0) for r in rows]
    want = plain(xs, [r[3] for r in rows], ws, model.cuts, 12, 3, **options)
    got = chances(model, df)
    assert [got[r[5]] for r in rows] == pytest.approx(list(want), abs=1e-9)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(table(300), SCHEMA)
    fit = lambda d: fit_boosted_trees(d, ["a", "b", "c"], "y", rounds=3, depth=3, rows_share=0.8, columns_share=0.7, key=["id"])
    first, second = fit(df.coalesce(1)), fit(df.repartition(5))
    assert [t.feature for t in first.trees] == [t.feature for t in second.trees]
    a, b = chances(first, df), chances(second, df)
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
    assert len({f for t in first.trees[:1] for f in t.feature if f >= 0}) <= 2


def test_one_class_no_rows_and_wrong_weights(spark):
    df = spark.createDataFrame(table(60), SCHEMA)
    model = fit_boosted_trees(df.filter("y = 0"), ["a", "b"], "y", rounds=2, depth=2)
    assert all(t.feature == [-1] for t in model.trees) and max(chances(model, df).values()) < 0.5
    empty = fit_boosted_trees(df.limit(0), ["a"], "y", rounds=1, depth=2)
    assert set(chances(empty, df).values()) == {0.5}
    unlabelled = df.selectExpr("a", "cast(null as int) y", "w", "id")
    assert set(chances(fit_boosted_trees(unlabelled, ["a"], "y", rounds=1), df).values()) == {0.5}
    with pytest.raises(Exception, match="not positive"):
        fit_boosted_trees(df.selectExpr("a", "y", "0.0 AS w"), ["a"], "y", rounds=1, weight="w")
    with pytest.raises(ValueError):
        fit_boosted_trees(df, [], "y")


def test_rows_are_passed_in_blocks(spark, monkeypatch):
    """A pass hands some blocks to each task, not rows; what a round keeps is let go at the end."""
    rows, counts = spark.range(30_000, numPartitions=3).selectExpr("id", "id % 100 AS a", "cast(id % 100 > 60 AS int) AS y"), []

    def counted(df):
        done = checkpointed(df)
        counts.append(done.count())
        return done

    monkeypatch.setattr(boosting, "checkpointed", counted)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = boosting.fit_boosted_trees(rows, ["a"], "y", rounds=12, depth=1, key=["id"])
    assert len(model.trees) == 12 and len(counts) == 2 and max(counts) <= 6
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert model.score(rows).filter("predicted <> y").isEmpty()


def test_blocks_in_one_task_and_spread_ones_give_the_same_trees(spark, monkeypatch):
    """Small tables are learned by one task without a job for each level; others by one stage for each, whose sums executors add where they are many."""
    df = spark.createDataFrame(table(400), SCHEMA).repartition(5)
    fit = lambda: fit_boosted_trees(df, ["a", "b", "c"], "y", rounds=12, depth=3, rows_share=0.8, columns_share=0.7, key=["id"])
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    found = []
    for name, bytes_held, collected in (("held", 1 << 20, 1 << 20), ("spread", 0, 1 << 20), ("added", 0, 0)):
        monkeypatch.setattr(boosting, "ONE_TASK", bytes_held)
        monkeypatch.setattr(boosting, "COLLECTED", collected)
        spark.sparkContext.setJobGroup(name, name)
        found.append(fit().trees)
        spark.sparkContext.setJobGroup("", "")
    assert jobs("held") < 20 < 36 <= jobs("spread")
    for trees in found[1:]:
        assert [(t.feature, t.cut, t.missing_left, t.left) for t in trees] == [(t.feature, t.cut, t.missing_left, t.left) for t in found[0]]
        assert [v for t in trees for v in t.value] == pytest.approx([v for t in found[0] for v in t.value], abs=1e-9)


def test_blocks_do_not_follow_the_batches(spark, monkeypatch):
    rows = spark.range(3000, numPartitions=1).selectExpr("id", "id % 10 AS a", "cast(id % 10 > 6 AS int) AS y")
    counts = []
    monkeypatch.setattr(boosting, "checkpointed", lambda df: (done := checkpointed(df), counts.append(done.count()))[0])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        boosting.fit_boosted_trees(rows, ["a"], "y", rounds=1, depth=1, key=["id"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert counts == [1]
