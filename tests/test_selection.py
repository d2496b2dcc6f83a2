import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floodgauge.functions.expressions import digamma
from floodgauge.ml import selection

EULER = 0.57721566490153286


def psi(n):
    return -EULER + math.fsum(1 / j for j in range(1, n))


def plain(xs, labels, k=3):
    """Distances of all pairs."""
    xs = np.array(xs, dtype=float)
    sizes = {y: labels.count(y) for y in set(labels)}
    kept = [i for i, y in enumerate(labels) if sizes[y] > 1 and math.isfinite(xs[i])]
    sizes = {y: sum(labels[i] == y for i in kept) for y in set(labels)}
    kept = [i for i in kept if sizes[labels[i]] > 1]
    if not kept:
        return 0.0
    total = 0.0
    for i in kept:
        away = {j: abs(xs[j] - xs[i]) for j in kept if j != i}
        own = sorted(d for j, d in away.items() if labels[j] == labels[i])
        radius = own[min(k, len(own)) - 1]
        radius += selection.SAME * max(abs(xs[i]), radius) if radius else 0.0
        total += psi(sum(d <= radius for d in own)) - psi(sizes[labels[i]]) - psi(sum(d <= radius for d in away.values()))
    return max(0.0, psi(len(kept)) + total / len(kept))


def scores(spark, rows, names=("a",)):
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", label string")
    return {r["feature"]: r["score"] for r in selection.neighbour_information(df, names, "label").collect()}


def test_digamma(spark):
    wanted = [1, 2, 3, 10, 1000, 100_000]
    got = spark.createDataFrame([(n,) for n in wanted], "n long").select("n", digamma(F.col("n")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(psi(r["n"]), rel=1e-12, abs=1e-13) for r in got)


def test_neighbours_equal_brute_force(spark):
    """Values without ties, with many ties, and one that says nothing; a class with a third of the rows and small ones."""
    rng = random.Random(7)
    labels = ["big"] * 700 + ["middle"] * 1280 + ["small"] * 15 + ["two"] * 2 + [None] * 2 + ["one"]
    shift = {"big": 0.0, "middle": 1.0, "small": 4.0}
    columns = {
        "smooth": [rng.gauss(shift.get(y, 2.0), 1) for y in labels],
        "steps": [float(round(rng.gauss(shift.get(y, 2.0), 1) * 2)) for y in labels],
        "nothing": [rng.random() for _ in labels],
        "same": [5.0 for _ in labels],
    }
    rows = [(*values, y) for *values, y in zip(*columns.values(), labels)]
    got = scores(spark, rows, tuple(columns))
    for name, values in columns.items():
        assert got[name] == pytest.approx(plain(values, labels), abs=1e-9), name
    assert got["smooth"] > got["nothing"] + 0.1 and got["same"] < 1e-3


def test_neighbours_across_pieces(spark):
    """Far fewer rows than neighbours in most pieces."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rng = random.Random(3)
        for size in (2, 5, 9, 40):
            rows = [(float(rng.randrange(30)), rng.choice("xy")) for _ in range(size)]
            assert scores(spark, rows)["a"] == pytest.approx(plain(*map(list, zip(*rows))), abs=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_intervals_across_many_pieces(spark, monkeypatch):
    """Pieces by the number of points: classes that are rare in all of them, intervals over several, and values that repeat."""
    monkeypatch.setattr(selection, "PIECE_POINTS", 15)
    rng = random.Random(11)
    labels = ["dense"] * 250 + ["rare"] * 6 + ["two"] * 2 + ["far"] * 4 + [None] * 3
    rows = [(rng.gauss(0, 1) if y != "far" else 50 + rng.random(), float(rng.randrange(40)), y) for y in labels]
    got = scores(spark, rows, ("a", "b"))
    for i, c in enumerate("ab"):
        assert got[c] == pytest.approx(plain([r[i] for r in rows], labels), abs=1e-9), c


def test_a_piece_settles_its_points():
    """Only points near its ends are left to the steps that look at all pieces; each point was sorted and exploded there before."""
    rng = np.random.default_rng(4)
    size = 3000
    labels = [["x", "y", None][i % 3] for i in range(size)]
    xs = rng.normal(size=size)
    columns = {"position": pa.array([0] * size, pa.int32()), "label": pa.array(labels), "x": pa.array(xs), "n": pa.array([1] * size), "of_class": pa.array([size // 3] * size),
               "_slot": pa.array([5] * size, pa.int32())}
    batches = pa.RecordBatch.from_pydict(columns)
    piece, *told = selection._settled(3)(iter([batches.slice(0, 1000), batches.slice(1000)]))
    assert piece.select(["slot", "position", "x", "high", "n"]).to_pylist() == [{"slot": 5, "position": 0, "x": xs.min(), "high": xs.max(), "n": size}]
    found = pa.Table.from_batches(told).to_pylist()
    left = [r for r in found if r["is_open"]]
    assert 0 < len(left) < 60 and len(found) < 80
    total = 0.0
    for i in set(range(size)) - {int(np.flatnonzero(xs == r["x"])[0]) for r in left}:
        away = np.abs(xs - xs[i])
        own = np.sort(away[i % 3 :: 3])
        radius = own[3] * (1 + selection.SAME)
        total += psi(3) - psi(size // 3) - psi(int((away <= radius).sum()) - 1)
    assert piece["settled"][0].as_py() == pytest.approx(total, rel=1e-9)


def test_missing_values_and_empty_tables(spark):
    rows = [(1.0, "x"), (2.0, "x"), (None, "x"), (float("nan"), "y"), (float("inf"), "y"), (1.5, "y"), (-0.0, "y"), (0.0, "y")]
    finite = [(v, y) for v, y in rows if v is not None and math.isfinite(v)]
    assert scores(spark, rows)["a"] == pytest.approx(plain(*map(list, zip(*finite))), abs=1e-12)
    assert scores(spark, []) == {"a": 0.0} and scores(spark, [(1.0, "x"), (2.0, "y")]) == {"a": 0.0}


def test_selection_by_neighbours(spark):
    """A feature whose classes have equal means but different spreads is told by neighbours, not by F."""
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1 if i % 2 else 0.05), rng.random(), rng.random() + i % 2 * 0.5, "xy"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "spread double, nothing double, moved double, label string")
    names = ["spread", "nothing", "moved"]
    assert selection.select_by_anova(df, names, "label", 1) == ["moved"]
    assert selection.select_by_both(df, names, "label", 1, selection.neighbour_information) == ["spread"]
    best = selection.top_features(selection.neighbour_information(df, names, "label"), 2).collect()
    assert [r["feature"] for r in best] == ["spread", "moved"]
