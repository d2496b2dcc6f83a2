import os
import tempfile

import pytest
from pyspark.sql import functions as F

from floodgauge.sources.keyed_state import GROWTH, KeyedState

SCHEMA = "k string, v long"


@pytest.fixture
def state(spark):
    return KeyedState(spark, tempfile.mkdtemp(prefix="run-") + "/state", SCHEMA, ["k"])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(df):
    return {r["k"]: r["v"] for r in df.collect()}


def runs(state, version=None):
    found = {r["version"]: [(x["path"], x["rows"]) for x in r["runs"]] for r in state.manifests().collect()}
    return found[max(found) if version is None else version]


def test_empty_state(spark, state):
    assert state.last_version() is None and content(state.read()) == {}
    assert state.write(rows(spark), 0) == 0
    assert state.last_version() == 0 and runs(state) == [] and content(state.read()) == {}
    assert state.keep_last(1) == 1  # the folder of the empty run


def test_changes_replace_and_older_versions_stay(spark, state):
    state.write(rows(spark, ("a", 1), ("b", 1), (None, 1)), 0)
    state.write(rows(spark, (None, 2), ("c", 2)), 3)
    state.write(rows(spark, ("a", None)), 4)
    assert content(state.read()) == {"a": None, "b": 1, "c": 2, None: 2}
    assert content(state.read(3)) == content(state.read(3)) == {"a": 1, "b": 1, "c": 2, None: 2}
    assert content(state.read(2)) == {"a": 1, "b": 1, None: 1}
    assert content(state.read(only=rows(spark, (None, 0), ("c", 0), ("c", 0), ("x", 0)))) == {None: 2, "c": 2}


def test_order_decides_within_a_batch_and_ties_are_stable(spark, state):
    changes = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 7, 1), ("b", 8, 1), ("c", 1, None), ("c", 0, 0)], "k string, v int, at int")
    state.write(changes, 0, [F.col("at")])
    assert content(state.read()) == {"a": 1, "b": 8, "c": 0}


def test_removed_keys_are_hidden_and_leave_with_a_merge(spark, state):
    state.write(rows(spark, *[(f"k{i}", i) for i in range(20)]), 0)
    state.write(rows(spark, ("k3", 0), ("k4", 0)), 1, removed=F.col("k") == "k3")
    assert "k3" not in content(state.read()) and content(state.read())["k4"] == 0
    assert [n for _, n in runs(state)] == [20, 2]
    state.write(rows(spark, *[(f"n{i}", i) for i in range(10)]), 2)
    assert [n for _, n in runs(state)] == [29]
    assert "k3" not in content(state.read()) and "k3" in content(state.read(0))
    state.write(rows(spark, ("k3", 9)), 3)
    assert content(state.read())["k3"] == 9


def test_expired_rows_leave_only_when_the_base_is_merged(spark, state):
    state.write(rows(spark, *[(f"k{i}", i) for i in range(20)]), 0)
    state.write(rows(spark, ("k5", 0)), 1, expired=F.col("v") == 0)
    state.write(rows(spark, ("k6", 0)), 2, expired=F.col("v") == 0)
    kept = content(state.read())
    assert kept["k5"] == 0 and kept["k6"] == 0  # hiding the older rows
    state.write(rows(spark, *[(f"k{i}", 7) for i in range(10, 19)]), 3, expired=F.col("v") == 0)
    assert {"k0", "k5", "k6"}.isdisjoint(content(state.read())) and content(state.read())["k10"] == 7


def test_written_rows_follow_the_changes(spark, state):
    """Many small batches on a long base: the base is not rewritten, and there are few runs."""
    base = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    assert state.write(base, 0) == 20_000
    written = 0
    for version in range(1, 17):
        written += state.write(rows(spark, *[(str(i * version % 500), -version) for i in range(10)]), version)
    lengths = [n for _, n in runs(state)]
    assert runs(state)[0] == ("runs/v0", 20_000)
    assert all(a > GROWTH * b for a, b in zip(lengths, lengths[1:])) and len(lengths) <= 6
    assert written <= 160 * 5
    want = {str(i): i for i in range(20_000)}
    for version in range(1, 17):
        want.update({str(i * version % 500): -version for i in range(10)})
    assert content(state.read()) == want


def test_a_batch_may_run_again(spark, state):
    state.write(rows(spark, ("a", 1), ("b", 1)), 0)
    state.write(rows(spark, ("b", 2)), 1)
    before = runs(state)
    assert state.write(rows(spark, ("b", 2)), 1) == 0 and runs(state) == before
    with pytest.raises(ValueError, match="older than the last one"):
        KeyedState(spark, state.folder, SCHEMA, ["k"]).write(rows(spark, ("b", 2)), -1)
    # Crashes before the manifest: files of a run, whole or half, are there.
    rows(spark, ("zz", 1)).withColumn("_removed", F.lit(False)).write.parquet(f"{state.folder}/runs/v2")
    os.makedirs(f"{state.folder}/log/v2/_temporary/0")
    assert state.last_version() == 1 and content(state.read()) == {"a": 1, "b": 2}
    state.write(rows(spark, ("a", 3)), 2)
    assert content(state.read()) == {"a": 3, "b": 2}


def test_old_versions_and_files_without_one_are_deleted(spark, state):
    for version in range(6):
        state.write(rows(spark, *[(f"k{i}", version) for i in range(8)]), version)
    rows(spark, ("zz", 1)).write.parquet(f"{state.folder}/runs/v9")
    assert state.keep_last(2) > 0
    assert sorted(r["version"] for r in state.manifests().collect()) == [4, 5]
    assert set(os.listdir(f"{state.folder}/runs")) == {p.split("/")[1] for v in (4, 5) for p, _ in runs(state, v)}
    assert content(state.read(4)) == {f"k{i}": 4 for i in range(8)} and content(state.read())["k0"] == 5
    assert state.keep_last(2) == 0
    with pytest.raises(ValueError):
        state.keep_last(0)


def test_other_columns_are_refused(spark, state):
    state.write(rows(spark, ("a", 1)), 0)
    with pytest.raises(ValueError, match="state has the columns"):
        KeyedState(spark, state.folder, "k string, w long", ["k"]).read()
    with pytest.raises(ValueError, match="do not make"):
        KeyedState(spark, state.folder, SCHEMA, ["x"])


def test_the_base_is_not_shuffled_by_a_read(spark, state):
    state.write(rows(spark, *[(f"k{i}", i) for i in range(20)]), 0)
    state.write(rows(spark, ("k1", 0)), 1)
    plan = state.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
