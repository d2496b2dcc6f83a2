import tempfile

import pytest
from pyspark.sql import functions as F

from floodgauge.ml import registry, scaling, selection, training
from floodgauge.ml.isolation_forest import IsolationForest, average_path, fit_isolation_forest
from floodgauge.operators.features import FLOW_FEATURES, flow_features
from floodgauge.operators.sampling import stratified_split
from floodgauge.plans.live_detection import detect_flows, plan_mitigation
from floodgauge.plans.prepare_dataset import prepare_dataset, write_prepared
from floodgauge.plans.train_and_select import train_and_select


@pytest.fixture(scope="module")
def points(spark):
    """A cloud around zero and a few far points."""
    far = F.col("id") % 50 == 0
    noise = lambda seed: F.randn(seed)
    return spark.range(4000).select(
        "id", F.when(far, 9.0).otherwise(noise(1)).alias("a"), F.when(far, -9.0).otherwise(noise(2)).alias("b"),
        far.cast("int").alias("y")).cache()


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1 and average_path(256) == pytest.approx(10.2448, abs=1e-3)


@pytest.mark.parametrize("samples", [128, 0.5])
def test_isolation_forest_finds_far_points(spark, points, samples):
    forest = fit_isolation_forest(points, ["a", "b"], n_trees=40, max_samples=samples, contamination=0.05, key=["id"])
    assert len(forest.trees) == 40
    rows = forest.score(points).select("y", "predicted", "decision").collect()
    assert sum(r.predicted for r in rows) == pytest.approx(200, abs=3)
    assert all(r.predicted == 1 for r in rows if r.y == 1)
    again = fit_isolation_forest(points.repartition(5), ["a", "b"], n_trees=40, max_samples=samples, contamination=0.05, key=["id"])
    assert again.offset == pytest.approx(forest.offset, abs=0.05)


def test_isolation_forest_options_and_storage(spark, points):
    forest = fit_isolation_forest(points, ["a", "b"], n_trees=5, max_features=0.5, bootstrap=True, contamination=None, key=["id"])
    assert forest.offset == -0.5 and all(len({f for f in t["feature"] if f >= 0}) <= 1 for t in forest.trees)
    path = tempfile.mkdtemp(prefix="run-")
    forest.save(spark, path)
    loaded = IsolationForest.load(spark, path)
    a = [r.decision for r in forest.score(points).orderBy("id").collect()]
    assert a == [r.decision for r in loaded.score(points).orderBy("id").collect()]
    with pytest.raises(ValueError):
        loaded.score(points.drop("a"))


def test_anomaly_training_uses_benign_rows(spark, points):
    split = stratified_split(points, "y", 0.2, key=["id"])
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    _, table = training.train_anomaly_detector(train, test, ["a", "b"], "y", n_trees=30, contamination=0.05, key=["id"])
    assert table.first().auc_roc > 0.99 and table.first().recall == 1.0


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "a double, k double")
    for fit, expect in ((scaling.fit_standard, 0.0), (scaling.fit_min_max, 0.0), (scaling.fit_robust, 0.0)):
        rows = fit(df, ["a", "k"]).apply(df).collect()
        assert {r.k for r in rows} == {expect}
    assert [r.a for r in scaling.fit_min_max(df, ["a"]).apply(df).collect()] == [0.0, 0.125, 0.375, 1.0]
    assert [r.a for r in scaling.fit_robust(df, ["a"]).apply(df).collect()][0] == pytest.approx((1 - 3) / (5.25 - 1.75))
    with pytest.raises(ValueError):
        scaling.fit_standard(df, ["a"]).apply(df.drop("a"))


def test_quantile_normal(spark):
    df = spark.range(1001).select((F.col("id") * F.col("id")).cast("double").alias("a"))
    rows = [r.a for r in scaling.fit_quantile_normal(df, ["a"]).apply(df).orderBy("a").collect()]
    assert rows[500] == pytest.approx(0, abs=0.01) and rows[975] == pytest.approx(1.96, abs=0.05)
    assert rows[0] == pytest.approx(-5.199, abs=0.01) and rows == sorted(rows)


def test_selection(spark, points):
    df = points.withColumn("z", F.rand(3)).withColumn("c", F.lit(1.0))
    assert selection.select_by_anova(df, ["z", "c", "a", "b"], "y", 2) == ["a", "b"]
    assert selection.select_by_both(df, ["z", "a", "b"], "y", 2) == ["a", "b"]


def test_prepare_train_select_store(spark):
    df = spark.range(3000).select(
        F.col("id").cast("double").alias("Flow ID"), (F.col("id") % 10 + F.when(F.col("id") % 3 == 0, 8).otherwise(0)).cast("double").alias("f1"),
        F.when(F.col("id") % 7 == 0, float("inf")).otherwise(F.col("id") % 100).cast("double").alias("f2"), F.lit(4.0).alias("flat"),
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "Syn").otherwise("BENIGN").alias("Label"))
    done = prepare_dataset(df, cap=800, key=("row",), validation=0.1)
    assert done.features == ["f1", "f2"]
    sizes = {(r.split, r.Malicious): r["count"] for r in done.table.groupBy("split", "Malicious").count().collect()}
    assert sizes[("test", 1)] == 160 and sizes[("val", 0)] == 64 and sum(sizes.values()) == 1600
    path = tempfile.mkdtemp(prefix="run-")
    write_prepared(done, path, "demo")
    assert spark.read.json(f"{path}/metadata").first().val_samples == 128
    models = {"random_forest": training.random_forest("Malicious", trees=5, depth=4),
              "logistic_regression": training.logistic("Malicious", rows=1280, iterations=20)}
    package, table = train_and_select(done.table, done.features, "Malicious", models)
    assert table.count() == 2 and table.agg(F.min("auc_roc")).first()[0] > 0.9
    registry.save_package(spark, package, f"{path}/models/simple")
    loaded = registry.load_by_priority(spark, f"{path}/models")
    assert loaded.level == "simple" and loaded.threshold == package.threshold
    test = done.table.filter("split = 'test'")
    assert loaded.score(test).select("row", "score").exceptAll(package.score(test).select("row", "score")).count() == 0
    with pytest.raises(ValueError):
        loaded.score(test.drop("f1"))
    with pytest.raises(FileNotFoundError):
        registry.load_by_priority(spark, f"{path}/none")


def test_live_detection(spark):
    logs = spark.range(600).select(
        F.col("id").alias("flow_id"), F.concat(F.lit("10.0.0."), F.col("id") % 3).alias("src_ip"),
        F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.lit(6).alias("protocol"), F.lit(99).alias("src_port"),
        F.when(F.col("id") % 3 == 0, 53).otherwise(80).alias("dst_port"), F.when(F.col("id") % 3 == 0, 2).otherwise(16).alias("tcp_flags"),
        F.when(F.col("id") % 3 == 0, 90_000).otherwise(500).cast("long").alias("bytes"), F.lit(4).cast("long").alias("packets"), F.lit(2.0).alias("duration"))
    train = flow_features(logs, keep=("flow_id",)).withColumn("y", (F.col("flow_id") % 3 == 0).cast("int"))
    model = training.assembled(FLOW_FEATURES, training.random_forest("y", trees=5, depth=3)).fit(train)
    package = registry.ModelPackage(model, list(FLOW_FEATURES))
    forest = fit_isolation_forest(train, list(FLOW_FEATURES), n_trees=5, key=["flow_id"])
    threats = detect_flows(logs, [package, package], forest)
    rows = threats.filter("detection_method = 'supervised'").collect()
    assert {r.ip for r in rows} == {"10.0.0.0"} and len(rows) == 200
    updates = plan_mitigation(threats.filter("detection_method = 'supervised'")).collect()
    assert {r.action for r in updates} == {"announce", "withdraw"} and {r.ip for r in updates} == {"10.0.0.0"}
    assert sum(r.action == "withdraw" for r in updates) == 1


def test_search_isolation_forest(spark, points):
    best, table = training.search_isolation_forest(points, points, ["a", "b"], "y", {"n_trees": [10], "contamination": [0.02, 0.3], "key": [("id",)]})
    assert table.count() == 2 and table.orderBy(F.desc("f1_score")).first().candidate == 0
    assert best.score(points).filter("predicted = 1").count() < 200


def test_random_draws(spark):
    model = training.boosted_trees("y")
    draws = training.random_draws(model, {"maxDepth": [1, 2, 3], "stepSize": [0.1, 0.2]}, n=4)
    assert len(draws) == 4 and len({tuple(sorted((p.name, v) for p, v in d.items())) for d in draws}) == 4
    assert len(training.random_draws(model, {"maxDepth": [1, 2]}, n=50)) == 2


def test_isolation_forest_does_not_depend_on_partitions(spark, points):
    doubled = points.unionByName(points.filter("id < 50"))
    for samples in (64, 0.9):
        fitted = [
            fit_isolation_forest(doubled.repartition(n), ["a", "b"], n_trees=12, max_samples=samples).trees
            for n in (2, 7)
        ]
        assert fitted[0] == fitted[1]


def test_inverse_normal():
    from statistics import NormalDist

    import numpy as np

    from floodgauge.ml.scaling import inverse_normal

    shares = np.array([1e-7, 0.001, 0.02, 0.0243, 0.3, 0.5, 0.77, 0.98, 0.9999999])
    assert np.allclose(inverse_normal(shares), [NormalDist().inv_cdf(s) for s in shares], rtol=1e-8, atol=1e-9)
    assert np.isnan(inverse_normal(np.array([np.nan])))[0]


def test_isolation_forest_after_a_split_by_the_same_key(spark, points):
    """The split has taken the smallest hashes, in which the pool of a small share of the rows once lay."""
    train = stratified_split(points, "y", 0.2, key=["id"]).filter("split = 'train'")
    forest = fit_isolation_forest(train, ["a", "b"], n_trees=3, max_samples=16, key=["id"])
    assert [t["tree"] for t in forest.trees] == [0, 1, 2]


def test_isolation_forest_of_equal_rows(spark):
    """Copies share one hash: the pool holds all of them or none."""
    same = spark.range(4000).selectExpr("1.0D AS a", "2.0D AS b")
    for seed in range(3):
        assert len(fit_isolation_forest(same, ["a", "b"], n_trees=3, max_samples=16, contamination=None, seed=seed).trees) == 3


def test_model_comparison_trains_whole_models(spark, monkeypatch):
    """The query hands over the operators' own defaults: a hundred trees, a hundred rounds."""
    from floodgauge.plans import model_queries

    rows = spark.range(20).selectExpr("cast(id AS string) AS flow_key", *[f"cast(id AS double) AS {c}" for c in model_queries.FEATURES], "'Syn' AS label", "cast(id % 2 AS int) AS is_attack", "'train' AS split")
    taken = {}

    def compared(train, test, features, label, estimators):
        taken.update(estimators)
        return {}, train.withColumn("training_time", F.lit(0.0))

    monkeypatch.setattr(model_queries, "_split", lambda spark, folder: rows)
    monkeypatch.setattr(training, "train_and_compare", compared)
    model_queries.model_comparison(spark, "")
    forest, boosted, logistic, tree = (taken[n] for n in ("random_forest", "boosted_trees", "logistic_regression", "decision_tree"))
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 10) and (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getSubsamplingRate()) == (100, 6, 1.0)
    assert logistic.getMaxIter() == 1000 and tree.getMaxDepth() == 10


def test_cross_validation_equals_sparks_on_narrow_rows(spark, points, monkeypatch):
    """Same scores and choice as Spark's validator; only features, label and fold are written, and each fold is scored in one pass."""
    from pyspark.ml.tuning import CrossValidator

    from floodgauge.operators.sampling import stratified_folds

    rows = points.withColumn("y", (F.col("a") + F.randn(7) > 0.5).cast("int")).withColumn("text", F.lit("x" * 50)).localCheckpoint()
    written, passes, features = [], [], ["a", "b"]
    keep, score = training.checkpointed, training._f1_scores
    monkeypatch.setattr(training, "checkpointed", lambda df: (written.append(df.columns), keep(df))[1])
    monkeypatch.setattr(training, "_f1_scores", lambda models, held, label: (passes.append((len(models), held.columns)), score(models, held, label))[1])
    model = training.decision_tree("y")
    maps = training.grid(model, {"maxDepth": [1, 4], "minInstancesPerNode": [1, 200]})
    best, table = training.search(rows, features, "y", model, maps, k=3, key=["id"])
    folded = stratified_folds(rows, "y", 3, ["id"]).withColumn("y", F.col("y").cast("double"))
    spark_own = CrossValidator(estimator=training.assembled(features, model), estimatorParamMaps=maps, evaluator=training.f1_evaluator("y"), numFolds=3, foldCol="fold", parallelism=2).fit(folded)
    found = table.orderBy("candidate").collect()
    assert [r.f1_mean for r in found] == pytest.approx(spark_own.avgMetrics, abs=1e-12) and [r.f1_std for r in found] == pytest.approx(spark_own.stdMetrics, abs=1e-12)
    assert best.stages[-1].toDebugString.partition("\n")[2] == spark_own.bestModel.stages[-1].toDebugString.partition("\n")[2]
    assert written == [["a", "b", "y", "fold"]] and passes == [(4, ["features", "y", "fold"])] * 3
    one = training.cross_validated_f1(rows, features, "y", {"tree": training.decision_tree("y", depth=1, leaf=1)}, k=3, key=["id"]).first()
    assert one.cv_f1_mean == pytest.approx(found[0].f1_mean, abs=1e-12)
    with pytest.raises(ValueError, match="class 1"):
        training.search(rows.filter("y = 0"), features, "y", model, maps[:1], k=2, key=["id"])
