"""Queries of scaling, feature selection and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgauge.ml import registry, scaling, selection, training
from floodgauge.ml.boosting import fit_boosted_trees
from floodgauge.ml.isolation_forest import fit_isolation_forest
from floodgauge.operators import sampling
from floodgauge.plans.live_detection import plan_mitigation
from floodgauge.plans.prepare_dataset import prepare_dataset
from floodgauge.plans.registry import query, tidy
from floodgauge.plans.train_and_select import train_and_select
from floodgauge.plans.views import FEATURES, FLOW_KEY, labelled, table, threats, with_views
from floodgauge.session import checkpointed, scratch_path, spread

KEY = (FLOW_KEY,)


def _scaled_sql(center: str, scale: str) -> str:
    cells = ", ".join(f"round(({c} - c_{c}) / s_{c}, 4) AS {c}" for c in FEATURES)
    stats = ", ".join(
        f"{center.format(c=c)} AS c_{c}, CASE WHEN {scale.format(c=c)} = 0 THEN 1 ELSE {scale.format(c=c)} END AS s_{c}"
        for c in FEATURES
    )
    return with_views(("labelled",), f"SELECT flow_key, {cells} FROM labelled, (SELECT {stats} FROM labelled) st")


@query("standard_scaled", _scaled_sql("avg({c})", "stddev_pop({c})"))
def standard_scaled(spark, folder):
    rows = labelled(spark, folder).select("flow_key", *FEATURES)
    return tidy(scaling.fit_standard(rows, FEATURES).apply(rows), 4)


@query("min_max_scaled", _scaled_sql("min({c})", "max({c}) - min({c})"))
def min_max_scaled(spark, folder):
    rows = labelled(spark, folder).select("flow_key", *FEATURES)
    return tidy(scaling.fit_min_max(rows, FEATURES).apply(rows), 4)


@query("robust_scaled", _scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def robust_scaled(spark, folder):
    rows = labelled(spark, folder).select("flow_key", *FEATURES)
    return tidy(scaling.fit_robust(rows, FEATURES).apply(rows), 4)


@query("quantile_normal")
def quantile_normal(spark, folder):
    rows = labelled(spark, folder).select("flow_key", *FEATURES)
    return tidy(scaling.fit_quantile_normal(rows, FEATURES).apply(rows), 4)


_ANOVA = "anova AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {i} AS position, (sum(n * (m - g) * (m - g)) / (count(*) - 1))
      / (sum(n * v) / (sum(n) - count(*))) AS score
    FROM (SELECT label, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM labelled) AS g
      FROM labelled GROUP BY 1) x"""
    for i, c in enumerate(FEATURES)) + ")"


@query("anova_scores", with_views(("labelled",), "SELECT feature, CAST(position AS BIGINT) AS position, round(score, 4) AS score FROM anova", _ANOVA))
def anova_scores(spark, folder):
    return tidy(selection.anova_scores(labelled(spark, folder), FEATURES, "label"), 4)


@query("best_features", with_views(("labelled",), """
SELECT feature, round(score, 4) AS score FROM anova ORDER BY anova.score DESC, position LIMIT 2""", _ANOVA))
def best_features(spark, folder):
    scores = selection.anova_scores(labelled(spark, folder), FEATURES, "label")
    return tidy(selection.top_features(scores, 2).select("feature", "score"), 4)


_MI = """
cuts AS (SELECT {cuts} FROM labelled),
cells AS ({cells}),
joint AS (
  SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS of_bin,
    sum(n) OVER (PARTITION BY feature, label) AS of_class
  FROM (SELECT feature, bin, label, count(*) AS n FROM cells GROUP BY 1, 2, 3) x)"""


def _mi_sql() -> str:
    cuts = ", ".join(
        f"list_distinct(quantile_cont({c}, [{', '.join(str(i / 16) for i in range(1, 16))}])) AS q_{c}" for c in FEATURES)
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, label, len(list_filter(q_{c}, lambda v: {c} > v)) AS bin FROM labelled, cuts" for c in FEATURES)
    return with_views(("labelled",), """
SELECT feature, round(sum(n / total * ln(n * total / (of_bin * of_class))), 6) AS score FROM joint GROUP BY 1""",
        _MI.format(cuts=cuts, cells=cells))


@query("mutual_information", _mi_sql())
def mutual_information(spark, folder):
    return tidy(selection.mutual_information(labelled(spark, folder), FEATURES, "label").select("feature", "score"))


def _neighbour_sql() -> str:
    def psi(n: str) -> str:
        far = f"({n} + 10.0e0)"
        return (f"(ln({far}) - 0.5e0 / {far} - 1 / (12e0 * {far} ** 2) + 1 / (120e0 * {far} ** 4) - 1 / (252e0 * {far} ** 6) + 1 / (240e0 * {far} ** 8)"
                f" - list_sum(list_transform(range(0, 10), lambda j: 1e0 / ({n} + j))))")

    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, label, CAST({c} AS DOUBLE) AS x FROM labelled WHERE {c} IS NOT NULL" for c in FEATURES)
    # The third neighbour is in one of the four runs of four rows around the row; its distance is that of the run that reaches least far.
    low = [f"x - lag(x, {j}) OVER o" if j else "0" for j in range(4)]
    high = [f"lead(x, {j}) OVER o - x" if j else "0" for j in range(4)]
    whole = ", ".join(f"CASE WHEN {low[j]} IS NOT NULL AND {high[3 - j]} IS NOT NULL THEN greatest({low[j]}, {high[3 - j]}) END" for j in range(4))
    return with_views(("labelled",), f"""
SELECT feature, round(greatest(0, {psi("max(total)")} + avg({psi("inside")} - {psi("of_class")} - {psi("of_all")})), 6) AS score FROM balls GROUP BY 1""", f"""
cells AS ({cells}),
reach AS (SELECT *, least({whole}) AS d FROM cells WINDOW o AS (PARTITION BY feature, label ORDER BY x)),
radii AS (SELECT *, CASE WHEN d > 0 THEN d + 1e-12 * greatest(abs(x), d) ELSE 0 END AS r FROM reach),
balls AS (SELECT feature,
  count(*) OVER (PARTITION BY feature, label ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) - 1 AS inside,
  count(*) OVER (PARTITION BY feature ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) - 1 AS of_all,
  count(*) OVER (PARTITION BY feature, label) AS of_class, count(*) OVER (PARTITION BY feature) AS total FROM radii)""")


@query("mutual_information_neighbours", _neighbour_sql())
def mutual_information_neighbours(spark, folder):
    return tidy(selection.neighbour_information(labelled(spark, folder), FEATURES, "label").select("feature", "score"))


def _both_sql() -> str:
    ctes = _mi_sql().split("SELECT feature, round(sum(n / total")[0]  # the views and the steps of the score
    return ctes.rstrip() + ", " + _ANOVA + """,
mi AS (SELECT feature, sum(n / total * ln(n * total / (of_bin * of_class))) AS score FROM joint GROUP BY 1),
best AS (
  SELECT feature FROM (SELECT feature FROM anova ORDER BY anova.score DESC, position LIMIT 2) x
  UNION SELECT feature FROM (SELECT mi.feature FROM mi JOIN anova USING (feature) ORDER BY mi.score DESC, position LIMIT 2) y)
SELECT feature, CAST(position AS BIGINT) AS position FROM best JOIN anova USING (feature) ORDER BY position LIMIT 2"""


@query("features_by_both_scores", _both_sql())
def features_by_both_scores(spark, folder):
    chosen = selection.select_by_both(labelled(spark, folder), FEATURES, "label", 2)
    return tidy(spark.createDataFrame([(c, FEATURES.index(c)) for c in chosen], "feature string, position long"))


def _split(spark, folder):
    rows = labelled(spark, folder).select(FLOW_KEY, *FEATURES, F.col("label"), "is_attack")
    # A feature that carries some of the label, so that there is something to learn.
    hint = F.col("l_quantity") + F.col("is_attack") * 25
    return sampling.stratified_split(rows.withColumn("l_quantity", hint), "is_attack", 0.2, key=KEY)


@query("isolation_forest_scores")
def isolation_forest_scores(spark, folder):
    rows = spread(labelled(spark, folder).select("flow_key", *FEATURES))
    forest = fit_isolation_forest(rows, FEATURES, n_trees=50, contamination=0.1, key=KEY)
    return tidy(forest.score(rows).select("flow_key", "decision", "predicted"))


@query("anomaly_detector_metrics")
def anomaly_detector_metrics(spark, folder):
    rows = _split(spark, folder)
    _, out = training.train_anomaly_detector(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"), FEATURES, "is_attack", n_trees=50, key=KEY)
    return tidy(out.drop("training_time"))


@query("model_comparison")
def model_comparison(spark, folder):
    rows = checkpointed(_split(spark, folder).select(*FEATURES, "is_attack", "split"))  # every model reads them again
    models = {
        "random_forest": training.random_forest("is_attack"),
        "boosted_trees": training.boosted_trees("is_attack"),
        "logistic_regression": training.logistic("is_attack"),
        "decision_tree": training.decision_tree("is_attack"),
    }
    _, out = training.train_and_compare(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"), FEATURES, "is_attack", models)
    return tidy(out.drop("training_time"))


#: Floors of the facts: a feature moved by half its range ranks 7 of 8 pairs rightly at best.
LEAST_AREA, LEAST_LEAD = 0.85, 0.1


@query("second_order_boosting_facts", with_views(("labelled",), """
SELECT CAST(sum(round_even(n * 0.2e0, 0)) AS BIGINT) AS n_test, CAST(100 AS BIGINT) AS n_trees, CAST(1 AS BIGINT) AS ranks, CAST(1 AS BIGINT) AS beats_majority
FROM (SELECT is_attack, count(*) AS n FROM labelled GROUP BY 1) x"""))
def second_order_boosting_facts(spark, folder):
    """A hundred rounds on the training rows: area under the curve and accuracy on the test rows against floors."""
    rows = checkpointed(_split(spark, folder))
    model = fit_boosted_trees(spread(rows.filter("split = 'train'")), FEATURES, "is_attack", rows_share=0.8, columns_share=0.8, key=KEY)
    scored = model.score(rows.filter("split = 'test'"))
    found = training.evaluate(scored, "boosted", "is_attack", 0.0)
    n_test, attacks = rows.filter("split = 'test'").agg(F.count(F.lit(1)), F.avg("is_attack")).first()
    return tidy(found.select(
        F.lit(n_test).alias("n_test"), F.lit(len(model.trees)).alias("n_trees"), (F.col("auc_roc") >= LEAST_AREA).alias("ranks"),
        (F.col("accuracy") >= max(attacks, 1 - attacks) + LEAST_LEAD).alias("beats_majority")))


@query("cross_validated_f1")
def cross_validated_f1(spark, folder):
    models = {"decision_tree": training.decision_tree("is_attack", depth=4),
              "logistic_regression": training.logistic("is_attack", iterations=10)}
    rows = _split(spark, folder).drop("split")
    return tidy(training.cross_validated_f1(rows, FEATURES, "is_attack", models, k=3, key=KEY))


@query("grid_search")
def grid_search(spark, folder):
    model = training.decision_tree("is_attack")
    options = training.grid(model, {"maxDepth": [2, 4], "minInstancesPerNode": [1, 20]})
    _, out = training.search(_split(spark, folder).drop("split"), FEATURES, "is_attack", model, options, k=2, key=KEY)
    return tidy(out)


@query("random_search")
def random_search(spark, folder):
    model = training.boosted_trees("is_attack", rounds=3)
    draws = training.random_draws(model, {"maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1, 0.2]}, n=3)
    _, out = training.search(_split(spark, folder).drop("split"), FEATURES, "is_attack", model, draws, k=2, key=KEY)
    return tidy(out)


@query("embedding_classifier")
def embedding_classifier(spark, folder):
    rows = table(spark, folder, "embeddings")
    names = [f"e{i}" for i in range(rows.select(F.max(F.size("embedding"))).first()[0])]
    wide = rows.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
                       (F.col("label") < 5).cast("int").alias("y"))
    split = sampling.stratified_split(wide, "y", 0.2, key=("vec_id",))
    models = {"random_forest": training.random_forest("y", trees=10, depth=5)}
    _, out = training.train_and_compare(split.filter("split = 'train'"), split.filter("split = 'test'"), names, "y", models)
    return tidy(out.drop("training_time"))


_LONG = " UNION ALL ".join(
    f"SELECT split, is_attack, '{c}' AS feature, {i} AS position, {c} AS v FROM divided" for i, c in enumerate(FEATURES))

_PREPARED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', flow_key))) AS rk
  FROM (SELECT DISTINCT flow_key, l_quantity, l_extendedprice, l_discount, l_tax, label, is_attack FROM labelled) d),
capped AS (SELECT *, count(*) OVER (PARTITION BY label) AS n_class FROM ranked WHERE rk <= 15000),
divided AS (
  SELECT *, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + round_even((n_class - t) * 0.1e0, 0) THEN 'val' ELSE 'train' END
    AS split FROM (SELECT *, round_even(n_class * 0.2e0, 0) AS t FROM capped) x),
long AS (""" + _LONG + """),
per_class AS (
  SELECT feature, position, is_attack, count(*) AS n, avg(v) AS m, var_pop(v) AS var, min(v) AS lo, max(v) AS hi
  FROM long WHERE split = 'train' GROUP BY 1, 2, 3),
rated AS (
  SELECT feature, position, min(lo) AS lo, max(hi) AS hi,
    (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * var) / (sum(n) - count(*))) AS score
  FROM (SELECT *, sum(n * m) OVER f / sum(n) OVER f AS g FROM per_class WINDOW f AS (PARTITION BY feature)) y GROUP BY 1, 2),
chosen AS (SELECT * FROM rated ORDER BY score DESC, position LIMIT 3)"""


@query("prepared_dataset", with_views(("labelled",), """
SELECT split, CAST(is_attack AS BIGINT) AS malicious, feature, count(*) AS n, round(avg((v - lo) / (hi - lo)), 4) AS mean
FROM long JOIN chosen USING (feature) GROUP BY 1, 2, 3""", _PREPARED))
def prepared_dataset(spark, folder):
    raw = labelled(spark, folder).select(FLOW_KEY, *FEATURES, F.col("label").alias("Label"))
    done = prepare_dataset(raw, cap=15_000, top=3, scaling="min_max", validation=0.1, key=KEY)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in done.features])
    return tidy(done.table.select("split", F.col("Malicious").alias("malicious"), F.inline(cells)).groupBy(
        "split", "malicious", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), 4)


@query("saved_package_scores", with_views(("labelled",), """
SELECT CAST(sum(round_even(n * 0.2e0, 0)) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different, 'simple' AS level, CAST(4 AS BIGINT) AS n_features
FROM (SELECT count(*) AS n FROM labelled GROUP BY is_attack) x"""))
def saved_package_scores(spark, folder):
    """A fitted package, saved and loaded by priority, scores every test row as before."""
    rows = _split(spark, folder)
    model = training.assembled(FEATURES, training.decision_tree("is_attack", depth=5)).fit(rows.filter("split = 'train'"))
    target = scratch_path(spark, "models")
    registry.save_package(spark, registry.ModelPackage(model, list(FEATURES)), f"{target}/simple")
    loaded = registry.load_by_priority(spark, target)
    test = rows.filter("split = 'test'")
    before = registry.ModelPackage(model, list(FEATURES)).score(test).select(*KEY, F.col("score").alias("before"))
    both = loaded.score(test).select(*KEY, "score").join(before, list(KEY))
    return tidy(both.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("score").eqNullSafe(F.col("before"))).alias("n_different")).select(
        "*", F.lit(loaded.level).alias("level"), F.lit(len(loaded.features)).alias("n_features")))


@query("isolation_forest_facts", with_views(("labelled",), "SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS share_ok, CAST(1 AS BIGINT) AS sides_agree FROM labelled"))
def isolation_forest_facts(spark, folder):
    """The share of anomalies equals the contamination, and exactly the rows with a negative decision are predicted."""
    rows = isolation_forest_scores(spark, folder)
    share = F.count_if(F.col("predicted") == 1) / F.count("*")
    sides = F.count_if((F.col("predicted") == 1) & (F.col("decision") > 0)) + F.count_if((F.col("predicted") == 0) & (F.col("decision") < 0))
    return tidy(rows.agg(F.count("*").alias("n_rows"), (F.abs(share - 0.1) < 0.01).alias("share_ok"), (sides == 0).alias("sides_agree")))


@query("selected_model")
def selected_model(spark, folder):
    models = {"random_forest": training.random_forest("is_attack", trees=5, depth=4),
              "logistic_regression": training.logistic("is_attack", iterations=10)}
    package, out = train_and_select(_split(spark, folder), FEATURES, "is_attack", models)
    return tidy(out.select("model", "accuracy", "f1_score").withColumns({
        "chosen": (F.col("model") == package.kind).cast("int"), "threshold": F.lit(package.threshold)}))


_UPDATES = """
SELECT action, count(*) AS n, count(DISTINCT ip) AS n_ips FROM (
  SELECT 'announce' AS action, ip FROM announced UNION ALL
  SELECT 'withdraw', ip FROM announced WHERE next_ts IS NULL OR epoch_us(next_ts) > epoch_us(ts) + ttl * 1000000) u
GROUP BY 1"""


def _register_updates() -> None:
    from floodgauge.plans.live_queries import _PLAN

    @query("route_updates", with_views(("threats",), _UPDATES, _PLAN, recursive=True))
    def route_updates(spark, folder):
        return tidy(plan_mitigation(threats(spark, folder)).groupBy("action").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("n_ips")))


_register_updates()
