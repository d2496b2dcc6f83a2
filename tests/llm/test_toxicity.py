"""The recurrent network's gradient, its windows, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from floodgauge.llm import recurrent, toxicity


def test_gradient_equals_differences():
    weights = {k: v.astype(np.float64) for k, v in recurrent.initial(1).items()}
    draw = np.random.default_rng(0)
    for k in ("word", "gram"):
        weights[k] = draw.normal(0, 0.3, weights[k].shape)
    inputs = recurrent.Inputs([b"abc", b"de", b"idiotic", b"x"])
    at, label, weight = np.array([[1, 2, 3, 0], [4, 3, 0, 0], [2, 2, 1, 4]]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    _, into = recurrent.gradients(weights, inputs, at, label, weight)
    for k, g in into.items():
        flat, g = weights[k].reshape(-1), g.reshape(-1)
        for i in np.argsort(-abs(g))[:3]:
            old, sides = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = old + step
                sides.append(recurrent.gradients(weights, inputs, at, label, weight)[0])
            flat[i] = old
            assert abs((sides[0] - sides[1]) / 2e-3 - g[i]) < 1e-4 + 0.01 * abs(g[i]), k


def test_windows_hold_every_word():
    for n in (0, 1, 8, 9, 31, 32, 33, 56, 57, 1000):
        held = {k for a in toxicity.starts(n) for k in range(a, min(n, a + toxicity.WINDOW))}
        assert held == set(range(n)) and all(a < n for a in toxicity.starts(n))


def corpus(n=700, seed=1):
    draw = random.Random(seed)
    clean = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(clean) for _ in range(draw.choice((10, 60, 300)))]
        toxic = draw.random() < 0.4
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = "zzurg" + draw.choice(["", "ly", "ed", "er", "est", "ness"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    docs += [(9001, None), (9002, ""), (9003, "!?"), (None, "zzurged zzurgly zzurg"), (9004, "good " * 50_000 + "zzurgest zzurged zzurg " + "fine " * 5_000), (9005, "a"), (9005, "a")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(4)
    y = spark.createDataFrame(labels + [(None, 1), (9005, 0)], "doc_id bigint, toxic int").withColumn("text", F.lit("x"))
    weights = toxicity.fit(d, y)
    got = [tuple(r) for r in toxicity.scored(d, weights).collect()]
    assert len(got) == len(docs) and all(0 <= s <= 1 for _, s in got)
    score, held = dict(got), {r[0] for r in d.where(toxicity.fold(F.col("doc_id")) == 1).select("doc_id").collect()}
    right = [(score[i] >= toxicity.THRESHOLD) == bool(t) for i, t in labels if i in held]
    assert len(right) > 150 and np.mean(right) > 0.95
    assert score[9001] == score[9002] == score[9003] == 0 and score[9004] >= toxicity.THRESHOLD and score[None] >= toxicity.THRESHOLD
    kept = {r.doc_id for r in toxicity.keep_clean(d, y).collect()}
    assert {9001, 9002, 9003} <= kept and 9004 not in kept
    assert toxicity.scored(d.limit(0), weights).count() == 0


def test_labels_of_one_class_give_zero(spark):
    d = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    y = spark.createDataFrame([(k, 1) for k in range(5)], "doc_id bigint, toxic int")
    assert toxicity.fit(d, y) is None
    assert [r.score for r in toxicity.scored(d, None).collect()] == [0.0, 0.0]


def test_few_toxic_documents_are_not_learned_by_heart(spark):
    """Twenty toxic documents among two hundred, ten words that show it, all others random; held-out ones are told apart."""
    draw = random.Random(3)
    shown = ["".join(draw.choice("klmnop") for _ in range(6)) for _ in range(10)]
    docs, labels = [], []
    for i in range(300):
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(3, 7))) for _ in range(draw.choice((40, 120)))]
        if i % 10 == 0:
            for _ in range(4):
                words[draw.randrange(len(words))] = draw.choice(shown)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 10 == 0)))
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = toxicity.scored(d, toxicity.fit(d, y)).withColumn("held", toxicity.fold(F.col("id")) == 1).where("held").collect()
    marked = {True: [], False: []}
    for r in found:
        marked[r.id % 10 == 0].append(r.score >= toxicity.THRESHOLD)
    assert np.mean(marked[True]) >= 0.75 and np.mean(marked[False]) <= 0.1


def test_score_is_that_of_the_highest_window(spark):
    """Each document by itself, window by window, against the batched scores."""
    docs, labels = corpus(120, 2)
    docs += [(500, None), (501, ""), (502, "zzurged " * 70)]
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    weights = toxicity.fit(d, y)
    got = dict(map(tuple, toxicity.scored(d, weights).collect()))
    slope, shift = weights["scale"]
    for i, text in docs:
        words, best = toxicity.words_of(text), None
        for a in toxicity.starts(len(words)):
            window = words[a : a + toxicity.WINDOW]
            vectors = np.concatenate([np.zeros((1, recurrent.WIDTH), np.float32), recurrent.Inputs(window).vectors(weights)])
            at = np.zeros((1, toxicity.WINDOW), np.int64)
            at[0, : len(window)] = range(1, len(window) + 1)
            logit = float(recurrent.forward(weights, recurrent.tables(weights, vectors), at)[0])
            best = logit if best is None else max(best, logit)
        assert abs(got[i] - (0 if best is None else 1 / (1 + np.exp(-(slope * best + shift))))) < 1e-3
