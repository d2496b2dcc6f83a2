"""Exact shard sizes, places, and the law of the draw."""

import zlib
from math import comb

import numpy as np
from pyspark.sql import functions as F

from floodgauge.llm import sharding


def test_matrix_has_exact_sums_and_the_hypergeometric_mean():
    counts, total = [5, 0, 17, 40], np.zeros((4, 3))
    for seed in range(400):
        m = np.array(sharding.communication_matrix(counts, 3, seed))
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sharding.targets(62, 3)
        total += m
    assert np.abs(total / 400 - np.outer(counts, sharding.targets(62, 3)) / 62).max() < 0.6


def test_large_counts_are_drawn_by_the_same_law():
    """The way for large counts, used on small ones, against the probabilities themselves; then sums beyond three billion rows."""
    draw, good, bad, sample, rounds = np.random.default_rng(5), 7, 9, 6, 20_000
    seen = np.bincount([sharding.hypergeometric(draw, good, bad, sample, large=0) for _ in range(rounds)], minlength=sample + 1) / rounds
    want = [comb(good, k) * comb(bad, sample - k) / comb(good + bad, sample) for k in range(sample + 1)]
    assert np.abs(seen - want).max() < 0.015
    for sample in (0, 16):
        assert sharding.hypergeometric(draw, good, bad, sample, large=0) == (good if sample else 0)
    counts = [600_000_000, 0, 1_400_000_000, 5, 1_000_000_001]
    m = np.array(sharding.communication_matrix(counts, 8, 42))
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sharding.targets(sum(counts), 8)
    assert (np.abs(m[0] - 75_000_000) < 60_000).all() and (m[0] != 75_000_000).any()
    assert sharding.communication_matrix([], 8, 1) == []


def test_pieces_follow_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 2_000) for i in range(400)], "doc_id bigint, text string").repartition(3)
    rows = sharding.exchanged(df, 2, piece_bytes=50_000).collect()
    assert len({(r.shard, r.piece) for r in rows}) >= 16
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(2) for k in range(200)]


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = sorted((len(slots.get(s, [])) for s in range(shards)), reverse=True)
    assert set(slots) <= set(range(shards)) and sizes == sorted(sharding.targets(len(rows), shards), reverse=True)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_placement(spark):
    texts = [(i if i % 7 else None, None if i % 5 == 0 else "é" * (i % 9)) for i in range(333)] + [(1, "same")] * 60 + [(2, "long " * 60_000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("shard", F.lit("x")).withColumn("size", F.lit("x")).repartition(5)
    for shards, piece in ((8, 10), (3, 20_000), (1, 50)):
        check(sharding.sharded(df, shards, piece_rows=piece).collect(), texts, shards)
    few = spark.createDataFrame(texts[:3], "doc_id bigint, text string")
    check(sharding.sharded(few).collect(), texts[:3], 8)
    assert sharding.sharded(few.limit(0)).count() == 0


def test_repeatable_and_uniform(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = sorted(map(tuple, sharding.sharded(docs).collect()))
    assert first == sorted(map(tuple, sharding.sharded(docs).collect()))
    seen = np.zeros(8)
    for seed in range(12):
        seen += np.bincount([r.shard for r in sharding.sharded(docs, seed=seed).where("doc_id < 40").collect()], minlength=8)
    assert (np.abs(seen - 60) < 40).all()


def test_query(spark, folder):
    texts = [(d.doc_id, d.text) for d in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sharding.op8_sharding(spark, folder).collect()
    check(got, texts, 8)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_shards_hold_whole_rows(spark, tmp_path):
    texts = [(i, None if i % 5 == 0 else f"text {i}", i * 3, "mine") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, extra bigint, shard string").repartition(4)
    rows = sharding.exchanged(df, 3, piece_rows=10).collect()
    assert sorted(tuple(r.row)[0] for r in rows) == list(range(200))
    assert sorted(map(str, (tuple(r.row) for r in rows))) == sorted(map(str, texts))
    shard, slot = sharding.write_shards(df, str(tmp_path / "out"), 3, piece_rows=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert (shard, slot) == ("shard_", "slot")
    want = sorted((tuple(r.row), r.shard, r.slot) for r in rows if r.row.text)
    assert sorted((tuple(r[c] for c in df.columns), r[shard], r[slot]) for r in back.where("text is not null").collect()) == want
    assert back.count() == 200
