"""Each stage on what its predecessor kept, against brute force."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_bpe import LIBRARY
from test_decontamination import brute as brute_hits
from test_quality import brute as brute_quality
from test_simhash import brute_components, brute_fingerprint

from floodgauge.llm import quality, toxicity


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        result = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.dtypes == docs.dtypes
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_quality_rules(outputs):
    want = [d for d in outputs[0] if brute_quality(d.text)["failed"] & quality.mask(quality.POLICIES["v1"]) == 0]
    assert sorted(outputs[1]) == sorted(want)


def test_toxicity_takes_toxic_and_leaves_clean(spark, folder, outputs):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {d.doc_id for d in outputs[2]}
    known = [(d.doc_id in kept, toxic[d.doc_id]) for d in outputs[1] if d.doc_id in toxic]
    assert set(outputs[2]) <= set(outputs[1])
    assert sum(k for k, t in known if not t) >= 0.9 * sum(not t for _, t in known)
    assert sum(not k for k, t in known if t) >= 0.7 * sum(t for _, t in known)


def test_one_of_each_group(outputs):
    """The smallest id of every component of fingerprints within two bits, compared pair by pair."""
    before = sorted(outputs[2])
    codes = [brute_fingerprint(d.text) for d in before]
    root = brute_components(codes, 2)
    first = {}
    for d, code in zip(before, codes):
        first.setdefault(root[code], d)
    assert sorted(outputs[3]) == sorted(first.values()) and len(first) < len(before)


def test_decontamination(spark, folder, outputs):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = {i: n for i, _, n, _ in brute_hits([(d.doc_id, d.text) for d in outputs[3]], items)}
    after = {d.doc_id: d for d in outputs[4]}
    assert all(after[d.doc_id] == d for d in outputs[3] if not hits[d.doc_id])
    assert not any(n for _, _, n, _ in brute_hits([(d.doc_id, d.text) for d in outputs[4]], items))


def test_byte_bpe(outputs):
    got = {r.doc_id: r.n_tokens for r in outputs[5]}
    assert got == {d.doc_id: len(LIBRARY.encode_ordinary(d.text)) for d in outputs[4]}


def test_run_equals_stages(spark, folder, outputs):
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(outputs[5])


def test_edge_cases(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text.upper() + " once")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("failed", F.lit("x")).withColumn("score", F.lit(1)).withColumn("row", F.lit(2))
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    kept = toxicity.keep_clean(quality.keep_good(docs, "base"), labels)
    assert kept.columns == docs.columns and kept.count() == 4
    from floodgauge.llm import simhash

    # One more word changes more than two bits of the fingerprint of so short a text.
    assert (brute_fingerprint(text) ^ brute_fingerprint(text + " once")).bit_count() > 2
    assert sorted(r.doc_id for r in simhash.one_of_each(kept).collect()) == [1, 4]
    assert corpus_pipeline.byte_bpe(spark, docs.limit(0), "").count() == 0
