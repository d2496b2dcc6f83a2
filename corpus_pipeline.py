"""Training-data pipeline over documents: quality rules, toxicity, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; it is written as Parquet in the shared folder and read again as the next one's
documents, so that a lost executor costs one stage's task. All stages but the last return the columns of documents.

* quality_rules: documents that fail a rule of policy v1 go.
* toxicity: documents with a window that scores at least the threshold go; learned from the stage's own documents and ``labels``.
* simhash_near_dedup: of documents joined by links of at most two differing fingerprint bits (shingles of three words) the one with the smallest id stays.
* decontamination: words in windows of benchmark items are cut out; documents that are benchmark text for the most part go.
* byte_bpe: ids and decoded bytes of the texts, as lengths and digests.

Edge cases: null and empty texts go in the first stage (too few words). Repeated rows go through together up to the third stage, where one stays. An empty table
gives an empty result. Extra columns of documents stay as they are, whatever their names.
"""

from __future__ import annotations

import functools
import os

from floodgauge.llm import bpe, decontamination, quality, simhash, toxicity
from floodgauge.session import scratch_path


#: Rows of a batch that goes to Python: documents are long, and the JVM and the worker each hold a batch.
BATCH_ROWS = "2000"


def in_small_batches(stage):
    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


@in_small_batches
def toxicity_filter(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, labels)


@in_small_batches
def simhash_near_dedup(spark, docs, sf_dir):
    return simhash.one_of_each(docs)


@in_small_batches
def decontaminate(spark, docs, sf_dir):
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def byte_bpe(spark, docs, sf_dir):
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", byte_bpe),
]
#: SQL cannot train the network of the second stage or encode; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents of ``sf_dir``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
