"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from floodgauge.llm import bpe, chat, decontamination, divergence, language_model, licences, ngram_join, quality, sharding, simhash, toxicity, urls, whitening  # noqa: F401
from floodgauge.llm.common import ORACLES, QUERIES

#: Folder of the package: tasks import their functions from it.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def queries():
    def importable(fn):
        def run(spark, folder):
            spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
            return fn(spark, folder)

        return run

    return {name: importable(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLES)
