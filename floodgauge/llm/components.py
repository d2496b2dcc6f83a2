"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.session import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    inner = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("a", F.col("m").alias("b"))).distinct()


def stars(links: DataFrame) -> DataFrame:
    """``a, b``: every linked node but the smallest of its component, and that smallest one.

    ``links`` has two long columns ``a`` and ``b``; order, repeats and links to itself do not matter. Each round halves
    the depth of the trees about; its rows are checkpointed, so a lost executor costs one round.
    """
    state = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        facts = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if facts[0] == 0 or facts == mark:
            return state
        mark = facts
        state = checkpointed(_small_star(_large_star(state)))
