"""Uniform shuffle into shards of exact sizes: a hypergeometric matrix says how many rows each partition sends to each shard.

The matrix is drawn from the partitions' row counts, without replacement from the places the shards have left, which is
the law of a uniform shuffle: first what the first half of the partitions sends, then the halves of each half, so that few draws are from large counts. Whole rows, with the text and all other columns, are permuted inside their partition and dealt out by rank,
exchanged, then permuted again inside the shard; a shard too large for a task is placed in pieces. Sizes and checksums are taken
from the placed rows. ``write_shards`` writes them as files.

Law: ``rows``, so the shards' counts differ by one at most. The same input (same files, same partitions) and seed give the same shards.

Edge cases: a null text has size 1 and checksum 0. Repeated rows are placed one by one. With fewer rows than shards some
shards stay empty. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodgauge.llm.common import fresh, query, table
from floodgauge.session import broadcast_if_small, checkpointed

SHARDS = 8
#: Rows and bytes that one task ranks inside a shard, about; shards are ranked in as many pieces as they need.
PIECE_ROWS, PIECE_BYTES = 20_000, 64 << 20
#: Numpy draws the hypergeometric law for counts below this.
LARGE = 1_000_000_000


def targets(total: int, shards: int) -> list[int]:
    """Rows per shard: equal but for one."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int, large: int = LARGE) -> int:
    """How many of a sample without replacement are good; exact for counts of any size.

    Large counts: every item is marked by itself with the chance that makes ``sample`` the mean, then as many marks as there are too many or too few are taken away or added
    at random. All items are treated alike, so every sample of that size is as likely as any other. The corrections are about the root of the sample.
    """
    if good + bad < large:
        return int(draw.hypergeometric(good, bad, sample)) if sample else 0
    marked_good, marked_bad = (int(draw.binomial(n, sample / (good + bad))) for n in (good, bad))
    over = marked_good + marked_bad - sample
    if over > 0:
        return marked_good - int((draw.choice(marked_good + marked_bad, over, replace=False) < marked_good).sum())
    rest = good - marked_good
    return marked_good + int((draw.choice(rest + bad - marked_bad, -over, replace=False) < rest).sum())


def communication_matrix(counts: list[int], shards: int, seed: int, large: int = LARGE) -> list[list[int]]:
    """Row p, column s: rows that partition p sends to shard s. Row sums are the counts, column sums the targets."""
    draw = np.random.default_rng(seed)
    ends = [0]
    for n in counts:
        ends.append(ends[-1] + n)
    matrix: list[list[int]] = [[]] * len(counts)
    open_ = [(0, len(counts), targets(ends[-1], shards))] if counts else []
    while open_:
        lo, hi, columns = open_.pop()
        if hi - lo == 1:
            matrix[lo] = columns
            continue
        mid = (lo + hi) // 2
        want, left, first = ends[mid] - ends[lo], ends[hi] - ends[lo], []
        for n in columns:
            first.append(hypergeometric(draw, n, left - n, want, large))
            want, left = want - first[-1], left - n
        open_ += [(mid, hi, [n - k for n, k in zip(columns, first)]), (lo, mid, first)]
    return matrix


def permuted(documents: DataFrame, seed: int) -> DataFrame:
    """``row, part, place, rank, bytes``: whole rows, permuted inside their partition and numbered from 1 there; written once, later jobs see the same places.

    ``bytes``: those of texts and binary values, and 8 for each column.
    """
    size = F.lit(8 * len(documents.columns)).cast("long")
    for field in documents.schema:
        if field.dataType.simpleString() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.monotonically_increasing_id().alias("place"), size.alias("bytes"))
    mixed = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), "place"), "place")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place inside the partition
    return checkpointed(mixed.select("row", "place", "bytes", F.spark_partition_id().alias("part"), (number + 1).alias("rank")))


def exchanged(documents: DataFrame, shards: int = SHARDS, seed: int = 42, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``row, shard, piece, slot``: a uniform random placement of whole rows, slots gapless from 0 in each shard; a piece holds consecutive slots."""
    spark = documents.sparkSession
    rows = permuted(documents, seed)
    counted = sorted(rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect())  # one row per partition
    total, volume = sum(r.n for r in counted), sum(r.bytes for r in counted)
    matrix = communication_matrix([r.n for r in counted], shards, seed)
    bounds = [(r.part, [int(x) for x in np.cumsum(sent)]) for r, sent in zip(counted, matrix)]
    sends = broadcast_if_small(spark.createDataFrame(bounds, "part int, bounds array<bigint>"))
    dealt = rows.join(sends, "part").select(
        "row", "place", F.xxhash64(F.lit(seed + 1), "place").alias("key"),
        F.size(F.filter("bounds", lambda b: b < F.col("rank"))).alias("shard"),
    )
    # Second permutation: order by the second key inside the shard, in pieces cut by the key's upper bits.
    bits = max(total // shards // piece_rows, volume // shards // piece_bytes).bit_length()
    pieces = dealt.withColumn("piece", F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("shard", "piece").count().select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("key", "place")) - 1
    placed = pieces.withColumn("inside", inside).join(broadcast_if_small(starts), ["shard", "piece"])
    return placed.select("row", "shard", "piece", (F.col("start") + F.col("inside")).cast("long").alias("slot"))


def sharded(documents: DataFrame, shards: int = SHARDS, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: size and checksum of the text that arrived in each place."""
    placed = exchanged(documents, shards, seed, piece_rows)
    text = F.encode(F.coalesce(F.col(f"row.`{text_column}`").cast("string"), F.lit("")), "UTF-8")
    return placed.select(
        F.col(f"row.`{id_column}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), "shard", "slot",
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, seed: int = 42, piece_rows: int = PIECE_ROWS) -> tuple[str, str]:
    """Parquet files of whole rows below one folder for each shard; the rows of a file are in the order of their slots.

    Returns the names of the two columns that the files have besides the documents' own: shard and slot.
    """
    shard = fresh(documents, "shard")
    slot = fresh(documents, "slot")
    placed = exchanged(documents, shards, seed, piece_rows).repartition("shard", "piece").sortWithinPartitions("shard", "slot")
    columns = [F.col(f"row.`{c}`").alias(c) for c in documents.columns]
    placed.select(*columns, F.col("shard").alias(shard), F.col("slot").alias(slot)).write.partitionBy(shard).parquet(path)
    return shard, slot


@query("op8_sharding")
def op8_sharding(spark, folder):
    """All documents in eight shards whose row counts differ by one at most."""
    placed = sharded(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
