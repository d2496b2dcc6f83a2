"""Divergence audit: how far the words of each source lie from those of the other sources of its language, and from the language as a whole.

Each group (language, source) gives every kept term of its language a price in whole numbers, absent terms included. A group is a sparse
vector of the prices of the terms it holds, sorted by term id, and one price for all others. Vectors are cut into buckets of terms. A pair task takes two groups' vectors
of a bucket, finds common terms by galloping search of the shorter list in the longer one, and adds up common, one-sided and absent
terms in both directions; absent terms are a count, never rows. Blocks of groups are co-grouped, so a vector travels once for each block, not for each pair.

No task holds more than the vectors of two blocks in one bucket: buckets grow in number with the kept rows, blocks with the sources of a language. Counts are
summed inside tasks before the shuffle; the terms of a group, however many, are ranked inside tasks first.

Edge cases: null text, language and source are ''. Texts without terms still name their group. A language without kept terms has pairs of value 0 and no
terms. Repeated rows count one by one. Long texts are read piece by piece. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.llm.common import LOWER, UPPER, query, table
from floodgauge.session import broadcast_if_small, scratch_path

UNIT = 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Kept rows (group and term) in a bucket, about; groups in a block.
BUCKET_ROWS, BLOCK_GROUPS = 32_768, 64
#: Counted terms that a task holds before it hands them on, and bytes of a text that are cut into words at a time.
HELD, PIECE = 200_000, 1 << 20
#: Needles that gallop together.
STRIDE = 512
#: Bytes outside of words of letters and non-ASCII characters become spaces; A-Z become a-z.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def _words(text: str | None) -> Iterator[list[bytes]]:
    """Words of the text, piece by piece."""
    data, at = (text or "").encode().translate(_LETTERS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, count, docs`` of what the task has read; the empty term marks that the group occurs."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def rows():
        for (lang, source), words in counts.items():
            seen = docs[lang, source]
            terms = list(words)
            for at in range(0, len(terms), 20_000):
                some = terms[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode() for t in some], pa.string()),
                    pa.array([words[t] for t in some], pa.int64()), pa.array([seen[t] for t in some], pa.int64()),
                ], ["lang", "source", "term", "count", "docs"])
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            key = lang.as_py(), source.as_py()
            if key not in counts:
                counts[key], docs[key] = Counter({b"": 0}), Counter()
                held += 1
            words, distinct, before = counts[key], set(), len(counts[key])
            for piece in _words(text.as_py()):
                words.update(piece)
                distinct.update(piece)
            docs[key].update(distinct)
            held += len(words) - before
            if held > HELD:
                yield from rows()
                held = 0
    yield from rows()


def term_counts(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, lang_column: str = "lang", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """``lang, source, term, count, total, first``: terms in enough documents of the language; ``total``: its count there, ``first``: 1 in one row for each term.

    Every group also has a row for the term '', of count 0.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(clean(lang_column).alias("lang"), clean(source_column).alias("source"), F.col(text_column).cast("string").alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, count bigint, docs bigint")
    summed = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    same = W.partitionBy("lang", "term")
    known = summed.withColumns({
        "docs": F.sum("docs").over(same), "total": F.sum("count").over(same),
        "first": ((F.min("source").over(same) == F.col("source")) & (F.col("term") != "")).cast("int"),
    })
    return known.where((F.col("docs") >= least_documents) | (F.col("term") == "")).drop("docs")


def price(count: str, size: str, terms: str) -> Column:
    """``1 + floor(UNIT * (count + 1) / (size + terms))``, exact for counts of any size."""
    return F.expr(f"1 + cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(19,0)) div cast({size} + {terms} as decimal(19,0))")


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """First place in ``hay`` of a value that is not below each needle; both are sorted. Steps double from where the last needles were found."""
    out, low = np.empty(len(needles), np.int64), 0
    for at in range(0, len(needles), STRIDE):
        some = needles[at : at + STRIDE]
        step, high = 1, low
        while high < len(hay) and hay[high] < some[-1]:
            high, step = high + step, step * 2
        found = low + np.searchsorted(hay[low : high + 1], some)
        out[at : at + STRIDE] = found
        low = int(found[-1])
    return out


def _cost(p: np.ndarray | int, q: np.ndarray | int):
    return (p - q) * (p - q) // q


def merged(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int) -> tuple[int, int]:
    """Sums over all terms of the cost of ``a`` seen from ``b`` and the other way; each side has sorted ids, their prices, and the price of the rest."""
    turned = len(a[0]) > len(b[0])
    (ids, p, p0), (hay, q, q0) = (b, a) if turned else (a, b)
    place = gallop(ids, hay)
    common = np.zeros(len(ids), bool)
    inside = place < len(hay)
    common[inside] = hay[place[inside]] == ids[inside]
    alone = np.ones(len(hay), bool)
    alone[place[common]] = False
    x, y, left, right = p[common], q[place[common]], p[~common], q[alone]
    absent = terms - len(ids) - len(right)
    there = int(_cost(x, y).sum()) + int(_cost(left, q0).sum()) + int(_cost(p0, right).sum()) + absent * _cost(p0, q0)
    back = int(_cost(y, x).sum()) + int(_cost(q0, left).sum()) + int(_cost(right, p0).sum()) + absent * _cost(q0, p0)
    return (back, there) if turned else (there, back)


def _pair_task(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every unordered pair of a group of the left block and one of the right block, in one bucket."""

    def vectors(rows: pa.Table):
        out = []
        for r in range(rows.num_rows):
            get = lambda c, r=r: rows.column(c)[r]
            ids, prices = (np.asarray(get(c).values if get(c).is_valid else [], np.int64) for c in ("ids", "prices"))
            out.append((get("source").as_py(), (ids, prices, get("rest").as_py())))
        return out

    found: list[tuple[str, str, int, int]] = []
    if left.num_rows and right.num_rows:
        same, terms, lang = left.column("i")[0] == left.column("j")[0], left.column("terms")[0].as_py(), left.column("lang")[0].as_py()
        xs, ys = vectors(left), vectors(right)
        found = [(a, b, *merged(x, y, terms)) for a, x in xs for b, y in ys if not same or a < b]
    columns = list(zip(*found)) or [()] * 4
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    names = ["lang", "a", "b", "there", "back"]
    return pa.Table.from_arrays([pa.array([lang] * len(found) if found else [], pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: every ordered pair of sources of a language."""
    bucket = W.partitionBy("lang", "bucket")
    numbered = terms.select("lang", "source", "p", "term", "bucket").withColumn("id", F.dense_rank().over(bucket.orderBy("term")))
    arrays = numbered.withColumn("terms", F.max("id").over(bucket)).groupBy("lang", "bucket", "source").agg(
        F.first("terms").alias("terms"), F.array_sort(F.collect_list(F.struct("id", "p"))).alias("v"),
    )
    path = scratch_path(terms.sparkSession, "divergence-vectors")
    arrays.select("lang", "bucket", "source", "terms", F.col("v.id").alias("ids"), F.col("v.p").alias("prices")).write.parquet(path)
    vectors = terms.sparkSession.read.parquet(path)
    sizes = vectors.groupBy("lang", "bucket").agg(F.first("terms").alias("terms"))
    grid = groups.select("lang", "source", "rest", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    whole = grid.join(vectors.drop("terms"), ["lang", "source", "bucket"], "left").join(broadcast_if_small(sizes), ["lang", "bucket"], "left")
    whole = whole.withColumn("terms", F.coalesce("terms", F.lit(0)))
    task = ["lang", "bucket", "i", "j"]
    left = whole.withColumns({"i": F.col("block"), "j": F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))})
    right = whole.withColumns({"j": F.col("block"), "i": F.explode(F.sequence(F.lit(0), F.col("block")))})
    columns = [*task, "source", "rest", "terms", "ids", "prices"]
    parts = left.select(columns).groupBy(*task).cogroup(right.select([F.col(c).alias(c) for c in columns]).groupBy(*task)).applyInArrow(_pair_task, "lang string, a string, b string, there bigint, back bigint")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("there").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value")))
    return sums.select("lang", F.inline(ways))


def audit(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, bucket_rows: int = BUCKET_ROWS, block_groups: int = BLOCK_GROUPS, **columns: str,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` compares a group with each other source, part ``term`` lists the terms it uses most above its language."""
    spark = documents.sparkSession
    path = scratch_path(spark, "divergence-counts")
    term_counts(documents, least_documents, **columns).write.parquet(path)
    kept = spark.read.parquet(path)
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("first").alias("v"), F.sum((F.col("term") != "").cast("long")).alias("rows"))
    of_lang = own.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"), F.sum("rows").alias("rows"), F.count("*").alias("n_groups"))
    known = own.select("lang", "source", "n").join(broadcast_if_small(of_lang), "lang").withColumns({
        "buckets": F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).cast("int"), "blocks": F.ceil(F.col("n_groups") / block_groups).cast("int"),
    })
    groups_path = scratch_path(spark, "divergence-groups")
    known.withColumns({
        "rest": F.when(F.col("v") > 0, price("0", "n", "v")).otherwise(1),
        "block": F.pmod(F.xxhash64("source"), "blocks").cast("int"),
    }).write.parquet(groups_path)
    groups = spark.read.parquet(groups_path)
    facts = broadcast_if_small(groups.select("lang", "source", "n", "v", "lang_n", "buckets"))
    terms = kept.where(F.col("term") != "").join(facts, ["lang", "source"]).select(
        "lang", "source", "term", price("count", "n", "v").alias("p"), price("total", "lang_n", "v").alias("q"),
        F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"),
    )
    each = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    above = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    listed = above.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= top)
    pairs = pair_values(terms, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(each))
    return pairs.union(listed)


SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
tokens AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS c FROM tokens GROUP BY lang, source, term),
grid AS (
    SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, k.c AS all_c
    FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counted x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
sized AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n FROM grid),
priced AS (
    SELECT s.lang, s.source, s.term, s.c, CAST(1 + {UNIT} * (s.c + 1) // (s.n + l.v) AS BIGINT) AS p, CAST(1 + {UNIT} * (s.all_c + 1) // (l.n + l.v) AS BIGINT) AS q
    FROM sized s JOIN langs l ON s.lang = l.lang),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM priced WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""


@query("op12_divergence", SQL)
def op12_divergence(spark, folder):
    """Every pair of sources of a language, and up to 200 terms of each source above the language's share."""
    return audit(table(spark, folder, "documents"))
