"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, scores all overlapping windows.

A document's score is that of its highest window, so that a short passage in a long text counts. The network is trained on a bounded sample
of labelled documents: at most ``SAMPLE`` of the two classes, those with the smallest hash of their id. Which
window of a toxic document shows it is not known: first the windows with the most words typical of toxic documents are taken, then, in further rounds,
those that the network itself scores highest, in documents of either class. A toxic document in which neither finds anything adds no window.
While the network learns, most words that are no evidence are exchanged for words of clean windows; with few labelled documents it would learn
their windows by heart otherwise. Last, the highest windows of the sample's documents set the scale of the score. Only texts are inputs.

Edge cases: a null or empty text has no words and the score 0. Words beyond a window's size are in the next windows, none is left out.
Without labelled documents of both classes every score is 0. Repeated rows are scored one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.llm import recurrent
from floodgauge.llm.common import fresh, query, table
from floodgauge.session import checkpointed

WINDOW, STRIDE = 32, 24
#: Labelled documents that the network learns from at most: not toxic, toxic.
SAMPLE = (4_000, 1_500)
#: Windows taken at first from a toxic and from another document, and words of evidence.
POSITIVE_WINDOWS, NEGATIVE_WINDOWS, EVIDENCE = 2, 3, 20_000
EPOCHS, ROUNDS, SEED, THRESHOLD = 3, 2, 42, 0.7
#: Steps of learning at least (half as many in each further round), share of words exchanged, shrinking of the tables.
LEAST_STEPS, EXCHANGE, DECAY = 60, 0.9, 0.5
#: Words scored together.
BATCH_WORDS = 200_000

_SEPARATORS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SEPARATORS).split()


def starts(n: int) -> range:
    """First words of the overlapping windows of a text of n words; together they hold every word."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE) if n else range(0)


def fold(doc_id: Column) -> Column:
    """Remainder that decides what is held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def training_sample(documents: DataFrame, labels: DataFrame, size: tuple[int, int] = SAMPLE) -> DataFrame:
    """``label, text`` of at most ``size`` labelled documents of the classes whose remainder is not 1, written once."""
    known = labels.where(F.coalesce(fold(F.col("doc_id")), F.lit(1)) != 1).select("doc_id", F.col("toxic").cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        # The smallest hashes lie below this bound (about twice as many as are wanted), so few ids are sorted.
        share = min(1.0, (2 * size[value] + 1_000) / max(1, sizes.get(value, 0)))
        bound = int(-(1 << 63) + share * ((1 << 64) - 1))
        near = known.where((F.col("label") == value) & (order <= min(bound, (1 << 63) - 1)))
        part = near.orderBy(order, "doc_id").limit(size[value])
        chosen = part if chosen is None else chosen.union(part)
    # At most so many ids, whatever the table's size.
    joined = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return checkpointed(joined.select("label", "text"))


def _evidence(sample: DataFrame) -> dict[bytes, float]:
    """Words of two toxic documents or more that are more frequent there than in others, and how clearly so; a bounded number of them."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                found = sorted(set(words_of(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.binary())], ["label", "word"])

    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    p, n = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    counted = sample.mapInArrow(run, "label int, word binary").groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    clear = (F.log(a / (p - F.col("a"))) - F.log(b / (n - F.col("b")))) / F.sqrt(1 / a + 1 / b)
    rows = counted.where("a > 1").select("word", clear.alias("z")).where("z > 2").orderBy(F.desc("z"), "word").limit(EVIDENCE).collect()
    return {bytes(r.word): r.z for r in rows}


def _windows(sample: DataFrame, rate, keep: dict[int, int], spread: dict[int, int], sure: bool = False) -> tuple[list[list[bytes]], list[int], list[float]]:
    """For each document its windows with the highest rate, as many as ``keep`` says for its label, and some evenly spread; with labels and rates.

    ``sure``: none of a toxic document whose rates are all zero or less. Otherwise each document has its highest window.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        of = rate()
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                every = [words[a : a + WINDOW] for a in starts(len(words))]
                if not every:
                    continue
                rates = of(every)
                best = sorted(range(len(every)), key=lambda k: (-rates[k], k))[: keep[label]]
                some = np.linspace(0, len(every) - 1, min(spread[label], len(every))).astype(int).tolist() if spread[label] else []
                taken = sorted({k for k in best if rates[k] > 0 or k == best[0] and not (sure and label)} | set(some))
                if not taken:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(taken), pa.int32()), pa.array([every[k] for k in taken], pa.list_(pa.binary())), pa.array([float(rates[k]) for k in taken])], ["label", "words", "rate"])

    rows = sample.mapInArrow(run, "label int, words array<binary>, rate double").toArrow()
    order = sorted(zip(*(rows.column(c).to_pylist() for c in ("words", "label", "rate"))))  # whatever order the tasks ended in
    return [w for w, _, _ in order], [y for _, y, _ in order], [r for _, _, r in order]


def fit(documents: DataFrame, labels: DataFrame, size: tuple[int, int] = SAMPLE, epochs: int = EPOCHS, seed: int = SEED):
    """Weights of the network, or nothing if the labelled documents are of one class."""
    sample = training_sample(documents, labels, size)
    evidence = _evidence(sample)

    def by_evidence():
        return lambda windows: [sum(evidence.get(w, 0.0) for w in set(x)) for x in windows]

    first = {1: POSITIVE_WINDOWS, 0: 1}, {1: 0, 0: NEGATIVE_WINDOWS}
    windows, y, _ = _windows(sample, by_evidence, *first, sure=True)
    if 1 not in y:  # too few toxic documents for evidence
        windows, y, _ = _windows(sample, by_evidence, *first)
    if len(set(y)) < 2:
        return None
    how = {"fixed": frozenset(evidence), "exchange": EXCHANGE if evidence else 0.0, "decay": DECAY}
    weights = recurrent.train(windows, y, WINDOW, epochs, seed, least=LEAST_STEPS, **how)

    for turn in range(1, ROUNDS + 1):
        more, y_more, _ = _windows(sample, _by_network(weights), {1: 1, 0: 2}, {1: 0, 0: 0}, sure=True)
        windows, y = windows + more, y + y_more
        weights = recurrent.train(windows, y, WINDOW, max(1, epochs - 1), seed + turn, weights, rate=0.005, least=LEAST_STEPS // 2, **how)
    _, y_top, top = _windows(sample, _by_network(weights), {1: 1, 0: 1}, {1: 0, 0: 0})
    weights["scale"] = _scale(np.array(top), np.array(y_top, float))
    return weights


def _by_network(weights):
    def rate():
        scorer = recurrent.Scorer(weights)
        return lambda windows: scorer.logits(_places(scorer, windows)).astype(float).tolist()

    return rate


def _scale(logit: np.ndarray, label: np.ndarray, steps: int = 50) -> np.ndarray:
    """Slope and shift that turn a document's highest logit into the odds of its label, by Newton's method with a small penalty."""
    x, w = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - label) + 0.1 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope).clip(-1, 1)
    return w if w[0] > 0 else np.array([1.0, 0.0])


def _places(scorer: recurrent.Scorer, windows: list[list[bytes]]) -> np.ndarray:
    at = np.zeros((len(windows), WINDOW), np.int64)
    flat = scorer.at([w for x in windows for w in x])
    size = np.array([len(x) for x in windows])
    at[np.arange(WINDOW) < size[:, None]] = flat
    return at


def _scores(scorer: recurrent.Scorer, texts: list[list[bytes]]) -> np.ndarray:
    """Highest window of each text; 0 for texts without words."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts))
    if not size.sum():
        return out
    flat = np.concatenate([scorer.at([w for t in texts for w in t]), np.zeros(WINDOW, np.int64)])
    first = np.cumsum(size) - size
    count = np.array([len(starts(n)) for n in size.tolist()])
    owner = np.repeat(np.arange(len(texts)), count)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    inside = begin[:, None] + np.arange(WINDOW)
    at = np.where(inside < size[owner][:, None], flat[np.minimum(first[owner][:, None] + inside, len(flat) - 1)], 0)
    logit = scorer.logits(at)
    has = count > 0
    top = np.maximum.reduceat(logit, (np.cumsum(count) - count)[has])
    slope, shift = scorer.weights["scale"]
    out[has] = 1 / (1 + np.exp(-np.clip(slope * top.astype(np.float64) + shift, -30, 30)))
    return out


def scored(documents: DataFrame, weights, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, score`` of every document. The weights are a few MB, fixed in size."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if weights is None:
        return rows.select("id", F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = recurrent.Scorer(shared.value)
        for batch in batches:
            found, texts, size = [], [], 0
            for text in batch.column("text"):
                texts.append(words_of(text.as_py()))
                size += len(texts[-1])
                if size >= BATCH_WORDS:
                    found.append(_scores(scorer, texts))
                    texts, size = [], 0
            found.append(_scores(scorer, texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double")


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, columns as they were. The network learns from these documents and labels."""
    weights = fit(documents, labels)
    row = fresh(documents, "row")
    carried = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias(row), F.col("text").alias("text"))
    return scored(carried, weights, row, "text").where(F.col("score") < threshold).select("id.*")


@query("op7_toxicity")
def op7_toxicity(spark, folder):
    """Score of every whole document; learned from labelled documents that are not held out."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = scored(documents, fit(documents, table(spark, folder, "labels").select("doc_id", "toxic")))
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
