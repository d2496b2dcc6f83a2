"""Language-model scores of documents: a unigram of words as the base, and context-tree weighting over bytes.

Both count every training document, and the byte tree holds every context of four bytes that occurs. Neither is bounded in size: the ``FREQUENT`` most frequent words and the ``NODES`` most frequent
contexts, with the probabilities of all bytes after them, are broadcast; all others are looked up by joins, to which each document brings each rare word and each
rare context with its byte once. So nothing frequent is a key of a shuffle, and the scores do not depend on how much is broadcast. The tree is weighed in pieces: contexts with the same two nearest bytes meet in one
task, and sums over shorter ones (at most 65,280) on the driver.

Edge cases: a null or empty text has one token, its end. A document without id is learned from and not held out. Repeated rows are scored one by one.
Without training documents the base of every token is log10(1) = 0 and every byte has the probability 1/256. An empty table gives an empty result.
"""

from __future__ import annotations

import copy
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import query, table
from floodgauge.llm.context_tree import DEPTH, EDGE, NODES, Tree, added, codes, sparse_chances, sparse_levels, stream_of, top_levels
from floodgauge.session import checkpointed

FREQUENT = 100_000
#: Bytes worked on together, and distinct words a task gathers before it hands them on.
STREAM_BYTES, GATHERED = 1_000_000, 200_000
#: Codes worked on together, and distinct codes a task gathers before it hands them on.
PIECE, CODES = 4_000, 1_000_000
#: Kinds of counts: contexts with their next byte, contexts with the byte before them, words, codes of whole contexts. The end of a text is the empty word.
NEXT, BEFORE, WORD, CODE = 0, 1, 2, 3
COUNTS = "kind int, code bigint, word binary, n bigint"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts as UTF-8, in lists of about ``STREAM_BYTES``."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= STREAM_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count_batch(kind: int, codes: np.ndarray, n: np.ndarray, words: list[bytes] | None = None) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int32)), pa.array(codes, pa.int64()), pa.array(words if words is not None else [None] * size, pa.binary()), pa.array(n, pa.int64())],
        ["kind", "code", "word", "n"],
    )


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind", "code", "word").agg(F.sum("n").alias("n"))


def word_and_code_counts(training: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Words, and contexts with their next byte, of all training texts; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        code, n, words = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
        for texts in _groups(batches):
            stream, at, _ = stream_of(texts)
            here, times = np.unique(codes(stream, at, depth), return_counts=True)
            code, n = added(np.concatenate([code, here]), np.concatenate([n, times]))
            if len(code) > CODES:
                yield _count_batch(CODE, code, n)
                code, n = code[:0], n[:0]
            for t in texts:
                words.update(t.lower().split())
            words[b""] += len(texts)
            if len(words) > GATHERED:
                yield _word_batch(words)
                words.clear()
        yield _count_batch(CODE, code, n)
        yield _word_batch(words)

    return checkpointed(_summed(training.mapInArrow(run, COUNTS)))


def _word_batch(words: Counter) -> pa.RecordBatch:
    keys = list(words)
    return _count_batch(WORD, np.zeros(len(keys), np.int64), np.fromiter(words.values(), np.int64, len(keys)), keys)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted codes and their counts, cut where the two nearest bytes change, in pieces of about ``PIECE``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        code, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
        for a in range(0, len(code), PIECE):
            part = code[a : a + PIECE]
            change = np.flatnonzero(np.diff(part >> 24, prepend=held[-1][0][-1] >> 24 if held else part[0] >> 24))
            if len(change):
                cut = int(change[-1])
                held.append((part[:cut], n[a : a + cut]))
                yield tuple(np.concatenate(c) for c in zip(*held))
                held = [(part[cut:], n[a + cut : a + PIECE])]
            else:
                held.append((part, n[a : a + PIECE]))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _in_pieces(counts: DataFrame) -> DataFrame:
    return counts.repartition(F.shiftright("code", 24)).sortWithinPartitions("code").select("code", "n")


def _top(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What contexts of up to one byte add to the probability of each decision, and the weight left to longer ones."""

    def run(batches: Iterator[pa.RecordBatch]):
        for code, n in _pieces(batches):
            pair, zeros, ones, _, weighted, link = sparse_levels(code, n)[1][-1]
            size, up = int(link.max()) + 1, np.unique((pair >> 16 << 8) | (pair & 255))
            yield pa.RecordBatch.from_arrays([pa.array(up), *(pa.array(np.bincount(link, c, size)) for c in (zeros, ones, weighted))], ["at", "zeros", "ones", "below"])

    found = _in_pieces(counts).mapInArrow(run, "at bigint, zeros double, ones double, below double").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    rows, dense = found.toArrow(), np.zeros((3, 256 * 256))  # at most 256 x 255
    for c, name in enumerate(("zeros", "ones", "below")):
        dense[c, rows.column("at").to_numpy()] = rows.column(name).to_numpy()
    return top_levels(*dense.reshape(3, 256, 256))


def _all_chances(counts: DataFrame, contexts: np.ndarray, shared) -> np.ndarray:
    """Logarithms of the probabilities of all bytes after each of the contexts, which are sorted and few."""
    wanted = counts.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]):
        contexts, (sure, left) = wanted.value, shared.value
        for code, n in _pieces(batches):
            here = np.intersect1d(contexts, code >> 8)
            if len(here):
                whole = ((here << 8)[:, None] | np.arange(256)).reshape(-1)
                code, n = added(np.concatenate([code, whole]), np.concatenate([n, np.zeros(len(whole), np.int64)]))
                table = sparse_chances(code, n, sure, left)[np.searchsorted(code, whole)].astype(np.float32).reshape(-1, 256)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array([row.tobytes() for row in table], pa.binary())], ["context", "chances"])

    rows = _in_pieces(counts).mapInArrow(run, "context bigint, chances binary").toArrow()  # as many as ``contexts``
    out = np.zeros((len(contexts), 256), np.float32)
    for batch in rows.to_batches():
        if len(batch):
            out[np.searchsorted(contexts, batch.column("context").to_numpy())] = np.frombuffer(b"".join(batch.column("chances").to_pylist()), np.float32).reshape(-1, 256)
    wanted.destroy()
    return out


def _chances(counts: DataFrame, asked: DataFrame, shared) -> DataFrame:
    """Logarithm of the probability of each code that is asked for, whether it was counted or not."""

    def run(batches: Iterator[pa.RecordBatch]):
        sure, left = shared.value
        for code, n in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(sparse_chances(code, n, sure, left))], ["code", "chance"])

    both = counts.unionByName(asked.select("code", F.lit(0).cast("long").alias("n"))).groupBy("code").agg(F.sum("n").alias("n"))
    return _in_pieces(both).mapInArrow(run, "code bigint, chance double")


def first_counts(training: DataFrame) -> DataFrame:
    """Words, and bytes after two others, of all training texts; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        triples, words = np.zeros(1 << 24, np.int32), Counter()

        for texts in _groups(batches):
            stream, at, _ = stream_of(texts)
            wide = stream.astype(np.int32)
            np.add.at(triples, ((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:])[at - 2], np.int32(1))
            for t in texts:
                words.update(t.lower().split())
            words[b""] += len(texts)
            if len(words) > GATHERED:
                yield _word_batch(words)
                words.clear()
        seen = np.flatnonzero(triples)
        yield _count_batch(NEXT, seen, triples[seen])
        yield _word_batch(words)

    return checkpointed(_summed(training.mapInArrow(run, COUNTS)))


def deeper_counts(training: DataFrame, tree: Tree, further: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the deepest nodes of the tree: counts of the next byte, and of the byte before the context if the tree grows ``further``."""
    lo, size = tree.first[-2], tree.first[-1] - tree.first[-2]
    shape = copy.copy(tree)
    shape.counts = []
    shared = training.sparkSession.sparkContext.broadcast(shape)

    def run(batches: Iterator[pa.RecordBatch]):
        tree = shared.value
        found = [np.zeros(size * 256, np.int32) for _ in range(1 + further)]
        for texts in _groups(batches):
            stream, at, _ = stream_of(texts)
            node = tree.walk(stream)[at - DEPTH] - lo
            at, node = at[node >= 0], node[node >= 0]
            np.add.at(found[0], (node << 8) + stream[at], np.int32(1))
            if further:
                np.add.at(found[1], (node << 8) + stream[at - tree.depth - 1], np.int32(1))
        for kind, counts in enumerate(found):
            seen = np.flatnonzero(counts)
            yield _count_batch(kind, seen, counts[seen])

    rows = _summed(training.mapInArrow(run, COUNTS)).select("kind", "code", "n").toArrow()  # at most 256 for each node
    shared.destroy()
    out = []
    for kind in (NEXT, BEFORE):
        dense = np.zeros(size * 256, np.int64)
        part = rows.filter(pa.compute.equal(rows.column("kind"), kind))
        dense[part.column("code").to_numpy()] = part.column("n").to_numpy()
        out.append(dense.reshape(size, 256))
    return out[0], out[1]


def context_tree(training: DataFrame, counts: DataFrame, depth: int = DEPTH, nodes: int = 8_192) -> Tree:
    """A tree that is held as a whole, of ``nodes`` contexts at each depth beyond two, with the counts of all its nodes. ``scored`` weighs all contexts instead."""
    rows = counts.where(F.col("kind") == NEXT).select("code", "n").toArrow()  # at most 256^3, whatever the input
    code, n = rows.column("code").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)
    back, near, symbol = code >> 16, code >> 8 & 255, code & 255
    tree = Tree()
    near_seen = np.unique(near)
    tree.grow(np.zeros(len(near_seen), np.int64), near_seen)
    pairs = np.unique(near << 8 | back)
    tree.grow(tree.child[0, pairs >> 8].astype(np.int64), pairs & 255)
    second = tree.child[tree.child[0, near], back] - tree.first[2]
    deep = np.zeros((tree.first[3] - tree.first[2], 256), np.int64)
    np.add.at(deep, (second, symbol), n)
    first = np.zeros((tree.first[2] - tree.first[1], 256), np.int64)
    np.add.at(first, tree.parent[tree.first[2] : tree.first[3]] - 1, deep)
    tree.counts = [first.sum(axis=0, keepdims=True), first, deep]
    # Three bytes in a row are also a context of three bytes, except at a text's end.
    inner = symbol != EDGE
    parent, byte, size = _placed(tree, near[inner], symbol[inner]), back[inner], n[inner]
    for d in range(3, depth + 1):
        known = parent >= 0
        parent, byte, size = parent[known], byte[known], size[known]
        top = np.lexsort((byte, parent, -size))[:nodes]
        tree.grow(parent[top], byte[top])
        own, before = deeper_counts(training, tree, d < depth)
        tree.counts.append(own)
        node, byte = np.nonzero(before)
        parent, size = node + tree.first[-2], before[node, byte]
    return tree


def _placed(tree: Tree, second: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Nodes of two-byte contexts, -1 where there is none."""
    up = tree.child[0, first]
    return np.where(up >= 0, tree.child[up, second], -1).astype(np.int64)


_MODEL: dict[str, tuple] = {}


def _model(shared):
    """The broadcast words, and a tree that leads to the rows of the broadcast probabilities; a worker keeps the last one only."""
    name, contexts, chances, known, end = shared.value
    if name not in _MODEL:
        _MODEL.clear()
        tree, parent, place = Tree(), np.zeros(len(contexts), np.int64), None
        for d in range(1, DEPTH + 1):
            byte = contexts >> (8 * (DEPTH - d)) & 255
            step, place = np.unique(parent << 8 | byte, return_inverse=True)
            tree.grow(step >> 8, step & 255)
            parent = place + tree.first[-2]
        _MODEL[name] = tree, chances.reshape(-1), known, end
    return _MODEL[name]


def _least_frequent(words: DataFrame, frequent: int) -> int:
    """Smallest count, on a scale of sixteenths of an octave, that at most ``frequent`` words reach. Words are never sorted as a whole."""
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    taken, least = 0, 1 << 62
    for row in steps:  # at most a thousand
        taken += row.words
        if taken > frequent:
            break
        least = row.least
    return least


def _rare_codes(code: np.ndarray, text: np.ndarray, size: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each of ``size`` texts its distinct codes and how often it has them."""
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    times = np.diff(new, append=len(code)).astype(np.int32)
    bounds = pa.array(np.searchsorted(text[new], np.arange(size + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, pa.array(code[new])), pa.ListArray.from_arrays(bounds, pa.array(times))


SCORED = "n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint, rare array<binary>, times array<int>, codes array<bigint>, code_times array<int>"


def scored(documents: DataFrame, is_training, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score, n_bytes`` of every document; scores are base-10 logarithms.

    ``is_training``: condition on the documents that are learned from.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), is_training.alias("learn"))
    training = rows.where("learn").select("text")
    counts = word_and_code_counts(training, depth)
    words = counts.where(F.col("kind") == WORD).select("word", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total = facts.n + 0.5 * (facts.v + 1)
    value = lambda c: np.log10((c + 0.5) / total)
    known = {bytes(r.word): float(value(r.n)) for r in words.where(F.col("n") >= _least_frequent(words, frequent)).collect()}
    end = words.where(F.col("word") == b"").select("n").collect()
    known[b""] = float(value(end[0].n if end else 0))
    contexts_of = counts.where(F.col("kind") == CODE).select("code", "n")
    by_context = contexts_of.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("n"))
    top = spark.sparkContext.broadcast(_top(contexts_of))
    contexts = np.sort(by_context.where(F.col("n") >= _least_frequent(by_context, nodes)).select("context").toArrow().column("context").to_numpy())  # at most ``nodes``
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, contexts, _all_chances(contexts_of, contexts, top), known, bool(end)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        tree, flat, known, end_known = _model(shared)
        get, lowest = known.get, tree.first[DEPTH]
        for batch in batches:
            base, score, rest = [], [], []
            for texts in _groups([batch]):
                stream, at, first = stream_of(texts)
                node = tree.walk(stream)[at - DEPTH] - lowest
                there = node >= 0
                each = np.zeros(len(at))
                each[there] = flat[(node[there] << 8) + stream[at[there]]]
                score.append(np.add.reduceat(each, first))
                rest.append(_rare_codes(codes(stream, at[~there], depth), np.searchsorted(first, np.flatnonzero(~there), "right") - 1, len(texts)))
                for t in texts:
                    split = t.lower().split()  # as spaced_words does
                    found = list(map(get, split))
                    rare = Counter(w for w, v in zip(split, found) if v is None) if None in found else {}
                    values = [v for v in found if v is not None]
                    base.append((len(split) + 1, len(values) + end_known, sum(values) + known[b""], len(t), list(rare), list(rare.values())))
            n, hits, base_sum, size, rare, times = zip(*base) if base else ((),) * 6
            code, code_times = (pa.concat_arrays(c) for c in zip(*rest)) if rest else (pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(base_sum, pa.float64()), pa.array(np.concatenate(score) if score else [], pa.float64()),
                pa.array(size, pa.int64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), code, code_times,
            ], ["id", *(c.split()[0] for c in SCORED.split(", "))])

    parts = rows.select("id", "text").mapInArrow(run, f"id {kind}, {SCORED}").withColumn("key", F.monotonically_increasing_id())
    parts = checkpointed(parts)  # the keys are fixed from here on
    each = parts.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    placed = each.join(words, "word", "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = placed.groupBy("key").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(float(total)))).alias("rest"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
    )
    each = parts.select("key", F.explode(F.arrays_zip("codes", "code_times")).alias("r")).select("key", F.col("r.codes").alias("code"), F.col("r.code_times").alias("times"))
    chances = _chances(contexts_of, each.select("code").distinct(), top)
    further = each.join(chances, "code").groupBy("key").agg(F.sum(F.col("times") * F.col("chance")).alias("further"))
    return parts.join(sums, "key", "left").join(further, "key", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(facts.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("further", F.lit(0.0))).alias("score"), "n_bytes",
    )


@query("op5_lm_score")
def op5_lm_score(spark, folder):
    """Base and context-tree scores of every whole document; a fifth, by the checksum of the id, is held out."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 1, F.lit(False))
    found = scored(documents, ~held)
    own = F.coalesce(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % 5 == 1, F.lit(False))
    bits = -F.col("score") * float(np.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return found.select(
        F.col("id").alias("doc_id"), own.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"),
    )
