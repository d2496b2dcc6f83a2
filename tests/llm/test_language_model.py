"""Context-tree weighting and the unigram against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgauge.llm import context_tree as ct
from floodgauge.llm import language_model as lm


class Brute:
    """Weighted probability of a text collection by recursion over contexts, with one shared leaf for what is not in the tree."""

    def __init__(self, texts, in_tree, depth):
        self.counts, self.in_tree, self.depth = defaultdict(Counter), in_tree, depth
        for t in texts:
            line = bytes([ct.EDGE] * ct.DEPTH) + t + bytes([ct.EDGE])
            for i in range(ct.DEPTH, len(line)):
                self.add(line[max(0, i - depth) : i][::-1], line[i], 1)

    def path(self, context):
        """Nodes of a context from the root; a tuple ending in None is the shared leaf of a node."""
        out = [()]
        for k in range(self.depth):
            nxt = tuple(context[: k + 1])
            if nxt not in self.in_tree:
                return [*out, (*out[-1], None)]
            out.append(nxt)
        return out

    def add(self, context, symbol, by):
        for node in self.path(context):
            for j in range(8):
                self.counts[node][(1 << j) - 1 + (symbol >> (8 - j)), (symbol >> (7 - j)) & 1] += by

    def log_weighted(self, node, k):
        a, b = self.counts[node][k, 0], self.counts[node][k, 1]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if (node and node[-1] is None) or len(node) == self.depth:
            return own
        split = sum(self.log_weighted(c, k) for c in list(self.counts) if len(c) == len(node) + 1 and c[:-1] == node)
        return np.logaddexp(own, split) - math.log(2)

    def log10_next(self, context, symbol):
        """By the ratio of weighted probabilities with and without the symbol."""
        ks = [(1 << j) - 1 + (symbol >> (8 - j)) for j in range(8)]
        before = sum(self.log_weighted((), k) for k in ks)
        self.add(context, symbol, 1)
        after = sum(self.log_weighted((), k) for k in ks)
        self.add(context, symbol, -1)
        return (after - before) / math.log(10)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 10.5, 1e3, 1e8])
    assert np.allclose(ct.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-8, atol=1e-9)


def test_probabilities_sum_to_one_and_equal_recursion(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("aab b") for _ in range(draw.randrange(0, 25))) for _ in range(12)]
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tree = lm.context_tree(training, lm.first_counts(training), depth=4, nodes=9)
    chance = tree.probabilities()
    assert np.allclose((10.0 ** chance.astype(float)).sum(axis=1), 1, atol=1e-4)
    names = {0: ()}
    for node in range(tree.first[-1]):
        for byte in np.flatnonzero(tree.child[node] >= 0):
            names[int(tree.child[node, byte])] = (*names[node], int(byte))
    assert [b - a for a, b in zip(tree.first, tree.first[1:])][3:] == [9, 9]
    brute = Brute([t.encode() for t in texts], set(names.values()), 4)
    stream, at, first = ct.stream_of([b"ab ba", b"", b"bbz"])
    own = chance[tree.walk(stream)[at - ct.DEPTH], stream[at]]
    for i, p in zip(at, own):
        assert p == pytest.approx(brute.log10_next(tuple(stream[i - 4 : i][::-1].tolist()), int(stream[i])), abs=1e-4)


def unigram(docs, train):
    words = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t in docs if train(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in docs}


def test_scores_and_edge_cases(spark):
    draw = random.Random(8)
    docs = [(i, " ".join(draw.choice(["tHe", "of", "é", f"w{draw.randrange(90)}"]) for _ in range(draw.choice((3, 30))))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "x" * 300_000), (103, "only here\x0band\x1chere"), (None, "no id the")]
    df = spark.createDataFrame(docs + docs[:2], "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(4)
    train = lambda i: i is None or i % 3 != 1
    got = lm.scored(df, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True)), frequent=5).collect()
    assert len(got) == len(docs) + 2
    want = unigram(docs + docs[:2], train)
    for r in got:
        n, known, total, base = want[r.id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    assert lm.scored(df.limit(0), F.lit(True)).count() == 0
    nothing = lm.scored(df.limit(3), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score == pytest.approx(-(r.n_bytes + 1) * math.log10(256), rel=1e-4) for r in nothing)


def test_query(spark, folder):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = unigram(docs, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    got = lm.op5_lm_score(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert np.mean([r.bits_per_byte for r in held]) < 4


@pytest.mark.parametrize("nodes", [0, 6, 32_768])
def test_every_context_counts_whatever_is_broadcast(spark, nodes):
    draw = random.Random(5)
    docs = [(i, "".join(draw.choice("aab b") for _ in range(draw.randrange(0, 25)))) for i in range(16)] + [(16, "zz ab"), (17, "")]
    learn = lambda i: i % 4 != 1 and i < 16
    texts = [t.encode() for i, t in docs if learn(i)]
    lines = [bytes([ct.EDGE] * ct.DEPTH) + t + bytes([ct.EDGE]) for t in texts]
    every = {line[i - d : i][::-1] for line in lines for i in range(ct.DEPTH, len(line)) for d in range(ct.DEPTH + 1)}
    brute = Brute(texts, {tuple(c) for c in every}, ct.DEPTH)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.id: r.score for r in lm.scored(df, (F.col("doc_id") % 4 != 1) & (F.col("doc_id") < 16), nodes=nodes).collect()}
    assert len(got) == len(docs)
    for i, t in [d for d in docs if d[0] in (0, 1, 5, 16, 17)]:
        line = bytes([ct.EDGE] * ct.DEPTH) + t.encode() + bytes([ct.EDGE])
        want = sum(brute.log10_next(tuple(line[p - 4 : p][::-1]), line[p]) for p in range(ct.DEPTH, len(line)))
        assert got[i] == pytest.approx(want, abs=1e-4)
