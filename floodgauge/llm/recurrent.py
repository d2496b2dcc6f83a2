"""A small bidirectional gated recurrent network with attention pooling, in numpy: inputs, forward and backward pass, training.

A word's input is the sum of a vector for the word and the mean of vectors for its character n-grams (both hashed), so that a word not seen
in training is judged by its characters. Place 0 of every table of word vectors is the padding.
"""

from __future__ import annotations

import zlib

import numpy as np

WIDTH, HIDDEN, ATTENTION = 12, 8, 8
WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 15
GRAMS = (3, 4, 5)
#: Words that a batch draws its exchanged words from.
POOL = 1_000


def initial(seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
    weights = {"word": np.zeros((WORD_SLOTS, WIDTH), np.float32), "gram": normal(GRAM_SLOTS, WIDTH, scale=0.01)}
    for way in ("f", "b"):
        weights[f"x{way}"] = normal(WIDTH, 3 * HIDDEN, scale=WIDTH**-0.5)
        weights[f"h{way}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        weights[f"c{way}"] = np.zeros(3 * HIDDEN, np.float32)
    weights |= {"wa": normal(2 * HIDDEN, ATTENTION, scale=0.3), "va": normal(ATTENTION, scale=0.5), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
    return weights


class Inputs:
    """Hashed word and character n-gram places of a list of words."""

    def __init__(self, words: list[bytes]):
        self.word = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % WORD_SLOTS
        line = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
        size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        end = np.cumsum(size)
        owner = np.repeat(np.arange(len(words)), size)
        self.parts, self.count = [], np.zeros(len(words), np.float32)
        for n in GRAMS:
            at = np.flatnonzero(np.arange(len(line)) + n <= end[owner]) if len(line) else np.zeros(0, np.int64)
            code = np.full(len(at), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) + line[at + k]
            code ^= code >> np.uint64(29)
            code *= np.uint64(0xBF58476D1CE4E5B9)
            place, own = ((code >> np.uint64(40)) % np.uint64(GRAM_SLOTS)).astype(np.int64), owner[at]
            self.parts.append((place, own))
            self.count += np.bincount(own, minlength=len(words)).astype(np.float32)
        self.count = np.maximum(self.count, 1)

    def vectors(self, weights) -> np.ndarray:
        sums = np.zeros((len(self.word), WIDTH), np.float32)
        for place, own in self.parts:
            if len(own):
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                sums[own[first]] += np.add.reduceat(weights["gram"][place], first, axis=0)
        return weights["word"][self.word] + sums / self.count[:, None]

    def backward(self, gradient: np.ndarray, into: dict[str, np.ndarray]) -> None:
        np.add.at(into["word"], self.word, gradient)
        share = gradient / self.count[:, None]
        for place, own in self.parts:
            np.add.at(into["gram"], place, share[own])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _way(table: np.ndarray, at: np.ndarray, u: np.ndarray, order, keep: list | None) -> np.ndarray:
    """States of one direction; ``table``: inputs already multiplied, ``at``: windows x steps of places in it."""
    h = np.zeros((len(at), HIDDEN), np.float32)
    out = np.empty((at.shape[1], len(at), HIDDEN), np.float32)
    for t in order:
        x, hu = table[at[:, t]], h @ u
        gates = x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        cand = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, cand, hu[:, 2 * HIDDEN :]))
        h = cand + z * (h - cand)
        out[t] = h
    return out


def tables(weights, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors times the input weights of both directions."""
    return tuple(vectors @ weights[f"x{way}"] + weights[f"c{way}"] for way in ("f", "b"))


def forward(weights, both, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of every window; ``at``: windows x steps, 0 where there is no word."""
    steps = range(at.shape[1])
    saved = ([], []) if keep is not None else (None, None)
    states = np.concatenate([
        _way(both[0], at, weights["hf"], steps, saved[0]), _way(both[1], at, weights["hb"], reversed(steps), saved[1]),
    ], axis=2)
    lens = np.tanh(states @ weights["wa"])
    score = lens @ weights["va"]
    score[(at == 0).T] = -30
    share = np.exp(score - score.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", share, states)
    if keep is not None:
        keep.update(states=states, lens=lens, share=share, pooled=pooled, saved=saved)
    return pooled @ weights["out"] + weights["bias"][0]


def gradients(weights, inputs: Inputs, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted log loss and its gradient. ``at`` counts the inputs' words from 1."""
    vectors = np.concatenate([np.zeros((1, WIDTH), np.float32), inputs.vectors(weights)])
    both, kept = tables(weights, vectors), {}
    p = sigmoid(forward(weights, both, at, kept))
    loss = float(-(weight * (label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7))).sum() / weight.sum())
    into = {k: np.zeros_like(v) for k, v in weights.items()}
    d = ((p - label) * weight / weight.sum()).astype(np.float32)
    states, lens, share = kept["states"], kept["lens"], kept["share"]
    into["out"], into["bias"] = kept["pooled"].T @ d, np.array([d.sum()], np.float32)
    d_pool = d[:, None] * weights["out"]
    d_states = share[:, :, None] * d_pool
    d_share = np.einsum("tbh,bh->tb", states, d_pool)
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    d_score[(at == 0).T] = 0
    into["va"] = np.einsum("tba,tb->a", lens, d_score)
    d_lens = d_score[:, :, None] * weights["va"] * (1 - lens**2)
    into["wa"] = np.einsum("tbh,tba->ha", states, d_lens)
    d_states = d_states + d_lens @ weights["wa"].T
    d_vectors = np.zeros_like(vectors)
    for way, saved, half in (("f", kept["saved"][0], slice(0, HIDDEN)), ("b", kept["saved"][1], slice(HIDDEN, None))):
        d_h, u = np.zeros((len(at), HIDDEN), np.float32), weights[f"h{way}"]
        d_table = np.zeros_like(both[0])
        for t, h, z, r, cand, hu in reversed(saved):
            d_h = d_h + d_states[t][:, half]
            d_cand = d_h * (1 - z) * (1 - cand**2)
            d_z = d_h * (h - cand) * z * (1 - z)
            d_r = d_cand * hu * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_cand], axis=1)
            d_hu = np.concatenate([d_z, d_r, d_cand * r], axis=1)
            into[f"h{way}"] += h.T @ d_hu
            d_h = d_h * z + d_hu @ u.T
            np.add.at(d_table, at[:, t], d_x)
        into[f"x{way}"] = vectors.T @ d_table
        into[f"c{way}"] = d_table.sum(axis=0)
        d_vectors += d_table @ weights[f"x{way}"].T
    inputs.backward(d_vectors[1:], into)
    return loss, into


def train(windows: list[list[bytes]], labels: list[int], steps: int, epochs: int, seed: int, weights=None, batch: int = 384, rate: float = 0.01, least: int = 0, fixed=frozenset(), exchange: float = 0.0, decay: float = 0.0):
    """Weights after so many epochs of Adam, and ``least`` steps at least. A batch holds windows of both labels, up to a third of them positive.

    In each batch a share ``exchange`` of the words that are not ``fixed`` gives way to words drawn from the windows with label 0, so that the words that happen to stand
    in a positive window cannot be learned by heart. ``decay`` shrinks the tables of words and grams at each step.
    """
    draw = np.random.default_rng(seed)
    weights = {k: v.copy() for k, v in (weights or initial(seed)).items()}
    label = np.array(labels, np.float32)
    weight = np.ones(len(label), np.float32)
    positive, negative = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    other = [w for k in negative for w in windows[k]]
    mean, square = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, max(least, -(-epochs * len(windows) // batch)) + 1):
        some = draw.choice(positive, min(4 * len(positive), batch // 3))
        chosen = np.concatenate([some, draw.choice(negative, batch - len(some))])
        names: dict[bytes, int] = {}
        at = np.zeros((len(chosen), steps), np.int64)
        pool = [other[j] for j in draw.integers(0, len(other), POOL)] if exchange and other else []
        for row, k in enumerate(chosen):
            words = windows[k]
            if pool:
                swap, new = (draw.random(len(words)) < exchange).tolist(), draw.integers(0, POOL, len(words)).tolist()
                words = [pool[j] if s and w not in fixed else w for w, s, j in zip(words, swap, new)]
            at[row, : len(words)] = [names.setdefault(w, len(names) + 1) for w in words]
        _, into = gradients(weights, Inputs(list(names)), at, label[chosen], weight[chosen])
        for k, g in into.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
        for k in ("word", "gram") if decay else ():
            weights[k] *= 1 - decay * rate
    return weights


class Scorer:
    """Scores windows with a table of the words met so far; it starts anew when the table is full."""

    def __init__(self, weights, words: int = 150_000):
        self.weights, self.most = weights, words
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        zero = tables(self.weights, np.zeros((1, WIDTH), np.float32))
        self.both = [np.empty((1024, 3 * HIDDEN), np.float32) for _ in zero]
        for table, row in zip(self.both, zero):
            table[0] = row[0]

    def at(self, words: list[bytes]) -> np.ndarray:
        """Places of the words, new ones entered first."""
        if len(self.places) > self.most:
            self.clear()
        new = list({w: None for w in words if w not in self.places})
        if new:
            first, need = len(self.places) + 1, len(self.places) + 1 + len(new)
            found = tables(self.weights, Inputs(new).vectors(self.weights))
            for k in (0, 1):
                if need > len(self.both[k]):
                    self.both[k] = np.concatenate([self.both[k], np.empty((need + need // 2 - len(self.both[k]), 3 * HIDDEN), np.float32)])
                self.both[k][first:need] = found[k]
            self.places.update(zip(new, range(first, need)))
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))

    def logits(self, at: np.ndarray, rows: int = 2048) -> np.ndarray:
        return np.concatenate([forward(self.weights, self.both, at[a : a + rows]) for a in range(0, len(at), rows)]) if len(at) else np.zeros(0, np.float32)
