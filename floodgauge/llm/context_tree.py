"""Context-tree weighting over bytes, in numpy.

A byte is eight binary decisions, made down a binary tree of 255 nodes. For each context (the bytes before, nearest first) and each of these nodes a
Krichevsky-Trofimov estimate counts zeros and ones. The weighted probability of a node is half its own estimate and half the product of its
children's, one byte further back; so contexts of all depths are mixed, by how well each did on the training bytes.

Two forms. ``sparse_levels`` and ``sparse_chances`` work on the counts of all contexts of ``DEPTH`` bytes that share their two nearest bytes, so the whole tree is worked out in
pieces of bounded size. A ``Tree`` is held as a whole: all contexts of up to two bytes and a given number at each greater depth; contexts below a node that are not
in it share one leaf.

A context with its next byte is one number, nearest byte first: ``code``, 40 bits. A node of the binary tree without counts is right half of the time in any context, so a
context that was never seen needs no node of its own.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the longest context; contexts of that length which are broadcast with all their probabilities (99 % of the bytes of the given texts).
DEPTH, NODES = 4, 32_768
#: Stands before a text and ends it; it never occurs in UTF-8.
EDGE = 0xFF
CHUNK = 2_048

_SYMBOL = np.arange(256)
#: For each level: node of the binary tree that a symbol passes, and the bit it takes there.
PATH = [((1 << j) - 1 + (_SYMBOL >> (8 - j)), (_SYMBOL >> (7 - j)) & 1) for j in range(8)]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, seven steps up; for x of at least one half."""
    shift = np.ones_like(x)
    for k in range(7):
        shift *= x + k
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 nodes, from counts of the 256 symbols."""
    zeros, ones = [], []
    for j in range(8):
        part = counts.reshape(len(counts), 1 << j, 2, -1).sum(axis=3)
        zeros.append(part[:, :, 0])
        ones.append(part[:, :, 1])
    return np.concatenate(zeros, axis=1).astype(np.float64), np.concatenate(ones, axis=1).astype(np.float64)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    out = np.zeros_like(zeros)
    some = (zeros + ones) > 0
    a, b = zeros[some], ones[some]
    out[some] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)
    return out


def chance_of_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


class Tree:
    """Nodes in order of depth; ``child[node, byte]`` is the node one byte further back, or -1."""

    def __init__(self):
        self.first = [0, 1]  # first node of each depth, and the end
        self.parent = np.array([-1])
        self.byte = np.zeros(1, np.uint8)  # by which a node is its parent's child
        self.child = np.full((1, 256), -1, np.int32)
        self.counts: list[np.ndarray] = []

    def __getstate__(self):
        """What is not zero: a few bytes for each node and each symbol it counts."""
        sparse = [(np.flatnonzero(c).astype(np.int32), c[c != 0]) for c in self.counts]
        return self.first, self.parent.astype(np.int32), self.byte, sparse

    def __setstate__(self, state):
        self.first, parent, self.byte, sparse = state
        self.parent = parent.astype(np.int64)
        self.child = np.full((len(parent), 256), -1, np.int32)
        self.child[self.parent[1:], self.byte[1:]] = np.arange(1, len(parent))
        self.counts = []
        for d, (place, n) in enumerate(sparse):
            dense = np.zeros((self.first[d + 1] - self.first[d], 256), np.int64)
            dense.reshape(-1)[place] = n
            self.counts.append(dense)

    @property
    def depth(self) -> int:
        return len(self.first) - 2

    def grow(self, parents: np.ndarray, bytes_: np.ndarray) -> None:
        """One more depth: a child of each parent by each byte."""
        order = np.lexsort((bytes_, parents))
        parents, bytes_ = parents[order], bytes_[order]
        new = np.arange(len(parents)) + self.first[-1]
        self.child[parents, bytes_] = new
        self.child = np.concatenate([self.child, np.full((len(new), 256), -1, np.int32)])
        self.parent = np.concatenate([self.parent, parents])
        self.byte = np.concatenate([self.byte, bytes_.astype(np.uint8)])
        self.first.append(self.first[-1] + len(new))

    def walk(self, stream: np.ndarray) -> np.ndarray:
        """Deepest node of the context of each place from ``DEPTH`` on."""
        size = len(stream) - DEPTH
        node = np.zeros(size, np.int64)
        flat = self.child.reshape(-1)
        for d in range(1, self.depth + 1):
            step = np.take(flat, (node << 8) + stream[DEPTH - d : DEPTH - d + size])
            node = np.where(step >= self.first[d], step, node)  # a node that was left earlier has no child of this depth
        return node

    def probabilities(self) -> np.ndarray:
        """Base-10 logarithm of each symbol's probability, for contexts whose deepest node is the row's. ``counts``: one array for each depth."""
        top = self.depth
        own_weight, rest = [None] * (top + 1), [None] * (top + 1)
        below = None  # summed over the children of each node of this depth
        for d in range(top, -1, -1):
            lo, hi = self.first[d], self.first[d + 1]
            counts = self.counts[d]
            weighted = np.empty((hi - lo, 255))
            if d < top:
                left = counts.copy()
                np.subtract.at(left, self.parent[self.first[d + 1] : self.first[d + 2]] - lo, self.counts[d + 1])
                rest[d], own_weight[d] = left, np.empty((hi - lo, 255), np.float32)
            for a in range(0, hi - lo, CHUNK):
                s = slice(a, min(a + CHUNK, hi - lo))
                own = log_estimate(*decisions(counts[s]))
                if d < top:
                    split = below[s] + log_estimate(*decisions(rest[d][s]))
                    own_weight[d][s] = 1 / (1 + np.exp(np.clip(split - own, -700, 700)))
                    own = np.logaddexp(own, split) - np.log(2)
                weighted[s] = own
            if d:
                below = np.zeros((self.first[d] - self.first[d - 1], 255))
                np.add.at(below, self.parent[lo:hi] - self.first[d - 1], weighted)
        out = np.empty((self.first[-1], 256), np.float32)
        sure, open_ = None, None
        for d in range(top + 1):
            lo, hi = self.first[d], self.first[d + 1]
            now = (np.empty((hi - lo, 255), np.float32), np.empty((hi - lo, 255), np.float32)) if d < top else None
            for a in range(0, hi - lo, CHUNK):
                s = slice(a, min(a + CHUNK, hi - lo))
                up = self.parent[lo:hi][s] - (self.first[d - 1] if d else 0)
                base, scale = (sure[up].astype(np.float64), open_[up].astype(np.float64)) if d else (0.0, 1.0)
                one = chance_of_one(*decisions(self.counts[d][s]))
                if d < top:
                    w = own_weight[d][s].astype(np.float64)
                    base, scale = base + scale * w * one, scale * (1 - w)
                    now[0][s], now[1][s] = base, scale
                    one = chance_of_one(*decisions(rest[d][s]))
                p = np.clip(base + scale * one, 1e-12, 1 - 1e-12)
                l1, l0 = np.log10(p), np.log10(1 - p)
                out[lo:hi][s] = sum(np.where(bit, l1[:, node], l0[:, node]) for node, bit in PATH)
            if d < top:
                sure, open_ = now
        return out


def codes(stream: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Context and byte of each place. Bytes further back than ``depth`` are zero: a chain of single children weighs as the last of them."""
    out = stream[at].astype(np.int64)
    for d in range(1, depth + 1):
        out |= stream[at - d].astype(np.int64) << (8 * (DEPTH + 1 - d))
    return out


def added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with the sum of its counts."""
    seen, where = np.unique(code, return_inverse=True)
    return seen, np.bincount(where, n, len(seen)).astype(np.int64)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a node's own estimate, and its weighted probability (logarithm), given its children's."""
    own = log_estimate(zeros, ones)
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - np.log(2)


def sparse_levels(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """For each code and decision its place in the lowest level; then levels of ``DEPTH`` to 2 bytes: context and decision, zeros, ones, own weight, weighted probability, place one level up.

    ``code``: in order and once each, all that occur after the two nearest bytes they have; a count may be 0.
    """
    symbol, steps = code & 255, []
    for node, _ in PATH:
        steps.append(code & ~255 | node[symbol])
    pair, where = np.unique(np.concatenate(steps), return_inverse=True)
    bits = np.concatenate([bit[symbol] for _, bit in PATH])
    times = np.tile(n, 8).astype(np.float64)
    ones, zeros = np.bincount(where, times * bits, len(pair)), np.bincount(where, times * (1 - bits), len(pair))
    levels, weight, weighted = [], None, log_estimate(zeros, ones)
    for d in range(DEPTH, 1, -1):
        up = (pair >> 16 << 8) | (pair & 255)
        parents, link = np.unique(up, return_inverse=True)
        levels.append((pair, zeros, ones, weight, weighted, link))
        if d > 2:
            size = len(parents)
            zeros, ones, below = np.bincount(link, zeros, size), np.bincount(link, ones, size), np.bincount(link, weighted, size)
            weight, weighted = weigh(zeros, ones, below)
            pair = parents
    return where.reshape(8, -1), levels


def sparse_chances(code: np.ndarray, n: np.ndarray, sure: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Base-10 logarithm of the probability of each code's byte. ``sure`` and ``left`` (nearest byte, decision): what contexts of up to one byte add, and the weight left to longer ones."""
    where, levels = sparse_levels(code, n)
    pair = levels[-1][0]
    base, scale = sure[pair >> 16, pair & 255], left[pair >> 16, pair & 255]
    for d, (_, zeros, ones, weight, _, _) in enumerate(reversed(levels)):
        if d:
            link = levels[-1 - d][5]
            base, scale = base[link], scale[link]
        one = chance_of_one(zeros, ones)
        if weight is None:
            chance = np.clip(base + scale * one, 1e-12, 1 - 1e-12)
        else:
            base, scale = base + scale * weight * one, scale * (1 - weight)
    high, low = np.log10(chance), np.log10(1 - chance)
    symbol = code & 255
    return sum(np.where(bit[symbol] == 1, high[place], low[place]) for place, (_, bit) in zip(where, PATH))


def top_levels(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sure`` and ``left`` from the counts after each byte (byte, decision) and the weighted probabilities of its children."""
    weight, weighted = weigh(zeros, ones, below)
    zero, one = zeros.sum(axis=0), ones.sum(axis=0)
    root, _ = weigh(zero, one, weighted.sum(axis=0))
    left = 1 - root
    return root * chance_of_one(zero, one) + left * weight * chance_of_one(zeros, ones), left * (1 - weight)


def stream_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, each between edges; places to predict (bytes and the closing edge); the first of these of each text."""
    line = np.frombuffer(b"".join(b"\xff" * DEPTH + t + b"\xff" for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + DEPTH * np.repeat(np.arange(1, len(texts) + 1), size)
    return line, at, first
