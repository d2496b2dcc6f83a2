"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors become whole numbers, so the scatter of the fit list is exact: each task multiplies its rows, centred at the whole number next to
the mean, and sums of products are added as decimals; what the mean lies beside that number is put right in whole numbers too. The result does not depend on
partitions, and directions of small variance beside large ones keep their digits. The driver holds one matrix of dimensions x dimensions.
Cholesky with the largest remaining diagonal as pivot gives ``V = G G'`` with a triangular ``G`` (rows in pivot order); rotations of pairs of its
columns make them orthogonal. Their squared norms are the eigenvalues, the columns divided by their norms the components.

Edge cases: vectors that are null, empty or hold a null, NaN or infinite entry are dropped. Entries beyond 2^52 in units of ``1 / scale`` are held at that
bound. Vectors of different lengths are different spaces, each with a fit of its own. Repeated rows count once in the fit and come back one by one; so do rows with a null id. Components
stop at the rank: directions in which the fit list does not vary have no row, a fit list of one vector none at all. ``deviation`` is null beyond 38 digits (in the query: beyond a
long). An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import query, table
from floodgauge.session import scratch_path

SCALE, OFFSET, BOUND = 64, 1_000_000, 1 << 52
#: Products of whole numbers below this sum exactly in doubles, as long as their sum stays below 2^53.
EXACT = 1 << 53
SWEEPS = 60
EPS = float(np.finfo(np.float64).eps)


def whole_vectors(vectors: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """``floor(scale * entry) + offset`` as longs; null for vectors that are to be dropped."""
    bad = F.exists(vectors, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    number = lambda c: F.floor(F.least(F.greatest(c.cast("double") * float(scale), F.lit(-float(BOUND))), F.lit(float(BOUND)))) + F.lit(offset)
    return F.when((F.size(vectors) > 0) & ~bad, F.transform(vectors, number))


def _matrices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows and their vectors as a matrix, for each length of vectors."""
    column = batch.column(name)
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def _products(z: np.ndarray) -> np.ndarray:
    """``z' z``, exact; whole numbers of any size."""
    largest = int(np.abs(z).max(initial=0))
    if largest * largest < EXACT >> 8:
        step, out = max(1, EXACT // max(1, largest * largest) - 1), np.zeros((z.shape[1],) * 2, object)
        for at in range(0, len(z), step):
            part = z[at : at + step].astype(np.float64)
            out += (part.T @ part).astype(np.int64).astype(object)
        return out
    wide = z.astype(object)
    return wide.T @ wide


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vectors their number and the sums of their entries."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                kept = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                kept[0] += len(at)
                kept[1] = kept[1] + (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & ((1 << 20) - 1)).sum(axis=0).astype(object)
        rows = [(size, i, n, Decimal(int(s))) for size, (n, total) in found.items() for i, s in enumerate(total)]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["size", "i", "n", "s"])

    parts = fit.select("x").mapInArrow(run, "size int, i int, n bigint, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("size", "i").collect():
        out.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    return out


def scatter(fit: DataFrame, centres: dict[int, list[int]]) -> dict[int, np.ndarray]:
    """For each length of vectors the sums of products of entries less their centres, as exact whole numbers."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch, "x"):
                part = _products(x - np.array(centres[x.shape[1]], np.int64))
                found[x.shape[1]] = found[x.shape[1]] + part if x.shape[1] in found else part
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.decimal128(38, 0)))
        for size, total in found.items():
            for i in range(size):
                row = [Decimal(int(v)) for v in total[i, i:]]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((size, i, row), kinds)], ["size", "i", "v"])

    parts = fit.select("x").mapInArrow(run, "size int, i int, v array<decimal(38,0)>")
    cells = parts.select("size", "i", F.posexplode("v").alias("k", "v")).groupBy("size", "i", "k").agg(F.sum("v").alias("v"))
    out = {size: np.zeros((size, size), object) for size in centres}
    for r in cells.toLocalIterator():
        out[r["size"]][r["i"], r["i"] + r["k"]] = out[r["size"]][r["i"] + r["k"], r["i"]] = int(r["v"])
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``G`` with ``G G' = a`` for a symmetric matrix without negative eigenvalues: one column for each of its rank.

    Column by column the largest remaining diagonal is the pivot. An entry whose remainder is no more than its rounding is taken as
    dependent on the columns so far, by the measure of its own size.
    """
    size = len(a)
    whole, rest, used = np.diag(a).astype(np.float64).copy(), np.diag(a).astype(np.float64).copy(), np.zeros(size, bool)
    out = np.zeros((size, size))
    rank = 0
    floor = 8 * size * EPS * whole
    while rank < size:
        rest[used | (rest <= floor)] = 0
        pivot = int(np.argmax(rest))
        if rest[pivot] <= 0:
            break
        column = a[:, pivot] - out[:, :rank] @ out[pivot, :rank]
        column[used] = 0
        out[:, rank] = column / np.sqrt(rest[pivot])
        out[pivot, rank] = np.sqrt(rest[pivot])
        rest = rest - out[:, rank] ** 2
        used[pivot] = True
        rank += 1
    return out[:, :rank]


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of pairs without a common column."""
    ring = np.arange(n + n % 2)
    for _ in range(len(ring) - 1):
        left, right = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
        real = (left < n) & (right < n)
        yield left[real], right[real]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def jacobi(g: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and normalised columns of ``g`` rotated until its columns are orthogonal."""
    g = g[:, np.argsort(-(g * g).sum(axis=0), kind="stable")].copy()
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(g.shape[1]):
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            open_ = np.abs(c) > 4 * EPS * np.sqrt(a) * np.sqrt(b)
            if not open_.any():
                continue
            turned = True
            p, q, a, b, c = (v[open_] for v in (p, q, a, b, c))
            tau = (b - a) / (2 * c)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            x, y = g[:, p], g[:, q]
            g[:, p], g[:, q] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    norms = (g * g).sum(axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], g[:, order] / np.sqrt(norms[order])


@dataclass
class Space:
    """A fit: rows of the list, sums, eigenvalues (falling), components as columns, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]


def decomposed(n: int, totals: list[int], products: np.ndarray) -> Space:
    """The covariance (divisor n) from exact sums and products about ``centre``, and its components."""
    space = Space(n, totals, np.zeros(0), np.zeros((len(totals), 0)), 0.0)
    beside = np.array([s - n * c for s, c in zip(totals, space.centre)], object)
    exact = products * n - np.outer(beside, beside)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in exact], np.float64).reshape(len(totals), len(totals))
    space.trace = int(sum(np.diag(exact))) / (n * n)
    space.values, space.components = jacobi(pivoted_cholesky(covariance))
    if len(space.values):
        sign = np.sign(space.components[np.abs(space.components).argmax(axis=0), np.arange(len(space.values))])
        space.components = space.components * sign
    return space


def _projected(space: Space, x: np.ndarray) -> np.ndarray:
    """Rows centred and projected, each component at unit variance."""
    centre = np.array(space.centre, np.int64)
    beside = np.array([(s - space.n * c) / space.n for s, c in zip(space.sums, space.centre)])
    centred = (x - centre).astype(np.float64) - beside
    return centred @ space.components / np.sqrt(space.values)


def _deviations(space: Space, x: np.ndarray) -> list[int]:
    z = x - np.array(space.centre, np.int64)
    beside = np.array([s - space.n * c for s, c in zip(space.sums, space.centre)], object)
    most = (int(np.abs(z).max(initial=0)) + 1) * space.n
    kind = np.int64 if most * most * x.shape[1] < 1 << 62 else object
    apart = z.astype(kind) * space.n - beside.astype(kind)
    return [int(v) for v in (apart * apart).sum(axis=1)]


def identity_errors(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """For each length of vectors the largest entry by which the covariance of its whitened fit list is not the identity, measured on the list."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch, "x"):
                z = _projected(spaces[x.shape[1]], x)
                z = np.column_stack([np.ones(len(z)), z])
                found[x.shape[1]] = found.get(x.shape[1], 0) + z.T @ z
        for size, total in found.items():
            columns = [pa.array([size], pa.int32()), pa.array([total.shape[1]], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["size", "k", "v"])

    parts = fit.select("x").mapInArrow(run, "size int, k int, v array<double>")
    cells = parts.select("size", "k", F.posexplode("v").alias("i", "v")).groupBy("size", "k", "i").agg(F.sum("v").alias("v")).collect()
    total = {(r["size"], r["i"]): r["v"] for r in cells}
    out = {}
    for size, k in {(r["size"], r["k"]) for r in cells}:
        m = np.array([total[size, i] for i in range(k * k)]).reshape(k, k) / spaces[size].n
        out[size] = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k - 1)).max(initial=0))
    return out


def fitted(fit: DataFrame) -> dict[int, Space]:
    """A space for each length of vectors ``x`` in the list, each vector once."""
    totals = sums(fit)
    centres = {size: Space(n, s, None, None, 0.0).centre for size, (n, s) in totals.items()}
    products = scatter(fit, centres)
    return {size: decomposed(n, s, products[size]) for size, (n, s) in totals.items()}


def whitened(
    embeddings: DataFrame, components: int = 16, scale: int = SCALE, offset: int = OFFSET, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: one row for each vector and component, the largest eigenvalue first.

    The fit list is every distinct whole vector; it is written once to the shared folder.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_column).alias("id"), whole_vectors(F.col(vector_column), scale, offset).alias("x")).where("x is not null")
    path = scratch_path(spark, "whitening-fit")
    rows.select("x").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    spaces = fitted(fit)
    spaces = {size: replace(s, values=s.values[:components], components=s.components[:, :components]) for size, s in spaces.items()}
    errors = identity_errors(fit, spaces)

    def run(batches):
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                space = spaces[x.shape[1]]
                z = _projected(space, x)
                k = z.shape[1]
                deviation = [Decimal(d) if d < 10**38 else None for d in _deviations(space, x)]
                share = space.values / space.trace if k else np.zeros(0)
                each = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), space.n, np.int64)), pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)), pa.array(z.ravel()),
                    pa.array(np.tile(share, len(at))), pa.array(np.full(len(each), errors.get(x.shape[1], 0.0))),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")


@query("op13_whitening")
def op13_whitening(spark, folder):
    """Every usable vector on the first sixteen whitened components, with its exact deviation from the mean and the components' shares of the variance."""
    found = whitened(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")
