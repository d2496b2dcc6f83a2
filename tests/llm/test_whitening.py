"""Whitening against a plain eigendecomposition, and its edge cases."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from floodgauge.llm import whitening
from floodgauge.llm.whitening import jacobi, pivoted_cholesky, whitened


def rows_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")


def plain(vectors, components=16):
    """Whole vectors, fit size, eigenvalues, whitened rows, shares and deviations by the shortest way."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], object)
    u = np.array(sorted({tuple(r) for r in x}), object)
    n, total = len(u), u.sum(axis=0)
    scaled = u * n - total
    v = np.array([[int(c) / n**3 for c in r] for r in scaled.T @ scaled], float)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    centred = np.array((x * n - total) / n, float)
    return n, e, centred @ q / np.sqrt(e), e / np.trace(v), [int(d) for d in ((x * n - total) ** 2).sum(axis=1)]


def test_whole_table_equals_eigendecomposition(spark, folder):
    got = whitening.op13_whitening(spark, folder).toPandas()
    data = pq.read_table(f"{folder}/embeddings.parquet")
    n, e, z, share, deviation = plain(data["embedding"].to_pylist())
    assert set(got.n) == {n} and len(got) == 16 * data.num_rows
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[data["vec_id"].to_pylist()].to_numpy()
    sign = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine * sign - z).max() < 1e-6
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, share, rtol=1e-9)
    assert got[got.component == 1].set_index("vec_id").loc[data["vec_id"].to_pylist()].deviation.tolist() == deviation
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_unusable_rows_copies_and_rank(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 4))
    vectors = [[*r, r[0], 3.0] for r in (np.floor(base * 64) / 64).tolist()]  # one dimension twice, one constant
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    many = vectors + bad + [vectors[0]] * 50
    got = whitened(rows_of(spark, many, [*range(30), *range(100, 105), *[None] * 50])).toPandas()
    assert set(got.component) == {1, 2, 3, 4} and set(got.n) == {30} and len(got) == 80 * 4
    assert not set(got.id.dropna()) & set(range(100, 105)) and got.id.isna().sum() == 200
    assert got.identity_error[0] < 1e-9
    assert abs(got.drop_duplicates("component").explained.sum() - 1) < 1e-12
    first = got[got.id == 0].sort_values("component").whitened.to_numpy()
    for _, copy in got[got.id.isna()].groupby(np.arange(200) // 4):
        assert np.allclose(copy.sort_values("component").whitened, first)


def test_large_and_small_variances_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    vectors = np.column_stack([rng.normal(size=40) * 1e7 + 3e9, rng.normal(size=40) * 1e3, rng.normal(size=40)]).tolist()
    got = whitened(rows_of(spark, vectors)).toPandas()
    n, e, z, share, deviation = plain(vectors)
    assert [int(d) for d in got[got.component == 1].sort_values("id").deviation] == deviation
    assert got.identity_error[0] < 1e-6
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained[:2], share[:2], rtol=1e-6)


def test_lengths_clashing_columns_and_empty(spark):
    vectors = [[1.0, 2.0], [2.0, 1.0], [0.0, 5.0], [1.0, 2.0, 3.0], [3.0, 1.0, 0.0], [1e300, -1e300, 0.0]]
    rows = rows_of(spark, vectors).withColumns({c: F.lit(9) for c in ("id", "x", "n", "size", "i", "k", "component", "whitened")})
    got = whitened(rows).toPandas()
    assert {(r.id, r.n) for r in got.itertuples()} == {(i, 3) for i in range(6)}
    assert whitened(rows.where("vec_id = 0")).count() == 0
    assert whitened(rows.limit(0)).count() == 0


def test_spread_over_partitions_gives_the_same_fit(spark):
    rng = np.random.default_rng(3)
    rows = rows_of(spark, rng.normal(size=(200, 5)).tolist())
    fits = [whitening.fitted(rows.repartition(p).select(whitening.whole_vectors(F.col("embedding")).alias("x")))[5] for p in (1, 7)]
    assert (fits[0].values == fits[1].values).all() and (fits[0].components == fits[1].components).all()


@pytest.mark.parametrize("size", [1, 2, 5, 33])
def test_factor_and_rotations(size):
    rng = np.random.default_rng(size)
    g = rng.normal(size=(size, size)) * 10.0 ** -np.arange(size)[:, None].clip(max=6)
    a = g @ g.T
    factor = pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, rtol=1e-10, atol=0)
    values, components = jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], rtol=1e-6, atol=1e-14 * np.trace(a))
    assert np.abs(components.T @ components - np.eye(len(values))).max() < 1e-12
