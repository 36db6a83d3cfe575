"""Whitening against exact fractions, a plain eigendecomposition and hand-made odd rows."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from plumeria.llm import queries, whitening


def table(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, n string, component string")


def plain(vectors):
    """The covariance of the distinct grid vectors, in fractions."""
    xs = sorted({tuple(floor(256 * c) for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[i] for x in xs), n) for i in range(d)]
    return xs, mean, [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("size", [1e-2, 1.0, 1e6, 1e13])
def test_covariance_is_exact(spark, size):
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(60, 5)) * [1, 2, 3, 4, 5] * size).tolist()
    vectors += vectors[:20]
    df = table(spark, [(i % 7, v, "x", "y") for i, v in enumerate(vectors)]).repartition(4)
    xs, mean, cov = plain(vectors)
    rows = df.select(whitening.grid(df.embedding).alias("x")).distinct()
    n = len(xs)
    sums = whitening.exact_sums(rows, 5, lambda x: x.astype(object).sum(axis=0))
    assert sums == [m * n for m in mean]
    squares = whitening.exact_sums(rows, 5, lambda x: whitening.pair_square_sums(whitening.centred(x, n, sums)))
    assert squares[:5] == [cov[i][i] * n**3 for i in range(5)]
    assert whitening.covariance(squares, n, 5).tolist() == [[float(c) for c in line] for line in cov]
    model = whitening.fit(df)
    assert (model.n, model.sums) == (n, sums)
    e = np.linalg.eigvalsh(np.array([[float(c) for c in line] for line in cov]))[::-1]
    assert np.allclose(model.values, e[:4], rtol=1e-9) and np.allclose(model.explained, e[:4] / e.sum(), rtol=1e-9)
    assert model.identity_error < 1e-9


def test_rows_equal_a_plain_whitening(spark):
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(80, 6)) @ r.normal(size=(6, 6))).tolist()
    odd = [(100, None, "", ""), (101, [nan] * 6, "", ""), (102, [0.0] * 5 + [None], "", ""), (103, [inf] + [0.0] * 5, "", ""), (104, [0.5] * 3, "", ""), (105, [], "", ""), (None, vectors[0], "", "")]
    df = table(spark, [(i, v, "a", "b") for i, v in enumerate(vectors)] + odd)
    model = whitening.fit(df)
    got = {r.vec_id: r.w for r in df.where(whitening.fits(model, df.embedding)).select("vec_id", "n", whitening.whitened(model, df.embedding).alias("w")).collect()}
    assert set(got) == {*range(80), None}
    xs, mean, cov = plain(vectors)
    for i, v in enumerate(vectors):
        x, n = [floor(256 * c) for c in v], len(xs)
        assert int(got[i].deviation) == sum((n * a - m * n) ** 2 for a, m in zip(x, mean))
        w = np.array([float(a - m) for a, m in zip(x, mean)]) @ model.vectors / np.sqrt(model.values)
        assert np.allclose(got[i].whitened, w, atol=1e-12)
    assert got[None] == got[0]
    w = np.array([got[i].whitened for i in range(80)])
    assert np.allclose(np.cov(w.T, bias=True), np.eye(4), atol=1e-9)


def test_no_variance_and_empty(spark):
    one = table(spark, [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")])
    model = whitening.fit(one)
    assert (model.n, model.full, model.identity_error, model.explained) == (1, 0, None, [None, None])
    assert [(int(r.w.deviation), r.w.whitened) for r in one.select(whitening.whitened(model, one.embedding).alias("w")).collect()] == [(0, [None, None])] * 2
    line = table(spark, [(i, [float(i), -float(i), 0.0], "", "") for i in range(5)])
    model = whitening.fit(line)
    assert model.full == 1 and model.explained[0] == pytest.approx(1) and model.identity_error < 1e-9
    assert whitening.fit(one.limit(0)) is None and whitening.fit(one.where("false")) is None


def test_squares_beyond_64_bits():
    r = np.random.default_rng(1)
    for bits in (10, 30, 61):
        e = r.integers(-(1 << bits), 1 << bits, size=(500, 4))
        assert whitening.square_sums(e).tolist() == [sum(int(v) ** 2 for v in c) for c in e.T]
    huge = whitening.centred(np.array([[1 << 62], [-(1 << 62)]]), 2, [0])
    assert huge.dtype == object and whitening.square_sums(huge).tolist() == [2 * (1 << 63) ** 2]


def test_query(spark, sf_dir):
    got = queries.QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = got.toPandas()
    assert len(rows) == 4 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9
    assert rows.groupby("component").explained.nunique().tolist() == [1] * 4 and rows.drop_duplicates("component").sort_values("component").explained.is_monotonic_decreasing
    empty = queries.embedding_whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(0))
    assert empty.count() == 0 and empty.columns == got.columns
