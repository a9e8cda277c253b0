"""Whitening against the dense eigenvectors; the solver on matrices with awkward spectra."""

import numpy as np
import pytest

from pollmirror.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n int, x string, component string"


def brute(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (n * x - sums), e, (y @ u) / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("dim, rows", [(12, 300), (70, 900)])
def test_equals_the_dense_solution(spark, dim, rows):
    rng = np.random.default_rng(dim)
    good = rng.standard_normal((rows, dim)) * (1.2 ** -np.arange(dim)) * 3 + 5
    good[5] = good[4]
    table = [(i, v.tolist(), 1, "a", "b") for i, v in enumerate(good)]
    table += [(None, None, 1, "a", "b"), (900001, [float("nan")] * dim, 1, "a", "b"), (900002, [None] * dim, 1, "a", "b"), (900003, [float("inf")] * dim, 1, "a", "b"), (900004, [], 1, "a", "b"), (900005, [1.0] * (dim + 1), 1, "a", "b")]
    got = whitening.whiten(spark.createDataFrame(table, SCHEMA).repartition(5)).collect()
    k = min(32, dim)
    assert len(got) == rows * k and {r.n for r in got} == {rows}
    y, e, white, explained = brute(good, k)
    have = np.zeros((rows, k))
    for r in got:
        have[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == int((y[r.vec_id].astype(object) ** 2).sum())
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((have * white).sum(axis=0))
    assert np.abs(have * sign - white).max() < 1e-6
    assert np.abs(have.T @ have / rows - np.eye(k)).max() < 1e-9


def test_null_ids_repeated_rows_and_tables_without_spread(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert make([]).collect() == make([(1, None), (2, [])]).collect() == make([(1, [0.5, 1.0])] * 4).collect() == []
    got = make([(None, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0])]).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation) for r in got) == [(0, 1, 3, 65536), (1, 1, 3, 16384), (1, 1, 3, 16384)]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)  # one direction has no spread and no rows


SPECTRA = {
    "near one another": lambda d, rng: 1 + 0.1 * rng.random(d),
    "falling": lambda d, rng: 1 / np.arange(1, d + 1),
    "twice each": lambda d, rng: np.repeat(np.arange(d // 2, 0, -1.0), 2),
    "rank three": lambda d, rng: np.r_[[5.0, 4.0, 3.0], np.zeros(d - 3)],
    "zero": lambda d, rng: np.zeros(d),
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("dim, k", [(6, 32), (64, 32), (250, 6)])
def test_solver_reaches_double_precision(name, dim, k):
    rng = np.random.default_rng(dim)
    e = SPECTRA[name](dim, rng)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    widths = []

    def product(block):
        widths.append(block.shape[1])
        return a @ block

    w, u = whitening.jacobi_davidson(product, dim, k)
    assert np.abs(w - np.sort(e)[::-1][: len(w)]).max() <= 1e-12 * max(e.max(), 1)
    assert np.linalg.norm(a @ u - u * w, axis=0).max() <= 1e-12 * max(e.max(), 1) and np.abs(u.T @ u - np.eye(len(w))).max() < 1e-12
    if dim == 250:
        assert max(widths) < dim / 2  # the whole space is never formed


def test_minres_solves_every_column():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    shift, b = np.array([0.3, -1.0, 2.0]), rng.standard_normal((40, 3))
    x = whitening.minres(lambda v: a @ v - v * shift, b, 200, 1e-13)
    for i in range(3):
        assert np.allclose((a - shift[i] * np.eye(40)) @ x[:, i], b[:, i], atol=1e-8)
