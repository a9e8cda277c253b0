"""Exact curve means against enumeration and draws; walks and the stop rule."""

import math

import numpy as np
import pyarrow as pa
import pytest

from pollmirror.operators import curves as C
from pollmirror.operators import resample as B

QUESTION = "dataset string, key string, counts array<bigint>"


def term(x, n, p):
    e, m = x / n, (x / n + p) / 2
    return ((e * math.log2(e / m) if e else 0.0) + p * math.log2(p / m)) / 2


@pytest.mark.parametrize("count, pool, n", [(1, 3, 2), (3, 10, 4), (7, 10, 10), (5, 40, 30), (10, 10, 5), (0, 8, 3)])
@pytest.mark.parametrize("replace", [True, False])
def test_expected_terms_equal_enumeration(count, pool, n, replace):
    p, want = count / pool, 0.0
    for x in range(n + 1):
        if replace:
            w = math.comb(n, x) * p**x * (1 - p) ** (n - x)
        else:
            w = math.comb(count, x) * math.comb(pool - count, n - x) / math.comb(pool, n) if n - x <= pool - count else 0.0
        want += w * (term(x, n, p) if count else 0.0)
    assert C.expected_terms(np.array([count]), np.array([pool]), n, replace)[0] == pytest.approx(want, abs=1e-14)


@pytest.mark.parametrize("replace", [True, False])
def test_expected_curve_is_the_mean_of_draws(spark, replace):
    counts = [4000, 900, 90, 9, 1]
    d = spark.createDataFrame([("d", "k", counts), ("d", "none", []), ("d", "zero", [0, 0])], QUESTION)
    got = {r.n: r.jsd_mean for r in C.expected_curve(d, replace=replace).collect()}
    assert sorted(got) == [n for n in C.SAMPLE_SIZES if replace or n <= 5000]
    rng, share = np.random.default_rng(1), np.array(counts) / 5000
    for n in (20, 500, 2000):
        drawn = rng.multinomial(n, share, size=20_000) if replace else rng.multivariate_hypergeometric(counts, n, size=20_000, method="marginals")
        found = B._jsd_rows(drawn / n, np.broadcast_to(share, drawn.shape))
        assert abs(got[n] - found.mean()) < 5 * found.std() / math.sqrt(20_000)
    if not replace:
        assert got[5000] == pytest.approx(0.0, abs=1e-15)


def test_moments_of_the_draws_without_replacement():
    counts, n = np.array([50, 30, 15, 5]), 40
    drawn = np.random.default_rng(3).multivariate_hypergeometric(counts, n, size=40_000, method="marginals")
    share = counts / counts.sum()
    var = n * share * (1 - share) * (100 - n) / 99
    assert np.abs(drawn.mean(axis=0) - n * share).max() < 5 * math.sqrt(var.max() / 40_000)
    assert np.abs(drawn.var(axis=0) / var - 1).max() < 0.05


def rule(points, epsilon, delta):
    for i, (n, mean) in enumerate(points):
        if mean < epsilon:
            after = points[i + 1 : i + 3]
            if len(after) < 2:
                return None
            if max(mean - m for _, m in after) <= delta:
                return n
    return None


def test_walk_ends_where_the_rule_is_decided(spark):
    rng = np.random.default_rng(5)
    table = [("d", f"q{i}", rng.integers(1, 4000, int(rng.integers(2, 9))).tolist()) for i in range(30)]
    d = spark.createDataFrame(table, QUESTION)
    whole = C.curve_walk(d, replicates=200, whole=True).collect()
    short = C.curve_walk(d, replicates=200).collect()
    assert len(short) < len(whole) == 30 * len(C.SAMPLE_SIZES)
    by = {}
    for r in sorted(whole, key=lambda r: r.n):
        by.setdefault(r.key, []).append((r.n, r.jsd_mean))
    answers = {r.key: r.convergence_n for r in C.walk_convergence(C.curve_walk(d, replicates=200)).collect()}
    assert answers == {k: rule(p, C.EPSILON, C.DELTA) for k, p in by.items()}
    same = {(r.key, r.n): r.jsd_mean for r in whole}
    assert all(same[r.key, r.n] == r.jsd_mean for r in short)  # a shorter walk draws the same
    exact = {(r.key, r.n): r.jsd_mean for r in C.expected_curve(d).collect()}
    off = [abs(r.jsd_mean - exact[r.key, r.n]) <= r.mean_error for r in whole]
    assert np.mean(off) > 0.88  # 95 % bounds


def test_question_of_many_options_converges_late(spark):
    d = spark.createDataFrame([("d", "many", [80] * 200), ("d", "two", [5000, 3000])], QUESTION)
    got = {r.key: r.convergence_n for r in B.convergence_n(C.expected_curve(d), ["dataset", "key"], delta=0.02).collect()}
    drawn = {r.key: r.convergence_n for r in C.walk_convergence(C.curve_walk(d, replicates=100, delta=0.02)).collect()}
    assert got == drawn == {"many": 2000, "two": 20}
    pool = {r.key: r.convergence_n for r in C.walk_convergence(C.curve_walk(d, replicates=100, delta=0.02, replace=False)).collect()}
    assert pool == got


def test_blocks_end_within_the_tolerance(spark):
    d = spark.createDataFrame([("d", "k", [60, 30, 10])], QUESTION)
    rows = C.curve_walk(d, replicates=20_000, tolerance=0.002, whole=True).collect()
    assert all(max(r.mean_error, r.quantile_error) <= 0.002 for r in rows)
    assert {r.n: r.replicates for r in rows}[10_000] == 100 < {r.n: r.replicates for r in rows}[20] < 20_000
    full = {r.n: r for r in C.curve_walk(d, replicates=20_000, whole=True, block=5000).collect()}
    assert all(abs(r.jsd_p90 - full[r.n].jsd_p90) < 0.006 for r in rows)


@pytest.mark.parametrize("points, want", [
    ([(20, 0.5), (50, 0.01)], (False, None)), ([(20, 0.019), (50, 0.018), (100, 0.017)], (True, 20)),
    ([(20, 0.019), (50, 0.018), (100, 0.001), (200, 0.0009), (500, 0.0008)], (True, 100)), ([], (False, None)), ([(20, 0.02), (50, 0.02), (100, 0.02)], (False, None)),
])
def test_stop_rule(points, want):
    assert C.stop_size(points) == want and want[1] == rule(points, C.EPSILON, C.DELTA)


def test_questions_drawn_at_once_follow_their_own_law():
    rng = np.random.default_rng(11)
    counts = [rng.integers(0, 40, int(rng.integers(2, 7))) + (np.arange(1) == 0) for _ in range(60)]
    names = [("d", f"q{i}") for i in range(60)]
    cells = B.OptionCells(names, counts, 7)
    drawn = cells._shared(50, B._uniforms(7, 50, 4000))
    assert (drawn >= 0).all() and (np.add.reduceat(drawn, cells.starts, axis=1) == 50).all()
    p = cells.share
    sd = np.sqrt(50 * p * (1 - p))
    assert (np.abs(drawn.mean(axis=0) - 50 * p) <= 5 * sd / math.sqrt(4000) + 1e-9).all()
    some = sd > 0
    assert np.abs(drawn.var(axis=0)[some] / sd[some] ** 2 - 1).max() < 0.15
    first = drawn[:, cells.starts]  # turned apart, questions hardly move together
    assert np.abs(np.mean(np.corrcoef(first.T)[np.triu_indices(60, 1)])) < 0.1
    alone = B.OptionCells(names[3:5], counts[3:5], 7).replicates(50, 500)
    assert np.allclose(alone, cells.replicates(50, 500)[3:5], atol=1e-12)  # whatever stands beside a question
    kept = B.OptionCells(names[3:5], counts[3:5], 7).replicates(2, 500, replace=False)
    want = np.random.default_rng(B._number(7, "d", "q3", 2)).multivariate_hypergeometric(counts[3], 2, size=500, method="marginals") / 2
    assert np.allclose(kept[0], np.sort(B._jsd_rows(want, counts[3] / counts[3].sum())), atol=1e-12)


def test_counts_leave_in_batches_of_bounded_draws(spark, monkeypatch):
    d = spark.createDataFrame([("d", f"q{i}", ["a", "b"], [i + 1, 3]) for i in range(40)], "dataset string, key string, options array<string>, counts array<long>")
    kernels, frame = [], type(d)
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, fn, schema: kernels.append(fn) or real(self, fn, schema))
    monkeypatch.setattr(B, "DRAWS_AT_ONCE", 4 * 10 * 500)  # ten rows of 500 replicates
    rows = B.multinomial_counts(d, 100, 500).collect()
    assert len(rows) == 80 and all(len(r.draws) == 500 for r in rows)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in d.collect()])
    assert max(b.num_rows for b in kernels[0](iter([batch]))) == 10
