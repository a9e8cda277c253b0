"""Intervals of any statistic: values against numpy, intervals against a plain BCa, large groups against small ones."""

import math

import numpy as np
import pytest

from pollmirror.functions import special as SP
from pollmirror.operators import statistics as S

SCHEMA = "grp string, key string, x double, y double"


def tau(x, y):
    n, c = len(x), [0, 0, 0]
    for i in range(n):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            c[0] += a * b
            c[1] += a * a
            c[2] += b * b
    return c[0] / math.sqrt(c[1] * c[2]) if c[1] * c[2] else 0.0


PLAIN = {
    "mean": lambda x: float(np.mean(x)),
    "median": lambda x: float(np.median(x)),
    "cv": lambda x: float(np.std(x, ddof=1) / np.mean(x)) if np.mean(x) else 0.0,
    "correlation": lambda x, y: float(np.corrcoef(x, y)[0, 1]) if np.std(x) * np.std(y) > 1e-9 else 0.0,
    "tau": tau,
}


def data(n, seed=1, digits=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.gamma(2.0, 2.0, n), digits)
    return np.column_stack([x, np.round(0.5 * x + rng.normal(0, 1, n), digits)])


@pytest.mark.parametrize("name", PLAIN)
def test_weighted_values_equal_the_plain_statistic_of_repeated_rows(name):
    stat, rows = S.STATISTICS[name], data(40)[:, : S.STATISTICS[name].columns]
    weights = S.draw_weights(np.random.default_rng(2), 40, np.full(30, 40))
    assert (weights.sum(axis=1) == 40).all()
    want = [PLAIN[name](*np.repeat(rows, w.astype(int), axis=0).T) for w in weights]
    assert np.allclose(stat.whole(rows, weights), want, atol=1e-12)
    # the state form, in two parts that are added up
    frame = {"centre": rows.mean(axis=0) + 0.3, "edges": [np.unique(c) for c in rows.T]}
    merged = stat.state(rows[:17], weights[:, :17], frame) + stat.state(rows[17:], weights[:, 17:], frame)
    assert np.allclose(stat.finish(merged, frame), want, atol=1e-9)


def plain_bca(rows, fn, weights):
    """The published steps, one value at a time."""
    theta = fn(*rows.T)
    stars = sorted(fn(*np.repeat(rows, w.astype(int), axis=0).T) for w in weights)
    r = len(stars)
    clamp = lambda p: max(1 / (r + 1), min(r / (r + 1), p))
    z0 = SP.normal_quantile_number(clamp(sum(s < theta - 1e-12 for s in stars) / r))
    jack = [fn(*np.delete(rows, i, axis=0).T) for i in range(len(rows))]
    d = [np.mean(jack) - j for j in jack]
    denominator = 6 * sum(v * v for v in d) ** 1.5
    a = sum(v**3 for v in d) / denominator if denominator else 0.0
    ends = []
    for z in (SP.normal_quantile_number(0.025), SP.normal_quantile_number(0.975)):
        p = SP.normal_cdf_number(z0 + (z0 + z) / (1 - a * (z0 + z)))
        ends.append(stars[math.floor(clamp(p) * r)])
    return theta, *ends


@pytest.mark.parametrize("name", PLAIN)
def test_interval_of_a_small_group_equals_the_plain_steps(spark, name):
    groups = {"a": data(30, 3), "b": data(5, 4), "few": data(4, 5), "equal": np.full((12, 2), 2.5)}
    table = [(g, f"{i:03}", float(x), float(y)) for g, rows in groups.items() for i, (x, y) in enumerate(rows)] + [("a", "zzz", None, 1.0), ("a", "zzz", 1.0, None)]
    cols = ["x", "y"][: S.STATISTICS[name].columns]
    table = table[:-1] if len(cols) == 1 else table
    got = {r.grp: r for r in S.statistic_ci(spark.createDataFrame(table, SCHEMA).repartition(4), ["grp"], "key", cols, name, resamples=300).collect()}
    assert set(got) == {"a", "b", "equal"}
    for g, r in got.items():
        rows = groups[g][:, : len(cols)]
        weights = S.draw_weights(np.random.default_rng(S._number(42, g)), len(rows), np.full(300, len(rows)))
        want = plain_bca(rows, PLAIN[name], weights)
        assert (r.estimate, r.ci_lower, r.ci_upper) == pytest.approx(want, abs=1e-9) and r.n == len(rows)


@pytest.mark.parametrize("name", PLAIN)
def test_a_group_in_chunks_agrees_with_the_same_group_in_one(spark, monkeypatch, name):
    rows = data(1500, 6, digits=0)
    if name == "tau":  # answers on a scale: every value holds more than a cell's share
        rows = np.clip(np.round(rows), 1, 5)
    d = spark.createDataFrame([("g", f"{i:05}", float(x), float(y)) for i, (x, y) in enumerate(rows)], SCHEMA)
    cols = ["x", "y"][: S.STATISTICS[name].columns]
    monkeypatch.setattr(S, "JACKKNIFE", 100)
    one = S.statistic_ci(d, ["grp"], "key", cols, S.Statistic(name, len(cols), S.STATISTICS[name].state, S.STATISTICS[name].finish, S.STATISTICS[name].exact, 5000), resamples=400).first()
    many = S.statistic_ci(d, ["grp"], "key", cols, name, resamples=400, chunk_rows=120)
    assert many.repartition(1).collect() == S.statistic_ci(d.repartition(9), ["grp"], "key", cols, name, resamples=400, chunk_rows=120).collect()
    many = many.first()
    assert many.n == one.n == 1500 and many.estimate == pytest.approx(one.estimate, abs=1e-12)  # fewer distinct values than cells
    width = one.ci_upper - one.ci_lower
    assert abs(many.ci_lower - one.ci_lower) <= 0.25 * width + 1e-12 and abs(many.ci_upper - one.ci_upper) <= 0.25 * width + 1e-12


def test_median_of_a_large_column_is_within_a_fraction_of_its_error(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(10, 2, 60_000)
    d = spark.createDataFrame([("g", str(i), float(v), 0.0) for i, v in enumerate(x)], SCHEMA)
    r = S.statistic_ci(d, ["grp"], "key", ["x"], "median", resamples=200, chunk_rows=20_000).first()
    error = 1.2533 * 2 / math.sqrt(60_000)
    assert abs(r.estimate - np.median(x)) < error / 16 and 2.5 * error < r.ci_upper - r.ci_lower < 6 * error


def test_any_callable_and_a_group_that_it_cannot_take(spark):
    rows = data(40, 9)
    d = spark.createDataFrame([("g", f"{i:03}", float(x), float(y)) for i, (x, y) in enumerate(rows)], SCHEMA)
    trimmed = lambda v: float(np.sort(v)[4:-4].mean())
    r = S.statistic_ci(d, ["grp"], "key", ["x"], S.of_callable(trimmed), resamples=200).first()
    assert r.estimate == pytest.approx(trimmed(rows[:, 0])) and r.ci_lower < r.estimate < r.ci_upper
    with pytest.raises(Exception, match="no state to merge"):
        S.statistic_ci(d, ["grp"], "key", ["x"], S.of_callable(trimmed), resamples=20, chunk_rows=30).collect()
    with pytest.raises(ValueError, match="takes 2"):
        S.statistic_ci(d, ["grp"], "key", ["x"], "tau")


def test_empty_table(spark):
    assert S.statistic_ci(spark.createDataFrame([], SCHEMA), ["grp"], "key", ["x"], "median").collect() == []
