"""Opt-in sketches: rank error at two sizes and over merges; draws without a row per draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollmirror.operators import ranking as Q
from pollmirror.operators import resample as B
from pollmirror.operators import scoring as S

PROBS = {"min": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "max": 1.0}


@pytest.mark.parametrize("n", [2_000, 200_000])
def test_rank_error_stays_small_also_over_merged_sketches(spark, n):
    d = spark.range(n).select((F.col("id") % 7).alias("part"), (F.col("id") % 3).alias("g"), F.hash("id").cast("double").alias("x")).repartition(11)
    fine = Q.quantile_sketch(d, ["part", "g"], "x")
    direct = {r.g: r for r in Q.approx_quantiles(d, ["g"], "x", PROBS).collect()}
    merged = {r.g: r for r in Q.sketch_quantiles(Q.merged_sketches(fine, ["g"]), ["g"], PROBS).collect()}
    for g in range(3):
        x = np.sort([r.x for r in d.where(F.col("g") == g).collect()])
        for got in (direct[g], merged[g]):
            assert (got["min"], got["max"]) == (x[0], x[-1])
            for name, p in PROBS.items():
                assert abs(np.searchsorted(x, got[name]) / len(x) - p) < 0.008


def test_a_sketch_does_not_grow_with_its_group(spark):
    size = lambda n: Q.quantile_sketch(spark.range(n).select(F.lit(1).alias("g"), F.hash("id").cast("double").alias("x")), ["g"], "x").select(F.length("sketch").alias("b")).first().b
    assert size(400_000) < 1.5 * size(20_000) < 60_000


def test_nulls_and_no_rows(spark):
    d = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "g string, x double")
    assert [tuple(r) for r in Q.approx_quantiles(d, ["g"], "x", {"p50": 0.5}).collect()] == [("a", 2.0)]


def test_run_score_takes_the_median_from_a_sketch(spark):
    rng = np.random.default_rng(1)
    rows = [("r", "d", f"q{i}", float(j), 0.5, 0.1, 0.1) for i, j in enumerate(rng.random(301))]
    d = spark.createDataFrame(rows, "run_id string, dataset string, key string, jsd double, tau double, model_refusal_rate double, human_refusal_rate double")
    exact, approx = S.run_score(d).first(), S.run_score(d, approx=True).first()
    assert approx.median_jsd == pytest.approx(exact.median_jsd, abs=0.01) and approx.sps == exact.sps


def test_counts_of_ten_thousand_draws(spark):
    table = [("d", "k", ["a", "b", "c", "z"], [50, 30, 20, 0]), ("d", "one", ["a"], [3]), ("d", "none", ["a"], [0])]
    d = spark.createDataFrame(table, "dataset string, key string, options array<string>, counts array<bigint>")
    got = {(r.key, r.option): np.array(r.draws) for r in B.multinomial_counts(d, 10_000, 500).collect()}
    again = {(r.key, r.option): np.array(r.draws) for r in B.multinomial_counts(d.repartition(7), 10_000, 500).collect()}
    assert got.keys() == again.keys() and all((got[k] == again[k]).all() for k in got)
    assert set(got) == {("k", o) for o in "abcz"} | {("one", "a")} and (got["one", "a"] == 10_000).all() and not got["k", "z"].any()
    counts, p = np.stack([got["k", o] for o in "abc"]), np.array([0.5, 0.3, 0.2])
    assert (counts.sum(axis=0) == 10_000).all()
    chi = ((counts - 10_000 * p[:, None]) ** 2 / (10_000 * p[:, None])).sum(axis=0)  # two degrees of freedom
    assert abs(chi.mean() - 2) < 0.4 and abs((chi > 5.99).mean() - 0.05) < 0.04
    cov = np.cov(counts)
    want = 10_000 * (np.diag(p) - np.outer(p, p))
    assert np.abs(cov / want - 1).max() < 0.3
