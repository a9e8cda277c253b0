"""Ceilings: exact means against enumeration, cross-cuts against brute force, drawn ones around the exact."""

import math
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollmirror.operators import ceilings as E
from pollmirror.operators import resample as B


def jsd(p, q):
    return sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2


def halves(counts):
    """Mean JSD of two halves, over all pairs of multinomial draws."""
    n, k = sum(counts), len(counts)
    h = n // 2
    draws = [d for d in product(range(h + 1), repeat=k) if sum(d) == h]
    weight = [math.factorial(h) * math.prod((c / n) ** x / math.factorial(x) for c, x in zip(counts, d)) for d in draws]
    return sum(wa * wb * jsd([x / h for x in a], [x / h for x in b]) for a, wa in zip(draws, weight) for b, wb in zip(draws, weight))


@pytest.mark.parametrize("counts", [[3, 5], [1, 2, 7], [4, 0, 4], [9], [2, 2, 2, 1]])
def test_exact_mean_equals_enumeration(spark, counts):
    d = spark.createDataFrame([("q", counts, 3.0)], "key string, counts array<bigint>, mean_before double")
    r = E.expected_ceiling(d).first()
    assert r["mean"] == pytest.approx(1 - halves(counts), abs=1e-13) and r.n_effective == sum(counts) and r.flag == "low"


def test_one_answer_and_none(spark):
    d = spark.createDataFrame([("one", [1, 0]), ("none", [0, 0]), ("empty", [])], "key string, counts array<bigint>")
    assert [(r.key, r["mean"]) for r in E.expected_ceiling(d).collect()] == [("one", 0.0)]


def test_drawn_ceilings_lie_around_the_exact_ones_and_equal_counts_agree(spark):
    rng = np.random.default_rng(2)
    table = [(f"q{i}", rng.integers(0, 300, int(rng.integers(2, 7))).tolist()) for i in range(40)]
    table += [(f"again{i}", table[0][1]) for i in range(5)]
    d = spark.createDataFrame(table, "key string, counts array<bigint>").repartition(3)
    exact = {r.key: r["mean"] for r in E.expected_ceiling(d).collect()}
    drawn = {r.key: r for r in B.ceiling(d).collect()}
    assert exact.keys() == drawn.keys()
    for k, r in drawn.items():
        assert abs(r["mean"] - exact[k]) < 0.1 * (1 - exact[k]) + 1e-9 and r.ci_low <= exact[k] <= r.ci_high
    assert len({(drawn[k]["mean"], drawn[k].ci_low) for k in drawn if k.startswith("again") or k == "q0"}) == 1


ANSWERS = "key string, option string, sex string, party string, year int"


def answers(n=3000):
    rng = np.random.default_rng(9)
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    return [(pick(["a", "b"]), pick("xyz"), pick(["f", "m", None]), pick(["r", "d", "i", None]), pick([2017, 2018])) for _ in range(n)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_cross_cuts_equal_counting_row_by_row(spark, depth):
    table = answers()
    want = defaultdict(Counter)
    for key, option, *values in table:
        named = dict(zip(("sex", "party", "year"), values))
        for size in range(1, depth + 1):
            for cut in combinations(named, size):
                if all(named[c] is not None for c in cut):
                    want[key, "_".join(cut), " × ".join(str(named[c]) for c in cut)][option] += 1
    want = {k: [c[o] for o in sorted(c)] for k, c in want.items() if sum(c.values()) >= 70}
    d = spark.createDataFrame(table, ANSWERS).repartition(7)
    got = E.cross_cuts(d, ["key"], {c: F.col(c) for c in ("sex", "party", "year")}, depth=depth, least=70)
    assert {(r.key, r.attribute, r.group): r.counts for r in got.collect()} == want


def test_subgroup_ceilings_weigh_their_questions(spark):
    d = E.cross_cuts(spark.createDataFrame(answers(), ANSWERS), ["key"], {"sex": F.col("sex"), "party": F.col("party")})
    cells = {(r.key, r.attribute, r.group): r for r in E.expected_ceiling(d).collect()}
    exact = {(r.attribute, r.group): r for r in E.subgroup_ceilings(d, resamples=None).collect()}
    drawn = {(r.attribute, r.group): r for r in E.subgroup_ceilings(d, resamples=400).collect()}
    assert set(a for a, _ in exact) == {"sex", "party", "sex_party"} and exact.keys() == drawn.keys()
    for (attribute, group), r in exact.items():
        mine = [c for (_, a, g), c in cells.items() if (a, g) == (attribute, group)]
        assert r["mean"] == pytest.approx(sum(c["mean"] * c.n_effective for c in mine) / sum(c.n_effective for c in mine))
        assert r.n_questions == len(mine) and "ci_low" not in r.asDict()
        assert drawn[attribute, group].ci_low < r["mean"] < drawn[attribute, group].ci_high
    spread, worst, flags = B.ceiling_spread(E.subgroup_ceilings(d, resamples=None), ties=["attribute", "group"])
    means = sorted(r["mean"] for r in exact.values())
    assert spread.first().min == means[0] and [r["mean"] for r in worst.collect()] == means[:5]
    assert sum(r.n for r in flags.collect()) == len(exact)


def test_no_answers(spark):
    d = E.cross_cuts(spark.createDataFrame([], ANSWERS), ["key"], {"sex": F.col("sex")})
    assert E.subgroup_ceilings(d).collect() == E.subgroup_ceilings(d, resamples=None).collect() == []
