"""The convergence report of several models against the steps written out for one question at a time."""

from __future__ import annotations

from collections import Counter

import pytest

from pollmirror.operators import agreement as A

ANSWERS = {  # question -> model -> answers in order of the items
    "q1": {"m1": "aaab", "m2": "aaab", "m3": "aaab"},
    "q2": {"m1": "aabb", "m2": "abab", "m3": "bbbb"},
    "q3": {"m1": "aacc", "m2": "aacc", "m3": "aabc"},
}


@pytest.fixture(scope="module")
def report(spark):
    rows = [(q, m, i, v) for q, of in ANSWERS.items() for m, vs in of.items() for i, v in enumerate(vs)]
    d = spark.createDataFrame([*rows, ("q1", "m1", 9, None)], "key string, rater string, item int, value string")
    return {r.key: r for r in A.model_convergence(d, ["key"]).collect()}


def test_every_model_has_its_shares_and_top_choice(report):
    for q, of in ANSWERS.items():
        got = {m.rater: (m.n, m.top, {v.value: v.share for v in m["values"]}) for m in report[q].per_model}
        want = {m: (len(vs), min(Counter(vs).items(), key=lambda x: (-x[1], x[0]))[0], {v: c / len(vs) for v, c in Counter(vs).items()}) for m, vs in of.items()}
        assert got == want


def test_divergent_models_are_named(report):
    assert {q: r.divergent_models for q, r in report.items()} == {"q1": [], "q2": ["m3"], "q3": []}
    assert {q: r.top_choice_agreement for q, r in report.items()} == {"q1": True, "q2": False, "q3": True}


def test_verdict_and_report_over_all_questions(report):
    alphas = [r.alpha for r in report.values()]
    assert report["q1"].interpretation == "Strong convergence (alpha=1.00). The models agree: a is the top choice."
    assert "Models m3 differ." in report["q2"].interpretation and f"alpha={report['q2'].alpha:.2f}" in report["q2"].interpretation
    for r in report.values():
        assert r.overall_alpha == pytest.approx(sum(alphas) / 3) and r.overall_level == "weak"
        assert (r.n_convergent, r.n_not_convergent) == (sum(a >= 0.6 for a in alphas), sum(a < 0.4 for a in alphas))
