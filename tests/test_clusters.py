"""Bisecting clusters of answer patterns against a plain version, and on a cohort too large for one task's matrix."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from pollmirror.operators import agreement as A
from pollmirror.operators import clustering as K
from pyspark.sql import functions as F

SCHEMA = "cohort string, persona long, question string, answer string"


def sheets(n, seed, questions=4):
    rng = np.random.default_rng(seed)
    kinds = [["a", "a", "b", "c"], ["c", "b", "a", "a"], ["b", "c", "c", "b"]]
    out = []
    for _ in range(n):
        kind = kinds[int(rng.integers(0, 3))][:questions]
        out.append(tuple(x if rng.random() < 0.8 else "abcd"[int(rng.integers(0, 4))] for x in kind))
    return out


def long(cohort, people):
    return [(cohort, i, f"q{j}", a) for i, p in enumerate(people) for j, a in enumerate(p)]


def plain(people, rounds=4, top=5):
    """The same steps with one-hot matrices."""
    size = Counter("|".join(p) for p in people)
    names = sorted(size)
    answers = [tuple(n.split("|")) for n in names]
    codes = sorted({(j, a) for p in answers for j, a in enumerate(p)})
    x = np.array([[float(p[j] == a) for j, a in codes] for p in answers])
    w = np.array([size[n] for n in names], float)
    mean = lambda m: (x[m] * w[m, None]).sum(axis=0) / w[m].sum()
    gap = lambda c: np.round(((x - c) ** 2).sum(axis=1), 9)
    label, best = np.zeros(len(x), int), None
    for level in range(1, top):
        worst = []
        for c in sorted(set(label)):
            m = label == c
            if m.sum() > 1:
                d = gap(mean(m))
                worst.append((-round(float((d * w)[m].sum()), 6), c, min(np.flatnonzero(m), key=lambda i: (-d[i], names[i]))))
        if worst:
            _, c, a = min(worst)
            m = np.flatnonzero(label == c)
            same = lambda i, j: sum(p == q for p, q in zip(answers[i], answers[j]))
            b = min(m, key=lambda i: (same(i, a), names[i]))
            right = np.array([same(i, b) > same(i, a) for i in m])
            for _ in range(rounds):
                if right.any() and not right.all():
                    right = gap(mean(m[right]))[m] < gap(mean(m[~right]))[m]
            label = label.copy()
            label[m[right]] = level
        s = []
        for i in range(len(x)):
            of = {c: 2 * sum(w[j] * (4 - sum(p == q for p, q in zip(answers[i], answers[j]))) for j in np.flatnonzero(label == c)) for c in set(label)}
            mass = {c: w[label == c].sum() for c in of}
            mine = of[label[i]] / (mass[label[i]] - 1) if mass[label[i]] > 1 else 0.0
            other = min((of[c] / mass[c] for c in of if c != label[i]), default=None)
            s.append(0.0 if other is None or max(mine, other) == 0 else (other - mine) / max(mine, other))
        score = float((np.array(s) * w).sum() / w.sum())
        if best is None or round(score, 9) > round(best[0], 9):
            best = (score, dict(zip(names, label.tolist())))
    return best


def test_equals_the_plain_steps_in_every_cohort(spark):
    cohorts = {"x": sheets(60, 1), "y": sheets(25, 2), "one": [("a", "a", "a", "a")] * 7, "two": [("a", "a", "a", "a")] * 3 + [("b", "b", "b", "b")]}
    d = spark.createDataFrame([r for c, p in cohorts.items() for r in long(c, p)], SCHEMA)
    got = defaultdict(dict)
    rows = K.cluster_patterns(d.repartition(5), ["cohort"]).collect()
    for r in rows:
        got[r.cohort][r.pattern] = r
    assert sum(r.size for r in rows) == sum(map(len, cohorts.values()))
    for c, people in cohorts.items():
        score, label = plain(people)
        assert {p: r.cluster for p, r in got[c].items()} == label, c
        assert all(r.silhouette == pytest.approx(score, abs=1e-9) and r.n_clusters == len(set(label.values())) for r in got[c].values())
    # the silhouette is the one that is computed from personas
    member = {(c, p): r.cluster for c, m in got.items() for p, r in m.items()}
    named = [(c, i, f"q{j}", a, member[c, "|".join(p)]) for c, people in cohorts.items() for i, p in enumerate(people) for j, a in enumerate(p)]
    per = A.silhouette(spark.createDataFrame(named, SCHEMA + ", label long"), ["cohort"]).collect()
    assert all(r.silhouette == pytest.approx(next(iter(got[r.cohort].values())).silhouette, abs=1e-9) for r in per)


def test_groups_that_lie_apart_are_found_in_a_cohort_of_many_patterns(spark):
    rng = np.random.default_rng(3)
    people = [tuple(("abc"[g] if rng.random() < 0.85 else "xyzw"[int(rng.integers(0, 4))]) for _ in range(14)) for g in range(3) for _ in range(1500)]
    assert len(set(people)) > K.MAX_PATTERNS
    out = K.cluster_patterns(spark.createDataFrame(long("big", people), SCHEMA), ["cohort"])
    rows = out.withColumn("kind", F.greatest(*[F.length(F.regexp_replace("pattern", f"[^{k}]", "")) * 10 + i for i, k in enumerate("abc")]) % 10).collect()
    assert {r.n_clusters for r in rows} == {3} and sum(r.size for r in rows) == 4500
    kinds = defaultdict(Counter)
    for r in rows:
        kinds[r.cluster][r.kind] += r.size
    assert all(c.most_common(1)[0][1] > 0.99 * sum(c.values()) for c in kinds.values())


def test_no_personas(spark):
    assert K.cluster_patterns(spark.createDataFrame([], SCHEMA), ["cohort"]).collect() == []
