import numpy as np
import pytest
from pyspark.sql import functions as F

from pollmirror.operators import agreement as A
from pollmirror.operators import clustering as C
from pollmirror.operators import pairs as PR
from pollmirror.operators import ranking as K
from pollmirror.operators import resample as B
from pollmirror.operators import rollups as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, with many equal values."""
    rng = np.random.default_rng(1)
    rows = [("hot", f"k{i}", float(x)) for i, x in enumerate(rng.choice([0.0, 0.25, 0.5, 0.75, 1.0, 0.313], 900))]
    rows += [("cold", f"k{i}", float(x)) for i, x in enumerate(rng.random(37))]
    return spark.createDataFrame(rows, "g string, k string, x double"), rows


def by_group(rows, g):
    return [r for r in rows if r[0] == g]


@pytest.mark.parametrize("bounds", [None, (0, 1)])
def test_quantiles_are_exact(skewed, bounds):
    d, rows = skewed
    got = {r.g: r for r in K.quantiles(d, ["g"], "x", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}, cells=8, bounds=bounds).collect()}
    for g in ("hot", "cold"):
        xs = [r[2] for r in by_group(rows, g)]
        assert [got[g][c] for c in "abcde"] == pytest.approx(np.percentile(xs, [0, 10, 50, 97.5, 100]), abs=1e-12)


def test_rank_and_index_split_a_hot_group(skewed):
    d, rows = skewed
    got = {(r.g, r.k): r["rank"] for r in K.rank_within(d, ["g"], "x", ["k"], cells=16).collect()}
    for g in ("hot", "cold"):
        want = sorted(by_group(rows, g), key=lambda r: (-r[2], r[1]))
        assert [got[(g, r[1])] for r in want] == list(range(1, len(want) + 1))
    idx = K.dense_index(d, ["g"], "k").collect()
    assert sorted(r.idx for r in idx if r.g == "hot") == list(range(900))


def test_dominance_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(c), float(s)) for i, (c, s) in enumerate(zip(rng.integers(0, 12, 60) / 4, rng.integers(0, 10, 60) / 10))]
    d = spark.createDataFrame(rows, "i int, cost_usd double, sps double")
    got = {r.i: r.dominated for r in R.dominated(d).collect()}
    for i, c, s in rows:
        want = any(s2 >= s and c2 <= c and (s2 > s or c2 < c) for j, c2, s2 in rows if j != i)
        assert got[i] == want


def test_pair_cells_do_not_change_the_pairs(spark):
    rows = [("q", f"m{i:02d}", {"a": float(i + 1), "b": 3.0}) for i in range(23)] + [("r", "m00", {"a": 1.0}), ("r", "m01", {"b": 1.0})]
    d = spark.createDataFrame(rows, "key string, item string, dist map<string,double>")
    one = PR.pair_jsd(d, ["key"], "item", cell_rows=1000).collect()
    many = PR.pair_jsd(d, ["key"], "item", cell_rows=4).collect()
    norm = lambda rs: sorted((r.key, r.item_a, r.item_b, round(r.jsd, 12)) for r in rs)
    assert norm(one) == norm(many) and len(one) == 23 * 22 // 2 + 1
    assert [r.jsd for r in one if r.key == "r"] == [pytest.approx(1.0)]


GOLDEN = [
    [None, None, None, None, None, 3, 4, 1, 2, 1, 1, 3],
    [1, None, 2, 1, 3, 3, 4, 3, None, None, None, None],
    [None, None, 2, 1, 3, 3, 4, 2, 2, 1, 1, 3],
    [1, None, 2, 1, 3, 3, 4, 2, 2, 1, 1, 3],
]


def test_alpha_and_chi2_known_values(spark):
    rows = [("q", r, i, v) for r, line in enumerate(GOLDEN) for i, v in enumerate(line)]
    d = spark.createDataFrame(rows, "q string, rater int, item int, value int")
    assert A.krippendorff_alpha(d, ["q"]).first().alpha == pytest.approx(0.871, abs=0.01)
    same = spark.createDataFrame([("q", r, i, 1) for r in range(2) for i in range(3)], "q string, rater int, item int, value int")
    assert A.krippendorff_alpha(same, ["q"]).first().alpha == 1.0
    c = spark.createDataFrame([("q", 30), ("q", 20), ("q", 50)], "q string, count int")
    r = A.chi2_gof(c, ["q"]).first()
    assert (r.statistic, r.df) == (pytest.approx(14.0), 2) and r.p_value < 0.01


def test_blend_and_contamination(spark):
    rows = [("k", "m1", {"a": 0.5, "b": 0.5}), ("k", "m2", {"a": 1.0}), ("k", "m3", {"b": 0.25, "c": 0.75})]
    d = spark.createDataFrame(rows, "key string, model string, dist map<string,double>")
    got = PR.contamination_risk(d, ["key"]).first()
    m = np.array([[0.5, 0.5, 0], [1, 0, 0], [0, 0.25, 0.75]])
    assert got.mean_std == pytest.approx(m.std(axis=0).mean(), abs=1e-12)


# --- resampling -----------------------------------------------------------------------


def test_hash_bootstrap_matches_brute_force(spark):
    import hashlib

    xs = {f"k{i}": float(i * i % 7) for i in range(12)}
    d = spark.createDataFrame([("g", k, x) for k, x in xs.items()], "g string, k string, x double")
    got = {r.b: r.mean for r in B.boot_means_hash(d, ["g"], "k", "x", 5).collect()}
    order = sorted(xs, key=lambda k: (hashlib.md5(k.encode()).hexdigest()[:2], k))
    for b in range(5):
        draws = [int(int(hashlib.sha256(f"42|g|{b}|{i}".encode()).hexdigest()[:8], 16) / 4294967296.0 * 12) for i in range(12)]
        assert got[b] == pytest.approx(np.mean([xs[order[t]] for t in draws]))


def test_chunked_bootstrap_has_the_bootstrap_law(spark):
    rng = np.random.default_rng(5)
    xs = rng.exponential(size=400)
    d = spark.createDataFrame([("g", f"k{i}", float(x)) for i, x in enumerate(xs)], "g string, k string, x double")
    for chunk in (10_000, 60):
        m = np.array([r["mean"] for r in B.boot_means(d, ["g"], "k", "x", 1500, chunk_rows=chunk).collect()])
        assert len(m) == 1500
        assert m.mean() == pytest.approx(xs.mean(), abs=4 * xs.std() / 20 / np.sqrt(1500))
        assert m.std() == pytest.approx(xs.std() / 20, rel=0.12)


def test_bootstrap_ignores_partitioning(spark):
    d = spark.createDataFrame([("g", f"k{i}", float(i % 9)) for i in range(200)], "g string, k string, x double")
    runs = [sorted((r.b, r.mean) for r in B.boot_means(d.repartition(n), ["g"], "k", "x", 50, chunk_rows=64).collect()) for n in (1, 7)]
    assert [m for _, m in runs[0]] == pytest.approx([m for _, m in runs[1]])


def test_bca_interval_contains_the_mean(spark):
    d = spark.createDataFrame([("g", str(i), float(x)) for i, x in enumerate([2, 4, 6, 8, 10])], "g string, k string, x double")
    r = B.bca_interval(d, B.boot_means(d, ["g"], "k", "x", 2000), ["g"], "x", 2000).first()
    assert r.ci_lower < 6.0 < r.ci_upper and r.estimate == 6.0


def test_ceiling_matches_numpy(spark):
    d = spark.createDataFrame([("d", "k", [30, 50, 20]), ("d", "one", [1])], "dataset string, key string, counts array<long>")
    got = {r.key: r for r in B.ceiling(d, resamples=300).collect()}
    half = np.random.default_rng(42).multinomial(50, np.array([30, 50, 20]) / 100, size=(300, 2)) / 50
    out = []
    for p, q in half:
        m = (p + q) / 2
        out.append(sum((a * np.log2(a / c) if a else 0) + (b * np.log2(b / c) if b else 0) for a, b, c in zip(p, q, m)) / 2)
    assert got["k"]["mean"] == pytest.approx(1 - np.mean(out), abs=1e-12)
    assert got["k"].ci_low == pytest.approx(1 - np.percentile(out, 97.5), abs=1e-12)
    assert got["one"]["mean"] == 0.0 and got["one"].flag == "low"


def test_curves_shrink_and_converge(spark):
    d = spark.createDataFrame([("d", "k", [0.2, 0.3, 0.5])], "dataset string, key string, p_human array<double>")
    c = B.curve_bootstrap(d, (20, 50, 100, 200, 500), 200)
    means = [r.jsd_mean for r in c.orderBy("n").collect()]
    assert means == sorted(means, reverse=True)
    assert B.convergence_n(c, ["dataset", "key"]).first().convergence_n in (50, 100)
    short = spark.createDataFrame([("d", "k", 20, 0.5), ("d", "k", 50, 0.01)], "dataset string, key string, n int, jsd_mean double")
    assert B.convergence_n(short, ["dataset", "key"]).first().convergence_n is None


def test_real_curve_skips_sizes_above_the_pool(spark):
    d = spark.createDataFrame([("d", "k", f"r{i}", "ab"[i % 2]) for i in range(30)], "dataset string, key string, respondent string, option string")
    rows = {r.n: r for r in B.curve_real(d, (10, 30, 50), 4).collect()}
    assert set(rows) == {10, 30} and rows[30].jsd_mean == pytest.approx(0.0, abs=1e-12) and rows[10].replicates == 4


def test_real_curve_from_counts_has_the_same_law(spark):
    rows = [("d", "k", f"r{i}", "abc"[min(i % 5, 2)]) for i in range(60)]
    d = spark.createDataFrame(rows, "dataset string, key string, respondent string, option string")
    q = spark.createDataFrame([("d", "k", [12, 12, 36], 60)], "dataset string, key string, counts array<long>, n long")
    a = {r.n: r for r in B.curve_real(d, (10, 30), 200).collect()}
    b = {r.n: r for r in B.curve_real_counts(q, (10, 30, 100), 2000).collect()}
    assert set(b) == {10, 30}
    for n in (10, 30):
        assert a[n].jsd_mean == pytest.approx(b[n].jsd_mean, rel=0.25)


def test_counts_from_probs(spark):
    cases = [([1 / 3, 1 / 3, 1 / 3], 500), ([0.125] * 8, 500), ([0.7, 0.3], 500)]
    d = spark.createDataFrame([(p,) for p, _ in cases], "p array<double>")
    for (p, n), r in zip(cases, d.select(B.counts_from_probs(F.col("p"), 500).alias("c")).collect()):
        raw = [x * n for x in p]
        want = [round(x) for x in raw]
        diff = n - sum(want)
        if diff:
            frac = [x - int(x) for x in raw]
            want[frac.index(max(frac) if diff > 0 else min(frac))] += diff
        assert r.c == want


# --- clustering -----------------------------------------------------------------------


def test_clusters_and_silhouette(spark):
    people = {f"p{i}": ("x", "y", "z") if i < 5 else ("u", "v", "w") for i in range(9)}
    rows = [("c", p, f"q{j}", a) for p, ans in people.items() for j, a in enumerate(ans)]
    d = spark.createDataFrame(rows, "cohort string, persona string, question string, answer string")
    got = C.ward_clusters(d, ["cohort"]).collect()
    assert {r.pattern: r["size"] for r in got} == {"x|y|z": 5, "u|v|w": 4}
    assert len({r.cluster for r in got}) == 2 and got[0].silhouette == pytest.approx(1.0)
    labelled = d.withColumn("label", F.when(F.col("persona") < "p5", "a").otherwise("b"))
    assert A.silhouette(labelled, ["cohort"]).first().silhouette == pytest.approx(1.0)
    single = labelled.where("persona IN ('p0', 'p5', 'p6')")
    assert A.silhouette(single, ["cohort"]).first().silhouette == pytest.approx(1.0)
