"""Agreement statistics, resampling, ceilings and convergence curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import SAMPLE_SIZES
from ..operators import agreement as A
from ..operators import ceilings as E
from ..operators import clustering as K
from ..operators import curves as C
from ..operators import resample as B
from ..operators import scoring as S
from ..operators import statistics as V
from .oracle import hex8
from .q_rollups import WAVE_LONG, policies
from .registry import query

# --- SQL helpers --------------------------------------------------------------------


def gamma_p(a: str, z: str) -> str:
    """Regularised lower incomplete gamma function."""
    return (
        f"CASE WHEN {z} <= 0 THEN 0e0 ELSE list_sum(list_transform(range(0, 300), "
        f"lambda gi: exp(-({z}) + ({a} + gi) * ln({z}) - lgamma({a} + gi + 1)))) END"
    )


# --- agreement ----------------------------------------------------------------------

FREQ_SQL = "SELECT dataset, option, count(*) AS count, sum(count(*)) OVER (PARTITION BY dataset) AS total, count(*) / sum(count(*)) OVER (PARTITION BY dataset) AS share FROM base GROUP BY dataset, option"


@query("frequency_table", f"""SELECT d.dataset, c.option, coalesce(f.count, 0) AS count, CAST(d.total AS BIGINT) AS total, coalesce(f.count, 0) / d.total AS share FROM (SELECT DISTINCT dataset, total FROM fr) d
    CROSS JOIN (VALUES ('AF'), ('AO'), ('NF'), ('Refused'), ('Absent')) c(option) LEFT JOIN fr f ON f.dataset = d.dataset AND f.option = c.option""", "share", ctes="base", fr=FREQ_SQL)
def frequency_table(s):
    cats = s.small([("AF",), ("AO",), ("NF",), ("Refused",), ("Absent",)], "option string")
    return A.frequency_table(s.base, ["dataset"], cats)


@query("frequency_ci")
def frequency_ci(s):
    return B.proportion_ci(A.frequency_table(s.base, ["dataset", "key"]))


CHI_SQL = "SELECT key, sum((n - e) ** 2 / e) AS statistic, count(*) - 1 AS df, min(e) AS me, sum(n) AS total FROM (SELECT key, n, sum(n) OVER (PARTITION BY key) / CAST(k AS DOUBLE) AS e FROM qopt) GROUP BY key"


@query("chi2_gof", f"""SELECT key, statistic, df, CASE WHEN df > 0 THEN 1e0 - greatest(0e0, least(1e0, {gamma_p('df / 2e0', 'statistic / 2e0')})) ELSE 1e0 END AS p_value,
    CASE WHEN df > 0 THEN sqrt(statistic / (total * df)) ELSE 0e0 END AS cramers_v, me < 5 AS small_expected FROM chi""", "statistic p_value cramers_v", ctes="qopt", chi=CHI_SQL)
def chi2_gof(s):
    return A.chi2_gof(A.frequency_table(s.base, ["key"]), ["key"])


RANK_SQL = "SELECT dataset, model AS rater, option AS item, row_number() OVER (PARTITION BY dataset, model ORDER BY count(*) DESC, option) AS rank FROM base GROUP BY dataset, model, option"


def rankings(s):
    from pyspark.sql import Window

    counts = s.base.groupBy("dataset", F.col("model").alias("rater"), F.col("option").alias("item")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("dataset", "rater").orderBy(F.desc("c"), F.asc("item"))
    return counts.withColumn("rank", F.row_number().over(w)).drop("c")


@query("kendall_w", f"""SELECT dataset, w, n * (k - 1) * w AS chi_squared, 1e0 - greatest(0e0, least(1e0, {gamma_p('(k - 1) / 2e0', 'n * (k - 1) * w / 2e0')})) AS p_value, n, k FROM (
    SELECT dataset, 12e0 * sum((r - n * (k + 1) / 2e0) ** 2) / (n * n * (k * k * k - k)) AS w, n, k FROM (SELECT *, count(*) OVER (PARTITION BY dataset) AS k FROM (
    SELECT dataset, item, CAST(sum(rank) AS DOUBLE) AS r, min(n) AS n FROM rk JOIN (SELECT dataset, count(DISTINCT rater) AS n FROM rk GROUP BY dataset) USING (dataset) GROUP BY dataset, item)) GROUP BY dataset, n, k)""",
       "w chi_squared p_value", ctes="base", rk=RANK_SQL)
def kendall_w(s):
    return A.kendall_w(rankings(s), ["dataset"])


@query("borda", "SELECT dataset, item, avg(k - rank) AS score FROM rk JOIN (SELECT dataset, count(DISTINCT item) AS k FROM rk GROUP BY dataset) USING (dataset) GROUP BY dataset, item", "score", ctes="base", rk=RANK_SQL)
def borda(s):
    return A.borda(rankings(s), ["dataset"])


RATE_SQL = "SELECT dataset, key, year(ts) AS item, model AS rater, min(selected_option) AS value, min(in_tok) AS x FROM base GROUP BY ALL"


def ratings(s):
    return s.base.groupBy("dataset", "key", F.year("ts").alias("item"), F.col("model").alias("rater")).agg(
        F.min("selected_option").alias("value"), F.min("in_tok").alias("x")
    )


def alpha_ctes(value: str, delta: str) -> dict:
    """Coincidence-matrix form, with pairs, as the independent check."""
    return {
        "kc": f"SELECT key, item, v, n, sum(n) OVER (PARTITION BY key, item) AS m FROM (SELECT key, item, {value} AS v, count(*) AS n FROM ra WHERE {value} IS NOT NULL GROUP BY ALL) QUALIFY m >= 2",
        "kn": "SELECT key, v, CAST(sum(n) AS DOUBLE) AS c, CAST(sum(sum(n)) OVER (PARTITION BY key ORDER BY v) AS DOUBLE) AS cum FROM kc GROUP BY key, v",
        "kt": "SELECT key, sum(c) AS n, count(*) AS n_values FROM kn GROUP BY key",
        "ko": f"SELECT a.key, sum(a.n * b.n / (a.m - 1e0) * {delta}) AS o FROM kc a JOIN kc b ON a.key = b.key AND a.item = b.item AND a.v <> b.v JOIN kn x ON x.key = a.key AND x.v = a.v JOIN kn y ON y.key = b.key AND y.v = b.v GROUP BY a.key",
        "ke": f"SELECT x.key, sum(x.c * y.c * {delta}) AS e FROM kn x JOIN kn y ON x.key = y.key AND x.v <> y.v, (SELECT 1) GROUP BY x.key".replace("a.v", "x.v").replace("b.v", "y.v"),
        "kalpha": "SELECT kt.key, CASE WHEN n_values = 1 THEN 1e0 ELSE 1e0 - (coalesce(o, 0e0) / n) / (e / (n * (n - 1))) END AS alpha, CAST(n AS BIGINT) AS n, i.n_items, n_values FROM kt LEFT JOIN ko USING (key) LEFT JOIN ke USING (key) JOIN (SELECT key, count(DISTINCT item) AS n_items FROM kc GROUP BY key) i USING (key)",
    }


NOMINAL = alpha_ctes("value", "1e0")


@query("kripp_alpha", "SELECT * FROM kalpha", "alpha", ctes="base", ra=RATE_SQL, **NOMINAL)
def kripp_alpha(s):
    return A.krippendorff_alpha(ratings(s), ["key"])


@query("kripp_alpha_interval", "SELECT * FROM kalpha", "alpha", ctes="base", ra=RATE_SQL, **alpha_ctes("x", "((a.v - b.v) * (a.v - b.v))"))
def kripp_alpha_interval(s):
    return A.krippendorff_alpha(ratings(s), ["key"], value="x", level="interval")


@query("kripp_alpha_ordinal", "SELECT * FROM kalpha", "alpha", ctes="base", ra=RATE_SQL, **alpha_ctes("value", "(((x.cum - x.c / 2e0) - (y.cum - y.c / 2e0)) ** 2)"))
def kripp_alpha_ordinal(s):
    return A.krippendorff_alpha(ratings(s), ["key"], level="ordinal")


CONVERGENCE_SQL = {
    "tops": "SELECT key, rater, value AS top FROM (SELECT key, rater, value, count(*) AS c FROM ra GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key, rater ORDER BY c DESC, value) = 1",
    "majorities": "SELECT key, top AS majority FROM (SELECT key, top, count(*) AS c FROM tops GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, top) = 1",
    "shares": "SELECT key, rater, string_agg(value || '=' || c || '/' || t, ' ' ORDER BY value) AS said FROM (SELECT key, rater, value, count(*) AS c, CAST(sum(count(*)) OVER (PARTITION BY key, rater) AS BIGINT) AS t FROM ra GROUP BY key, rater, value) GROUP BY key, rater",
    "found": """SELECT *, CASE WHEN alpha >= 0.8e0 THEN 'strong' WHEN alpha >= 0.6e0 THEN 'moderate' WHEN alpha >= 0.4e0 THEN 'weak' ELSE 'none' END AS level, CAST(floor(round(alpha * 100e0, 9) + 0.5e0) AS BIGINT) AS h,
        CASE WHEN n_divergent = 0 THEN 'No model' ELSE 'Models ' || replace(divergent_models, ',', ', ') END AS who FROM kalpha JOIN (
        SELECT t.key, m.majority, count(*) FILTER (t.top <> m.majority) AS n_divergent, count(*) AS n_models, coalesce(string_agg(t.rater, ',' ORDER BY t.rater) FILTER (t.top <> m.majority), '') AS divergent_models,
        string_agg(t.rater || ' ' || t.top || ': ' || said, '; ' ORDER BY t.rater) AS per_model FROM tops t JOIN majorities m USING (key) JOIN shares s ON s.key = t.key AND s.rater = t.rater GROUP BY t.key, m.majority) USING (key)""",
    "report": "SELECT avg(alpha) AS overall_alpha, count(*) FILTER (alpha >= 0.6e0) AS n_convergent, count(*) FILTER (alpha < 0.4e0) AS n_not_convergent FROM found",
}


@query("model_convergence", """SELECT key, alpha, n, n_items, n_values, level, majority, n_divergent, n_models, n_divergent = 0 AS top_choice_agreement, divergent_models, per_model,
    CASE level WHEN 'strong' THEN 'Strong' WHEN 'moderate' THEN 'Moderate' WHEN 'weak' THEN 'Weak' ELSE 'No' END || ' convergence (alpha=' || CASE WHEN h < 0 THEN '-' ELSE '' END || (abs(h) // 100) || '.' || lpad(CAST(abs(h) % 100 AS VARCHAR), 2, '0') || '). '
    || CASE level WHEN 'strong' THEN 'The models agree: ' || majority || ' is the top choice.' WHEN 'moderate' THEN 'The models mostly agree on ' || majority || ', with some variation.'
    WHEN 'weak' THEN 'To be read with caution. ' || who || ' differ from the majority.' ELSE 'The choice of model decides this finding. ' || who || ' differ. Not reliable.' END AS interpretation,
    overall_alpha, CASE WHEN overall_alpha >= 0.8e0 THEN 'strong' WHEN overall_alpha >= 0.6e0 THEN 'moderate' WHEN overall_alpha >= 0.4e0 THEN 'weak' ELSE 'none' END AS overall_level, n_convergent, n_not_convergent FROM found, report""",
       "alpha overall_alpha", ctes="base", ra=RATE_SQL, **NOMINAL, **CONVERGENCE_SQL)
def model_convergence(s):
    """Lists are written as text: every model with its top choice and, per value, count and number of its ratings."""
    said = lambda m: F.array_join(F.transform(m["values"], lambda v: F.concat(v["value"], F.lit("="), v["count"], F.lit("/"), m["n"])), " ")
    models = F.transform("per_model", lambda m: F.concat(F.coalesce(m["rater"], F.lit("")), F.lit(" "), m["top"], F.lit(": "), said(m)))
    d = A.model_convergence(ratings(s), ["key"])
    return d.withColumn("per_model", F.array_join(models, "; ")).withColumn("divergent_models", F.array_join("divergent_models", ","))


@query("robustness", """SELECT dataset, robustness, n_personas, CAST(floor(median_k) AS BIGINT) AS median_k, CASE WHEN robustness >= 0.8e0 THEN 'robust' WHEN robustness >= 0.6e0 THEN 'moderately robust' WHEN robustness >= 0.4e0 THEN 'sensitive' ELSE 'fragile' END AS label FROM (
    SELECT dataset, avg(r) AS robustness, count(*) AS n_personas, quantile_cont(CAST(k AS DOUBLE), 0.5) AS median_k FROM (SELECT dataset, key, avg(CASE WHEN selected_option <> 'AF' AND option = 'AO' THEN 1e0 ELSE 0e0 END) AS r, count(*) AS k FROM base GROUP BY dataset, key) GROUP BY dataset)""", "robustness", ctes="base")
def robustness(s):
    v = s.base.select("dataset", F.col("key").alias("persona"), F.when(F.col("selected_option") != "AF", F.col("option")).alias("response"))
    return A.robustness(v.fillna("none", ["response"]), ["dataset"], "AO")


# personas: customers; questions: their order priorities and states; label: the market segment
PERSONA_SQL = """SELECT CAST(c_nationkey AS BIGINT) AS cohort, c_custkey AS persona, question, answer, c_mktsegment AS label FROM customer JOIN (
    SELECT o_custkey, min(o_orderpriority) AS p, max(o_orderstatus) AS st, max(o_orderpriority) AS q FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey,
    LATERAL (VALUES ('first', p), ('last', q), ('state', st)) v(question, answer)"""


def personas(s):
    o = s.table("orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"), F.max("o_orderpriority").alias("q"), F.max("o_orderstatus").alias("st"))
    d = s.table("customer").join(o, F.col("o_custkey") == F.col("c_custkey"))
    return d.select(
        F.col("c_nationkey").cast("bigint").alias("cohort"), F.col("c_custkey").alias("persona"), F.col("c_mktsegment").alias("label"),
        F.explode(F.create_map(F.lit("first"), "p", F.lit("last"), "q", F.lit("state"), "st")).alias("question", "answer"),
    )


@query("silhouette", """SELECT cohort, avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END) AS silhouette, count(*) AS n_personas FROM (
    SELECT cohort, persona, max(CASE WHEN own THEN CASE WHEN n <= 1 THEN 0e0 ELSE d / (n - 1) END END) AS a, min(CASE WHEN NOT own THEN d / n END) AS b FROM (
      SELECT x.cohort, x.persona, y.label, x.label = y.label AS own, sum(CASE WHEN x.answer <> y.answer THEN 2e0 ELSE 0e0 END) AS d, count(DISTINCT y.persona) AS n FROM pe x JOIN pe y ON x.cohort = y.cohort AND x.question = y.question GROUP BY ALL) GROUP BY ALL) GROUP BY cohort""", "silhouette", pe=PERSONA_SQL)
def silhouette(s):
    return A.silhouette(personas(s), ["cohort"])


@query("persona_cluster")
def persona_cluster(s):
    return K.cluster_patterns(personas(s).drop("label"), ["cohort"])


@query("concentration", """SELECT model, avg(h) AS entropy, avg(log2(k) - h) AS kl_uniform, avg(1e0 - h / log2(k)) AS concentration, avg(CASE WHEN mx >= 0.99e0 THEN 1e0 ELSE 0e0 END) AS degenerate_share FROM (
    SELECT run_id, key, min(model) AS model, -sum(CASE WHEN p_model > 0 THEN p_model * log2(p_model) ELSE 0e0 END) AS h, CAST(min(k) AS DOUBLE) AS k, max(p_model) AS mx FROM long GROUP BY run_id, key) WHERE k > 1 GROUP BY model""",
       "entropy kl_uniform concentration degenerate_share", ctes="long")
def concentration(s):
    return A.concentration(s.scored, ["model"])


CORE_SQL = {
    "ent": "SELECT q.key, t.topic, h, CASE WHEN round(h, 12) < 1e0 THEN 'low' WHEN round(h, 12) <= 1.5e0 THEN 'medium' ELSE 'high' END AS band FROM (SELECT key, -sum(p_human * log2(p_human)) AS h FROM qopt GROUP BY key) q JOIN qtopics t USING (key)",
    "gsh": "SELECT g.key, g.grp, o.option, coalesce(c.n, 0) / g.total AS p FROM (SELECT key, grp, count(*) AS total FROM grouped GROUP BY ALL) g JOIN qopt o ON o.key = g.key LEFT JOIN (SELECT key, grp, option, count(*) AS n FROM grouped GROUP BY ALL) c ON c.key = g.key AND c.grp = g.grp AND c.option = o.option",
    "gvar": "SELECT key, avg(v) AS variance FROM (SELECT key, option, var_pop(p) AS v FROM gsh GROUP BY ALL) GROUP BY key",
    "cand": f"SELECT e.*, coalesce(round(variance, 9), 0e0) AS variance, {hex8(chr(39) + 'core|' + chr(39) + ' || e.key')} AS u FROM ent e LEFT JOIN gvar g USING (key)",
    "sens": "SELECT *, variance >= (SELECT round(quantile_cont(variance, 2e0 / 3e0), 9) FROM cand) AS sensitive FROM cand",
    "cho": "SELECT * FROM sens WHERE sensitive QUALIFY row_number() OVER (PARTITION BY topic, band ORDER BY u) <= 4",
    "fil": "SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY topic, band ORDER BY u) AS rn FROM sens WHERE key NOT IN (SELECT key FROM cho)) r LEFT JOIN (SELECT topic, band, count(*) AS have FROM cho GROUP BY ALL) c ON c.topic = r.topic AND c.band = r.band WHERE rn <= 13 - coalesce(have, 0)",
}


@query("core_sample", "SELECT key, topic, band, sensitive FROM cho UNION ALL SELECT key, topic, band, sensitive FROM fil", ctes="qtopics qopt grouped", **CORE_SQL)
def core_sample(s):
    q = s.questions.join(s.topics, "key")
    g = S.question_distributions(s.grouped, ["key", "group"]).select("key", F.map_from_arrays("options", "p_human").alias("m"))
    from ..functions.distance import align

    g = g.join(s.questions.select("key", F.col("options").alias("all")), "key").select("key", align(F.col("all"), F.col("m")).alias("p"))
    return A.core_sample(q, g, 13).select("key", "topic", "band", "sensitive")


# --- bootstrap ----------------------------------------------------------------------


@query("bca_ci")
def bca_ci(s):
    return V.statistic_ci(s.scored, ["run_id"], "key", ["parity"])


@query("bca_ci_median")
def bca_ci_median(s):
    return V.statistic_ci(s.scored, ["run_id"], "key", ["jsd"], "median")


@query("bca_ci_cv")
def bca_ci_cv(s):
    return V.statistic_ci(s.metrics, ["run_id"], "key", ["parity"], "cv")


@query("bca_ci_tau")
def bca_ci_tau(s):
    """Do questions that people refuse get refused by the model, over the questions of a run?"""
    return V.statistic_ci(s.scored, ["run_id"], "key", ["human_refusal_rate", "model_refusal_rate"], "tau")


ESTIMATE_SQL = """SELECT run_id, count(*) AS n, avg(parity) AS mean, quantile_cont(jsd, 0.5) AS median, stddev_samp(parity) / avg(parity) AS cv, CASE WHEN var_pop(human_refusal_rate) * var_pop(model_refusal_rate) > 0 THEN corr(human_refusal_rate, model_refusal_rate) ELSE 0e0 END AS correlation FROM scored GROUP BY run_id HAVING count(*) >= 5"""


@query("bca_estimates", ESTIMATE_SQL, "mean median cv correlation", ctes="scored")
def bca_estimates(s):
    """The estimates of several statistics side by side."""
    of = {"mean": ["parity"], "median": ["jsd"], "cv": ["parity"], "correlation": ["human_refusal_rate", "model_refusal_rate"]}
    out = None
    for name, columns in of.items():
        one = V.statistic_ci(s.metrics, ["run_id"], "key", columns, name, resamples=10)
        one = one.select("run_id", *(["n"] if out is None else []), F.col("estimate").alias(name))
        out = one if out is None else out.join(one, "run_id")
    return out


@query("run_ci")
def run_ci(s):
    return B.run_ci(s.metrics)


@query("run_ci_kernel")
def run_ci_kernel(s):
    """Intervals of the resampled values themselves, before they are turned into scores."""
    return V.statistic_ci(B.run_metric_rows(s.metrics), ["run_id", "metric"], "key", ["x"])


@query("paired_test")
def paired_test(s):
    return B.paired_bootstrap(B.run_pair_diffs(s.scored, ["dataset"]), ["dataset", "run_a", "run_b"])


@query("paired_deltas", "SELECT a.dataset, a.model AS run_a, b.model AS run_b, avg(a.parity - b.parity) AS delta, count(*) AS n FROM scored a JOIN scored b ON a.dataset = b.dataset AND a.key = b.key AND a.model < b.model GROUP BY ALL", "delta", ctes="scored")
def paired_deltas(s):
    return B.run_pair_diffs(s.scored, ["dataset"]).groupBy("dataset", "run_a", "run_b").agg(F.avg("d").alias("delta"), F.count("*").alias("n"))


@query("j_compare_significance")
def j_compare_significance(s):
    a, b = s.scored.where("model = 'm1'"), s.scored.where("model = 'm3'")
    return B.paired_test(a, b, ["dataset"])


@query("ensemble_ci")
def ensemble_ci(s):
    return B.percentile_ci(B.boot_means(s.scored, ["run_id"], "key", "parity", 1000), ["run_id"])


R = 50  # replicates of the hash-drawn check


def boot_ctes(source: str, by: str, key: str, value: str, resamples: int, seed: str = "42") -> dict:
    group = f"concat_ws('/', {by})"
    return {
        "bx": f"SELECT {by}, {group} AS g, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY substr(md5({key}), 1, 2), {key}) - 1 AS idx, count(*) OVER (PARTITION BY {by}) AS n FROM {source}",
        "bd": f"SELECT g, b, n, CAST(floor({hex8(f'''concat_ws('|', {seed}, g, b, idx)''')} / 4294967296e0 * n) AS BIGINT) AS t FROM bx, range(0, {resamples}) r(b)",
        "bm": f"SELECT {', '.join('bx.' + c.strip() for c in by.split(','))}, bd.b, avg(bx.x) AS mean FROM bd JOIN bx ON bx.g = bd.g AND bx.idx = bd.t GROUP BY ALL",
    }


DRIFT = {"wy": """SELECT *, abs(ya - yb) AS gap, concat_ws('|', stem, key_a, key_b) AS pair, 'all' AS a FROM (SELECT *, """ + " , ".join(
    f"CASE regexp_extract({c}, '([0-9]+)$', 1) WHEN '26' THEN 2017 WHEN '32' THEN 2018 WHEN '36' THEN 2019 WHEN '49' THEN 2020 WHEN '82' THEN 2022 ELSE 0 END AS {a}" for c, a in (("survey_a", "ya"), ("survey_b", "yb"))
) + " FROM wj) WHERE ya > 0 AND yb > 0"}


@query("temporal_drift", "SELECT gap, avg(jsd) AS mean_jsd, count(*) AS n_pairs FROM wy GROUP BY gap", "mean_jsd", "gap", ctes="wopt", **WAVE_LONG, **DRIFT)
def temporal_drift(s):
    return B.temporal_drift(s.waves)[2]


@query("temporal_drift_overall", "SELECT avg(w.jsd) AS mean_drift, count(*) AS n_pairs, count(DISTINCT stem) AS n_stems, min(c.lo) AS ci_low, min(c.hi) AS ci_high FROM wy w, (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM bm) c",
       "mean_drift ci_low ci_high", ctes="wopt", **WAVE_LONG, **DRIFT, **boot_ctes("wy", "a", "pair", "jsd", R))
def temporal_drift_overall(s):
    return B.temporal_drift(s.waves, R, hashed=True)[1]


@query("temporal_drift_ci")
def temporal_drift_ci(s):
    return B.temporal_drift(s.waves)[1]


# --- ceilings -----------------------------------------------------------------------


@query("ceiling")
def ceiling(s):
    d = B.ceiling(s.questions.select("dataset", "key", "counts"))
    return d.select("dataset", "key", "mean", "ci_low", "ci_high", "n_effective", "flag")


@query("ceiling_tau")
def ceiling_tau(s):
    d = B.ceiling(s.questions.select("dataset", "key", "counts"), "tau")
    return d.select("dataset", "key", "mean", "ci_low", "ci_high", "n_effective", "flag")


def ceiling_ctes(name: str, source: str, by: str) -> dict:
    """Exact mean ceilings from factorials: per option E phi(h draws) - E phi(2h draws), phi(x) = x log2 x."""
    cols = ", ".join(f"{c.strip()}" for c in by.split(","))
    flag = "CASE WHEN pool >= 400 THEN 'high' WHEN pool >= 200 THEN 'medium' ELSE 'low' END"
    reach = "(10 * sqrt(m * p * (1e0 - p)) + 10)"
    return {
        f"{name}c": f"SELECT {cols}, n AS c, CAST(sum(n) OVER (PARTITION BY {cols}) AS BIGINT) AS pool FROM {source}",
        f"{name}t": f"""SELECT c, pool, sum(CASE WHEN k = 1 THEN v ELSE -v END) AS term FROM (SELECT c, pool, k, sum(w * CASE WHEN x > 0 THEN x / m * log2(x / m) ELSE 0e0 END) / sum(w) AS v FROM (
            SELECT *, exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + x * ln(p) + (m - x) * ln(1e0 - p)) AS w FROM (
            SELECT *, unnest(range(CAST(greatest(0, floor(m * p - {reach})) AS BIGINT), CAST(least(m, ceil(m * p + {reach})) AS BIGINT) + 1)) AS x FROM (
            SELECT c, pool, c / pool AS p, k, k * (pool // 2) AS m FROM (SELECT DISTINCT c, pool FROM {name}c), (VALUES (1), (2)) s(k) WHERE c < pool AND pool >= 2))) GROUP BY c, pool, k) GROUP BY c, pool""",
        name: f"SELECT {cols}, CASE WHEN pool >= 2 THEN 1e0 - sum(coalesce(t.term, 0e0)) ELSE 0e0 END AS mean, pool AS n_effective, {flag} AS flag FROM {name}c LEFT JOIN {name}t t USING (c, pool) GROUP BY {cols}, pool",
    }


CAGG = lambda by, src: f"SELECT {by}, sum(n_effective * mean) / sum(n_effective) AS mean, CAST(sum(n_effective) AS BIGINT) AS n_effective, count(*) AS n_questions, CASE min(CASE flag WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS flag FROM {src} GROUP BY {by}"
CEILING = ceiling_ctes("ce", "qopt", "dataset, key")


@query("ceiling_expected", "SELECT * FROM ce", "mean", ctes="qopt", **CEILING)
def ceiling_expected(s):
    return E.expected_ceiling(s.questions.select("dataset", "key", "counts")).drop("counts")


@query("ceiling_agg", CAGG("dataset", "ce"), "mean", ctes="qopt", **CEILING)
def ceiling_agg(s):
    return B.ceiling_agg(E.expected_ceiling(s.questions.select("dataset", "key", "counts")), ["dataset"])


@query("ceiling_agg_drawn")
def ceiling_agg_drawn(s):
    return B.ceiling_agg(B.ceiling(s.questions.select("dataset", "key", "counts")), ["dataset"])


def wave_counts(s):
    return s.waves.where("n >= 10").select(F.col("survey").alias("wave"), "key", "counts")


@query("ceiling_wave")
def ceiling_wave(s):
    per, overall = B.ceiling_levels(B.ceiling(wave_counts(s)), ["wave"])
    cols = ["mean", "ci_low", "ci_high", "n_effective", "n_questions", "flag"]
    return per.select("wave", *cols).unionByName(overall.select(F.lit("overall").alias("wave"), *cols))


@query("ceiling_wave_expected", CAGG("wave", "wce"), "mean", ctes="wopt", wq="SELECT survey AS wave, key, option, n FROM wopt QUALIFY sum(n) OVER (PARTITION BY key) >= 10", **ceiling_ctes("wce", "wq", "wave, key"))
def ceiling_wave_expected(s):
    return B.ceiling_agg(E.expected_ceiling(wave_counts(s)), ["wave"])


# subgroups: a question is one brand of a data set; market segment, nation and year are the attributes
CUT_SQL = """SELECT dataset, brand, attribute, grp, option, count(*) AS n FROM (
    SELECT g.dataset, p_brand AS brand, option, grp AS seg, CAST(c_nationkey AS VARCHAR) AS nat, CAST(year(ts) AS VARCHAR) AS yr FROM grouped g JOIN parts USING (key)),
    LATERAL (VALUES ('segment', seg), ('nation', nat), ('year', yr), ('segment_nation', seg || ' × ' || nat), ('segment_year', seg || ' × ' || yr), ('nation_year', nat || ' × ' || yr)) v(attribute, grp)
    GROUP BY dataset, brand, attribute, grp, option QUALIFY sum(count(*)) OVER (PARTITION BY dataset, brand, attribute, grp) >= 10"""
CUTS = {"cut": CUT_SQL, **ceiling_ctes("sce", "cut", "dataset, brand, attribute, grp"), "sub": CAGG("attribute, grp", "sce")}


def cuts(s):
    rows = s.grouped.join(s.part.select("key", F.col("p_brand").alias("brand")), "key")
    return E.cross_cuts(rows, ["dataset", "brand"], {"segment": F.col("group"), "nation": F.col("c_nationkey"), "year": F.year("ts")})


def exact_subgroups(s):
    return E.subgroup_ceilings(cuts(s), resamples=None)


@query("ceiling_subgroup")
def ceiling_subgroup(s):
    return E.subgroup_ceilings(cuts(s))


@query("ceiling_cross_cuts", 'SELECT dataset, brand, attribute, grp AS "group", list(n ORDER BY option)::VARCHAR AS counts FROM cut GROUP BY ALL', ctes="grouped", cut=CUT_SQL)
def ceiling_cross_cuts(s):
    return cuts(s).withColumn("counts", F.concat(F.lit("["), F.array_join(F.transform("counts", lambda c: c.cast("string")), ", "), F.lit("]")))


@query("ceiling_subgroup_expected", 'SELECT * RENAME (grp AS "group") FROM sub', "mean", ctes="grouped", **CUTS)
def ceiling_subgroup_expected(s):
    return exact_subgroups(s)


@query("ceiling_subgroup_spread", "SELECT min(mean) AS min, quantile_cont(mean, 0.25) AS p25, quantile_cont(mean, 0.5) AS median, quantile_cont(mean, 0.75) AS p75, max(mean) AS max FROM sub", "min p25 median p75 max", ctes="grouped", **CUTS)
def ceiling_subgroup_spread(s):
    return B.ceiling_spread(exact_subgroups(s))[0]


@query("ceiling_subgroup_spread_approx")
def ceiling_subgroup_spread_approx(s):
    return B.ceiling_spread(exact_subgroups(s), approx=True)[0]


@query("ceiling_subgroup_worst", 'SELECT * RENAME (grp AS "group") FROM sub ORDER BY sub.mean, attribute, grp LIMIT 5', "mean", ctes="grouped", **CUTS)
def ceiling_subgroup_worst(s):
    return B.ceiling_spread(exact_subgroups(s), ties=["attribute", "group"])[1]


@query("ceiling_subgroup_flags", "SELECT flag, count(*) AS n FROM sub GROUP BY flag", ctes="grouped", **CUTS)
def ceiling_subgroup_flags(s):
    return B.ceiling_spread(exact_subgroups(s))[2]


def _inferred(s, n: int, by: str, source):
    d = source.withColumn("counts", B.counts_from_probs(F.col("p_human"), n)).select(by, "key", "counts")
    return B.ceiling_agg(B.ceiling(d), [by], inferred=True)


@query("ceiling_subpop")
def ceiling_subpop(s):
    return _inferred(s, 500, "group", S.question_distributions(s.grouped, ["group", "key"]))


@query("ceiling_country")
def ceiling_country(s):
    return _inferred(s, 1000, "c_nationkey", S.question_distributions(s.grouped, ["c_nationkey", "key"]))


COUNTS_SQL = """SELECT key, option, CAST(c + CASE WHEN d <> 0 AND row_number() OVER (PARTITION BY key ORDER BY CASE WHEN d > 0 THEN -f ELSE f END, option) = 1 THEN d ELSE 0 END AS BIGINT) AS c FROM (
    SELECT *, 500 - sum(c) OVER (PARTITION BY key) AS d FROM (SELECT key, option, round_even(p_human * 500, 0) AS c, p_human * 500 - floor(p_human * 500) AS f FROM qopt))"""


@query("counts_from_probs", COUNTS_SQL, ctes="qopt")
def counts_from_probs(s):
    d = s.questions.withColumn("c", B.counts_from_probs(F.col("p_human"), 500))
    return d.select("key", F.explode(F.arrays_zip(F.col("options").alias("option"), "c")).alias("z")).select("key", "z.option", "z.c")


# --- convergence curves -------------------------------------------------------------

DRAW_SQL = {
    "cumq": "SELECT key, option, sum(n) OVER (PARTITION BY key ORDER BY option) AS hi, sum(n) OVER (PARTITION BY key ORDER BY option) - n AS lo, sum(n) OVER (PARTITION BY key) AS n FROM qopt",
    "dr": f"SELECT key, b, i, floor({hex8(chr(39) + '42|' + chr(39) + ' || key || ' + chr(39) + '|' + chr(39) + ' || b || ' + chr(39) + '|' + chr(39) + ' || i')} / 4294967296e0 * n) AS at FROM (SELECT DISTINCT key, n FROM cumq), range(0, 2) r(b), range(0, 20) t(i)",
}


@query("multinomial_sample")
def multinomial_sample(s):
    return B.multinomial_counts(s.questions, 10_000, 500)


@query("multinomial_totals", "SELECT dataset, key, count(*) AS n_options, 5000000 AS total FROM qopt GROUP BY dataset, key", "", "total", ctes="qopt")
def multinomial_totals(s):
    """Every replicate hands out its draws whole."""
    d = B.multinomial_counts(s.questions, 10_000, 500)
    return d.groupBy("dataset", "key").agg(F.count("*").alias("n_options"), F.sum(F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))


@query("multinomial_hash", "SELECT d.key, d.b, c.option, count(*) AS draws FROM dr d JOIN cumq c ON c.key = d.key AND d.at >= c.lo AND d.at < c.hi GROUP BY ALL", "", "b", ctes="qopt", **DRAW_SQL)
def multinomial_hash(s):
    return B.multinomial_hash(s.questions, 20, 2)


@query("curve_bootstrap")
def curve_bootstrap(s):
    return B.curve_bootstrap(s.questions)


# exact means: one sum over the draws that an option's count can give, per distinct (count, pool) and size
SIZES = ", ".join(f"({n})" for n in SAMPLE_SIZES)


def curve_ctes(name: str, replace: bool) -> dict:
    """Exact curve means from factorials, as the independent check."""
    choose = lambda a, b: f"lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1)"
    if replace:
        low, high, log, where = "0", "n", f"{choose('n', 'x')} + x * ln(p) + (n - x) * ln(1e0 - p)", ""
        var = "n * p * (1e0 - p)"
    else:
        low, high, where = "greatest(0, n - (pool - c))", "least(n, c)", " AND n <= pool"
        log = f"{choose('c', 'x')} + {choose('(pool - c)', '(n - x)')} - ({choose('pool', 'n')})"
        var = "n * p * (1e0 - p) * (pool - n) / (pool - 1)"
    return {
        f"{name}p": "SELECT DISTINCT c, pool FROM (SELECT n AS c, CAST(sum(n) OVER (PARTITION BY key) AS BIGINT) AS pool FROM qopt)",
        f"{name}t": f"""SELECT c, pool, n, sum(w * g) / sum(w) AS term FROM (SELECT c, pool, n, exp({log}) AS w, (CASE WHEN x > 0 THEN x / n * log2(x / n / ((x / n + p) / 2e0)) ELSE 0e0 END + p * log2(p / ((x / n + p) / 2e0))) / 2e0 AS g FROM (
            SELECT *, unnest(range(CAST(greatest({low}, floor(n * p - 10 * sqrt({var}) - 10)) AS BIGINT), CAST(least({high}, ceil(n * p + 10 * sqrt({var}) + 10)) AS BIGINT) + 1)) AS x FROM (
            SELECT c, pool, c / pool AS p, CAST(s.n AS BIGINT) AS n FROM {name}p, (VALUES {SIZES}) s(n) WHERE c < pool{where}))) GROUP BY c, pool, n""",
        name: f"SELECT q.dataset, q.key, q.s AS n, sum(coalesce(t.term, 0e0)) AS jsd_mean FROM (SELECT dataset, key, o.n AS c, CAST(sum(o.n) OVER (PARTITION BY key, s.n) AS BIGINT) AS pool, CAST(s.n AS BIGINT) AS s FROM qopt o, (VALUES {SIZES}) s(n)) q LEFT JOIN {name}t t ON t.c = q.c AND t.pool = q.pool AND t.n = q.s {'' if replace else 'WHERE q.s <= q.pool'} GROUP BY ALL",
    }


CURVE = curve_ctes("cv", True)
REAL_CURVE = curve_ctes("rv", False)


@query("curve_expected", "SELECT * FROM cv", "jsd_mean", ctes="qopt", **CURVE)
def curve_expected(s):
    return C.expected_curve(s.questions)


@query("curve_real_expected", "SELECT * FROM rv", "jsd_mean", ctes="qopt", **REAL_CURVE)
def curve_real_expected(s):
    return C.expected_curve(s.questions, replace=False)


@query("curve_real")
def curve_real(s):
    return B.curve_real_counts(s.questions)


@query("curve_real_kernel")
def curve_real_kernel(s):
    return C.curve_walk(s.questions, replace=False, whole=True).drop("convergence_n")


CONV_SQL = "SELECT dataset, key, arg_min(CASE WHEN l2 IS NOT NULL THEN n END, n) FILTER (ok) AS convergence_n, min(n) FILTER (ok) AS first_ok, arg_min(l2 IS NOT NULL, n) FILTER (ok) AS has FROM (SELECT *, jsd_mean < 0.02e0 AND (l2 IS NULL OR greatest(jsd_mean - l1, jsd_mean - l2) <= 0.005e0) AS ok FROM (SELECT *, lead(jsd_mean, 1) OVER w AS l1, lead(jsd_mean, 2) OVER w AS l2 FROM cv WINDOW w AS (PARTITION BY key ORDER BY n))) GROUP BY dataset, key"
CN_SQL = "SELECT dataset, key, CASE WHEN has THEN first_ok END AS convergence_n FROM cn"


def converged(s):
    return B.convergence_n(C.expected_curve(s.questions), ["dataset", "key"])


@query("convergence_n", CN_SQL, "", "convergence_n", ctes="qopt", **CURVE, cn=CONV_SQL)
def convergence_n(s):
    return converged(s)


@query("convergence_walk")
def convergence_walk(s):
    return C.walk_convergence(C.curve_walk(s.questions))


@query("curve_report", f"SELECT dataset, count(*) AS n_questions, count(convergence_n) AS n_converged, count(*) - count(convergence_n) AS n_unconverged, {', '.join(f'CAST(floor(quantile_cont(CAST(convergence_n AS DOUBLE), {q})) AS BIGINT) AS convergence_n_p{p}' for p, q in ((50, 0.5), (90, 0.9), (99, 0.99)))} FROM ({CN_SQL}) GROUP BY dataset", ctes="qopt", **CURVE, cn=CONV_SQL)
def curve_report(s):
    return B.curve_summary(converged(s), ["dataset"])


@query("curve_report_approx")
def curve_report_approx(s):
    return B.curve_summary(converged(s), ["dataset"], approx=True)


@query("curve_compare", "SELECT r.dataset, r.key, r.n, r.jsd_mean - c.jsd_mean AS delta_jsd_mean FROM rv r JOIN cv c ON c.key = r.key AND c.n = r.n", "delta_jsd_mean", "n", ctes="qopt", **CURVE, **REAL_CURVE)
def curve_compare(s):
    return B.curve_compare(C.expected_curve(s.questions, replace=False), C.expected_curve(s.questions))


@query("j_real_vs_bootstrap")
def j_real_vs_bootstrap(s):
    return B.curve_compare(B.curve_real_counts(s.questions), B.curve_bootstrap(s.questions))


@query("curve_payload", "SELECT c.dataset, c.key, n, jsd_mean, p.tier FROM cv c JOIN policies p ON p.dataset = split_part(c.dataset, ' ', 1) WHERE p.tier IN ('full', 'gated')", "jsd_mean", "n", ctes="qopt policies", **CURVE)
def curve_payload(s):
    rows, _ = B.curve_payload(C.expected_curve(s.questions), s.part.select("dataset").distinct(), policies(s))
    return rows.select("dataset", "key", "n", "jsd_mean", "tier")


@query("baseline_lookup", "SELECT q.dataset, q.key, q.option, q.p_human FROM qopt q WHERE dataset = 'gss' AND key = (SELECT min(key) FROM qopt WHERE dataset = 'gss' AND key = 'P1') OR (dataset = 'ntia' AND key = 'P10')", "p_human", ctes="qopt")
def baseline_lookup(s):
    out = None
    for dataset, key in (("gss", "P1"), ("ntia", "P10")):
        d = B.baseline_lookup(s.questions, policies(s), dataset, key)
        d = d.select("dataset", "key", F.explode(F.arrays_zip(F.col("options").alias("option"), "p_human")).alias("z")).select("dataset", "key", "z.option", "z.p_human")
        out = d if out is None else out.unionByName(d)
    return out
