"""Quality and integrity checks over reported values that partly disagree with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as V
from ..operators import scoring as S
from .oracle import parity_of, private
from .registry import query

# what the runs claim about themselves: some models report wrong values
REP = """SELECT r.run_id, r.dataset, c.provider, r.model, n_questions + CASE r.model WHEN 'm2' THEN 1 ELSE 0 END AS n_questions,
    mean_jsd + CASE r.model WHEN 'm5' THEN 0.05e0 WHEN 'm6' THEN 1.2e0 ELSE 0e0 END AS mean_jsd, mean_tau - CASE r.model WHEN 'm5' THEN 0.05e0 WHEN 'm6' THEN 3e0 ELSE 0e0 END AS mean_tau,
    composite_parity + CASE r.model WHEN 'm5' THEN 0.3e0 ELSE 0e0 END AS composite_parity, median_jsd, p_dist, p_rank + CASE r.model WHEN 'm7' THEN 0.02e0 ELSE 0e0 END AS p_rank, p_refuse, sps,
    CASE r.model WHEN 'm4' THEN 1.5e0 END AS parse_failure_rate FROM runscore r JOIN models c USING (model)"""
REPQ = """SELECT * REPLACE (jsd + CASE WHEN n_samples = 1 THEN 0.113e0 ELSE 0e0 END AS jsd, tau - CASE WHEN n_samples = 2 THEN 0.117e0 ELSE 0e0 END AS tau), jsd AS true_jsd, tau AS true_tau FROM scored"""


def _by_model(default: float, **values: float):
    out = F.lit(default)
    for m, v in values.items():
        out = F.when(F.col("run_model") == m, F.lit(v)).otherwise(out)
    return out


def reported(s):
    return (
        s.runs.withColumn("n_questions", F.col("n_questions") + F.when(F.col("run_model") == "m2", 1).otherwise(0))
        .withColumn("mean_jsd", F.col("mean_jsd") + _by_model(0.0, m5=0.05, m6=1.2))
        .withColumn("mean_tau", F.col("mean_tau") - _by_model(0.0, m5=0.05, m6=3.0))
        .withColumn("composite_parity", F.col("composite_parity") + _by_model(0.0, m5=0.3))
        .withColumn("p_rank", F.col("p_rank") + _by_model(0.0, m7=0.02))
        .withColumn("parse_failure_rate", F.when(F.col("run_model") == "m4", 1.5))
    )


def reported_questions(s):
    n = F.col("n_samples")
    return s.scored.withColumn("jsd", F.col("jsd") + F.when(n == 1, 0.113).otherwise(0.0)).withColumn(
        "tau", F.col("tau") - F.when(n == 2, 0.117).otherwise(0.0)
    )


def union_sql(rules: list[tuple[str, str, str, str]], source: str, tier: int) -> str:
    """rules: (condition, code, severity, path expression)"""
    return " UNION ALL ".join(
        f"SELECT run_id, {tier} AS tier, '{code}' AS code, '{sev}' AS severity, {path} AS path FROM {source} WHERE {cond}"
        for cond, code, sev, path in rules
    )


BOUNDS = [
    (f"{c} IS NOT NULL AND NOT ({c} BETWEEN 0 AND 1)", "BOUNDS_RANGE", "error", f"'{c}'")
    for c in ("composite_parity", "mean_jsd", "median_jsd", "parse_failure_rate", "sps", "p_dist", "p_rank", "p_refuse")
] + [("NOT (mean_tau BETWEEN -1 AND 1)", "BOUNDS_RANGE", "error", "'mean_kendall_tau'")]


@query("v_bounds", union_sql(BOUNDS, "rep", 1), "", "tier", "runscore models", rep=REP)
def v_bounds(s):
    return V.v_bounds(reported(s))


def skewed(s):
    """Model sides pushed off: some sum to 1.02, some carry a negative weight."""
    n = F.col("n_samples")
    p = F.when(n == 3, F.transform("p_model", lambda x: x * 1.02)).when(
        n == 5, F.transform("p_model", lambda x, i: F.when(i == 0, x - 0.5).otherwise(x))
    ).otherwise(F.col("p_model"))
    return s.scored.withColumn("p_model", p)


SKEW = """SELECT run_id, key, sum(p) AS s, min(p) AS lo FROM (SELECT l.run_id, l.key, CASE WHEN c.answered + c.refused = 3 THEN p_model * 1.02e0
    WHEN c.answered + c.refused = 5 AND row_number() OVER (PARTITION BY l.run_id, l.key ORDER BY l.option) = 1 THEN p_model - 0.5e0 ELSE p_model END AS p FROM long l JOIN cells c USING (run_id, key)) GROUP BY ALL"""


@query("v_dist", f"SELECT run_id, code, count(*) AS n FROM ({union_sql([('round(lo, 12) < -5e-3', 'DIST_NEGATIVE', 'error', 'key'), ('s > 5e-3 AND abs(s - 1e0) > 5e-3', 'DIST_SUM', 'error', 'key')], 'skew', 1)}) GROUP BY ALL", ctes="long cells", skew=SKEW)
def v_dist(s):
    return V.v_dist(skewed(s)).groupBy("run_id", "code").agg(F.count("*").alias("n"))


@query("v_qset", "SELECT run_id, 1 AS tier, code, 'error' AS severity, path FROM (SELECT run_id, h, CASE WHEN model = 'm3' THEN 'stale' ELSE h END AS r, min(h) FILTER (model = 'm1') OVER (PARTITION BY dataset) AS e FROM qh), (VALUES ('QSET_HASH', 'config.question_set_hash'), ('QSET_HASH_DATASET', 'per_question')) v(code, path) WHERE (code = 'QSET_HASH' AND r <> h) OR (code = 'QSET_HASH_DATASET' AND e <> h)",
       "", "tier", "cells", qh="SELECT run_id, dataset, model, sha256(string_agg(key, chr(10) ORDER BY key)) AS h FROM cells GROUP BY ALL")
def v_qset(s):
    hashes = S.question_set_hash(s.scored, ["run_id", "dataset", "model"])
    claims = hashes.withColumn("question_set_hash", F.when(F.col("model") == "m3", "stale").otherwise(F.col("question_set_hash")))
    expected = hashes.where("model = 'm1'").select("dataset", "question_set_hash")
    return V.v_qset(claims, hashes.select("run_id", "question_set_hash"), expected)


@query("v_count", "SELECT run_id, 1 AS tier, 'COUNT_MISMATCH' AS code, 'error' AS severity, 'aggregate.n_questions' AS path FROM rep JOIN (SELECT run_id, count(*) AS n FROM scored GROUP BY run_id) USING (run_id) WHERE n_questions <> n", "", "tier", "runscore models scored", rep=REP)
def v_count(s):
    return V.v_count(reported(s), s.scored)


HOLD = {
    "hq": "SELECT * REPLACE (CASE WHEN model = 'm1' AND p THEN 1e0 ELSE jsd END AS jsd) FROM (SELECT *, " + private("dataset", "key") + " AS p FROM scored) WHERE NOT (model = 'm6' AND p)",
    "hs": f"""SELECT run_id, dataset, count(*) FILTER (p) AS b, count(*) FILTER (NOT p) AS a, abs({parity_of('avg(jsd) FILTER (NOT p)', 'avg(tau) FILTER (NOT p)')} - {parity_of('avg(jsd) FILTER (p)', 'avg(tau) FILTER (p)')}) AS d FROM hq GROUP BY run_id, dataset""",
}
HOLD_RULES = [
    ("b = 0", "HOLDOUT_MISSING_PRIVATE", "error", "'per_question'"),
    ("b > 0 AND d > greatest(0.05e0, 0.5e0 / sqrt(least(a, b)))", "HOLDOUT_DIVERGENCE", "warning", "'aggregate'"),
]


@query("v_holdout", union_sql(HOLD_RULES, "(SELECT * FROM hs WHERE a + b >= 25 AND dataset <> 'pilot (2024)')", 1), "", "tier", "scored", **HOLD)
def v_holdout(s):
    d = s.public.where(~((F.col("model") == "m6") & F.col("is_private")))
    worse = (F.col("model") == "m1") & F.col("is_private")
    return V.v_holdout(d.withColumn("jsd", F.when(worse, 1.0).otherwise(F.col("jsd"))))


PERQ = [("abs(true_jsd - jsd) > 3e-2", "PER_Q_JSD", "error", "key || '.jsd'"), ("abs(true_tau - tau) > 3e-2", "PER_Q_TAU", "error", "key || '.kendall_tau'")]


@query("v_perq", union_sql(PERQ, "repq", 2), "", "tier", "scored", repq=REPQ)
def v_perq(s):
    return V.v_perq(reported_questions(s))


REAGG = [
    ("abs(mean_jsd - j) > 1e-2", "AGG_MEAN_JSD", "error", "'aggregate.mean_jsd'"),
    ("abs(mean_tau - t) > 1e-2", "AGG_MEAN_TAU", "error", "'aggregate.mean_kendall_tau'"),
    ("abs(composite_parity - ((1e0 - j) + (1e0 + t) / 2e0) / 2e0) > 1e-2 AND abs(composite_parity - ((1e0 - j) + (1e0 + t) / 2e0 + 1e0 - r) / 3e0) > 1e-2", "AGG_COMPOSITE", "error", "'aggregate.composite_parity'"),
    ("abs(p_dist - (1e0 - j)) > 1e-2", "SCORES_SUB", "error", "'scores.p_dist'"),
    ("abs(p_rank - (1e0 + t) / 2e0) > 1e-2", "SCORES_SUB", "error", "'scores.p_rank'"),
]
REAGG_SQL = "SELECT * FROM rep JOIN (SELECT run_id, avg(jsd) AS j, avg(tau) AS t, avg(abs(model_refusal_rate - human_refusal_rate)) AS r FROM scored GROUP BY run_id) USING (run_id)"


@query("v_reagg", union_sql(REAGG, "ra", 2), "", "tier", "runscore models scored", rep=REP, ra=REAGG_SQL)
def v_reagg(s):
    return V.v_reagg(reported(s), s.scored)


def raw_rows(s):
    """Preserved raw answers: the first valid sample of a cell, blank for one model."""
    return s.samples.where("raw_option IS NOT NULL").select(
        "run_id", "key", F.when(F.col("model") == "m6", " ").otherwise(F.col("raw_text")).alias("raw_text"),
        F.col("raw_option").alias("selected_option"),
    )


RAW_SQL = {
    "firsts": """SELECT b.run_id, b.key, min(b.model) AS model, arg_min(b.selected_option, (sample_no, raw_text, b.selected_option)) AS opt FROM base b JOIN qopt o ON o.key = b.key AND o.option = b.selected_option
        WHERE NOT refusal AND raw_text <> '' GROUP BY b.run_id, b.key""",
    "rawj": """SELECT f.*, l.p_model AS own, t.top, c.answered + c.refused AS n FROM firsts f JOIN long l ON l.run_id = f.run_id AND l.key = f.key AND l.option = f.opt
        JOIN (SELECT run_id, key, max(p_model) AS top FROM long GROUP BY ALL) t ON t.run_id = f.run_id AND t.key = f.key JOIN cells c ON c.run_id = f.run_id AND c.key = f.key""",
}


@query("v_raw", """SELECT run_id, code, count(*) AS n FROM (
    SELECT run_id, 'RAW_RESPONSES_EMPTY' AS code FROM rawj WHERE model = 'm6' UNION ALL
    SELECT run_id, 'RAW_RESPONSES_MODE' FROM rawj WHERE model <> 'm6' AND top - own > 1e0 / sqrt(n) + 1e-6 UNION ALL
    SELECT DISTINCT run_id, 'RAW_RESPONSES_MISSING' FROM cells WHERE model = 'm7') GROUP BY ALL""", ctes="long cells base qopt", **RAW_SQL)
def v_raw(s):
    runs = s.samples.select("run_id", "model").distinct().select("run_id", (F.col("model") != "m7").alias("has_raw"))
    return V.v_raw(runs, s.samples, raw_rows(s)).groupBy("run_id", "code").agg(F.count("*").alias("n"))


@query("v_graduate", """SELECT severity, count(*) AS n FROM (SELECT CASE WHEN dataset IN ('gss', 'ntia') THEN 'error' ELSE 'warning' END AS severity FROM rawj JOIN cells USING (run_id, key) WHERE rawj.model <> 'm6' AND top - own > 1e0 / sqrt(n) + 1e-6
    UNION ALL SELECT 'warning' FROM rawj WHERE model = 'm6') GROUP BY severity""", ctes="long cells base qopt", **RAW_SQL)
def v_graduate(s):
    # a run without cells has no findings, so the runs are read from the cells
    runs = s.samples.select("run_id", "dataset").distinct().select(
        "run_id", F.lit(True).alias("has_raw"), F.when(F.col("dataset").isin("gss", "ntia"), 2).alias("schema_version")
    )
    return V.v_graduate(V.v_raw(runs, s.samples, raw_rows(s)), runs).groupBy("severity").agg(F.count("*").alias("n"))


# raw documents of several shapes, one per part
DOC_SQL = """SELECT key AS run_id, CASE dataset WHEN 'opinionsqa' THEN '[1, 2]' WHEN 'gss' THEN '{"benchmark": "other", "version": "1", "config": {"dataset": "' || p_name || '"}, "aggregate": [], "per_question": [{"key": "a", "jsd": null}, 5]}'
    WHEN 'subpop' THEN '{"benchmark": "survey", "config": null, "aggregate": {"mean_jsd": 0.5}, "per_question": {}}' WHEN 'ntia' THEN 'not json ' || p_name
    ELSE '{"benchmark": "survey", "version": "1", "config": {"dataset": "d", "provider": "' || p_name || '"}, "aggregate": {"mean_jsd": 0.1, "mean_kendall_tau": 0, "composite_parity": 0.5, "n_questions": 0}, "per_question": []}' END AS raw FROM parts"""
CHECKS = ", ".join(f"('{k}', NULL)" for k in V.TOP_KEYS) + ", " + ", ".join(
    f"('{b}.{k}', '{b}')" for b, ks in (("config", V.CONFIG_KEYS), ("aggregate", V.AGGREGATE_KEYS)) for k in ks
)
SCHEMA_SQL = f"""
    SELECT run_id, 'SCHEMA_ROOT' AS code, '' AS path FROM docs WHERE NOT coalesce(json_type(j) = 'OBJECT', false)
    UNION ALL SELECT run_id, 'SCHEMA_BENCHMARK', 'benchmark' FROM docs WHERE json_type(j) = 'OBJECT' AND (j ->> '$.benchmark') IS DISTINCT FROM 'survey'
    UNION ALL SELECT run_id, 'SCHEMA_MISSING', path FROM docs, (VALUES {CHECKS}) v(path, block) WHERE json_type(j) = 'OBJECT' AND NOT json_exists(j, '$.' || path) AND (block IS NULL OR json_type(j, '$.' || block) = 'OBJECT')
    UNION ALL SELECT run_id, 'SCHEMA_TYPE', path FROM docs, (VALUES ('config'), ('aggregate')) v(path) WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.' || path) NOT IN ('OBJECT', 'NULL')
    UNION ALL SELECT run_id, 'SCHEMA_TYPE', 'per_question' FROM docs WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.per_question') NOT IN ('ARRAY', 'NULL')
    UNION ALL SELECT run_id, 'SCHEMA_TYPE', 'per_question[' || i || ']' FROM pqs WHERE json_type(e) <> 'OBJECT'
    UNION ALL SELECT run_id, 'SCHEMA_MISSING', 'per_question[' || i || '].' || k FROM pqs, (VALUES {', '.join(f"('{k}')" for k in V.QUESTION_KEYS)}) v(k) WHERE json_type(e) = 'OBJECT' AND NOT json_exists(e, '$.' || k)"""


def documents(s):
    """Raw run documents built from the part rows."""
    name = F.col("p_name")
    gss = F.concat(F.lit('{"benchmark": "other", "version": "1", "config": {"dataset": "'), name, F.lit('"}, "aggregate": [], "per_question": [{"key": "a", "jsd": null}, 5]}'))
    good = F.concat(
        F.lit('{"benchmark": "survey", "version": "1", "config": {"dataset": "d", "provider": "'), name,
        F.lit('"}, "aggregate": {"mean_jsd": 0.1, "mean_kendall_tau": 0, "composite_parity": 0.5, "n_questions": 0}, "per_question": []}'),
    )
    raw = (
        F.when(F.col("dataset") == "opinionsqa", "[1, 2]").when(F.col("dataset") == "gss", gss)
        .when(F.col("dataset") == "subpop", '{"benchmark": "survey", "config": null, "aggregate": {"mean_jsd": 0.5}, "per_question": {}}')
        .when(F.col("dataset") == "ntia", F.concat(F.lit("not json "), name)).otherwise(good)
    )
    return s.part.select(F.col("key").alias("run_id"), raw.alias("raw"))


@query("v_schema", SCHEMA_SQL, ctes="parts", rawdocs=DOC_SQL, docs="SELECT run_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM rawdocs",
       pqs="SELECT run_id, i - 1 AS i, json_extract(j, '$.per_question[' || (i - 1) || ']') AS e FROM (SELECT run_id, j, unnest(range(1, CAST(json_array_length(j, '$.per_question') AS BIGINT) + 1)) AS i FROM docs WHERE json_type(j, '$.per_question') = 'ARRAY')")
def v_schema(s):
    return V.v_schema(documents(s), "survey").select("run_id", "code", "path")


REPRO_SQL = """SELECT key AS run_id, CASE dataset WHEN 'opinionsqa' THEN NULL WHEN 'gss' THEN '"text"' WHEN 'subpop' THEN '{"seed": "x", "model_revision_hash": "", "framework_version": 3}'
    ELSE '{"seed": null, "model_revision_hash": "' || p_name || '", "prompt_template_hash": "b", "framework_version": "1", "submitted_at": " "}' END AS r FROM parts"""


@query("v_repro", f"""
    SELECT run_id, 'REPRO_MISSING' AS code, 'reproducibility' AS path FROM rr WHERE r IS NULL UNION ALL SELECT run_id, 'REPRO_TYPE', 'reproducibility' FROM rr WHERE json_type(r) <> 'OBJECT'
    UNION ALL SELECT run_id, 'REPRO_FIELD_MISSING', 'reproducibility.' || k FROM rr, (VALUES {', '.join(f"('{k}')" for k in V.REPRO_KEYS)}) v(k) WHERE json_type(r) = 'OBJECT' AND NOT json_exists(r, '$.' || k)
    UNION ALL SELECT run_id, 'REPRO_FIELD_TYPE', 'reproducibility.seed' FROM rr WHERE json_type(r) = 'OBJECT' AND json_type(r, '$.seed') = 'VARCHAR'
    UNION ALL SELECT run_id, 'REPRO_FIELD_EMPTY', 'reproducibility.' || k FROM rr, (VALUES {', '.join(f"('{k}')" for k in V.REPRO_KEYS[1:])}) v(k) WHERE json_type(r) = 'OBJECT' AND json_exists(r, '$.' || k) AND (json_type(r, '$.' || k) <> 'VARCHAR' OR trim(r ->> ('$.' || k)) = '')""",
       ctes="parts", rr0=REPRO_SQL, rr="SELECT run_id, r::JSON AS r FROM rr0")
def v_repro(s):
    name = F.col("p_name")
    text = (
        F.when(F.col("dataset") == "opinionsqa", None).when(F.col("dataset") == "gss", '"text"')
        .when(F.col("dataset") == "subpop", '{"seed": "x", "model_revision_hash": "", "framework_version": 3}')
        .otherwise(F.concat(F.lit('{"seed": null, "model_revision_hash": "'), name, F.lit('", "prompt_template_hash": "b", "framework_version": "1", "submitted_at": " "}')))
    )
    d = s.part.select(F.col("key").alias("run_id"), F.try_parse_json(text).alias("reproducibility"))
    return V.v_repro(d).select("run_id", "code", "path")


# copies of the human side, exact and disturbed, as extra submissions
ANOM = {
    "an": f"""SELECT run_id, dataset, count(*) AS n, avg(j) AS m, stddev_samp(j) AS s, count(*) FILTER (NOT p) AS np, avg(j) FILTER (NOT p) AS mp, stddev_samp(j) FILTER (NOT p) AS sp, count(*) FILTER (t >= 1e0 - 1e-4) AS perfect FROM (
        SELECT run_id, dataset, CASE model WHEN 'm1' THEN 0.001e0 WHEN 'm2' THEN CASE WHEN p THEN jsd ELSE 0.01e0 END ELSE jsd END AS j, CASE model WHEN 'm3' THEN 1e0 ELSE tau END AS t, p FROM (SELECT *, {private('dataset', 'key')} AS p FROM scored)) GROUP BY run_id, dataset""",
}
ANOM_RULES = [
    ("n >= 5 AND (m < 0.005e0 OR s < 0.005e0) AND n >= 25", "ANOMALY_PERFECTION", "error", "'per_question'"),
    ("n >= 5 AND (m < 0.005e0 OR s < 0.005e0) AND n < 25", "ANOMALY_PERFECTION", "warning", "'per_question'"),
    ("dataset <> 'pilot (2024)' AND np >= 50 AND mp < 0.02e0 AND sp < 0.03e0", "ANOMALY_NEAR_COPY_PUBLIC", "error", "'per_question'"),
    ("n >= 25 AND perfect >= n * 0.95e0", "ANOMALY_CONSTANT_OFFSET", "error", "'per_question'"),
]


def suspicious(s):
    m, p = F.col("model"), F.col("is_private")
    j = F.when(m == "m1", 0.001).when((m == "m2") & ~p, 0.01).otherwise(F.col("jsd"))
    return s.public.withColumn("jsd", j).withColumn("tau", F.when(m == "m3", 1.0).otherwise(F.col("tau")))


def _anomaly(name: str, code: str):
    rules = [r for r in ANOM_RULES if r[1] == code]

    @query(name, union_sql(rules, "an", 3), "", "tier", "scored", **ANOM)
    def run(s):
        return V.anomalies(suspicious(s)).where(F.col("code") == code)


_anomaly("a_perfection", "ANOMALY_PERFECTION")
_anomaly("a_near_copy", "ANOMALY_NEAR_COPY_PUBLIC")
_anomaly("a_constant_offset", "ANOMALY_CONSTANT_OFFSET")


@query("a_no_refusal", """SELECT run_id, 3 AS tier, 'ANOMALY_NO_REFUSAL' AS code, 'warning' AS severity, 'per_question' AS path FROM (SELECT run_id, count(*) FILTER (human_refusal_rate >= 0.05e0) AS n, max(CASE WHEN model = 'm7' THEN 0e0 ELSE model_refusal_rate END) AS m FROM scored GROUP BY run_id) WHERE n >= 3 AND m <= 0""", "", "tier", "scored")
def a_no_refusal(s):
    rate = F.when(F.col("model") == "m7", 0.0).otherwise(F.col("model_refusal_rate"))
    return V.a_no_refusal(s.scored.withColumn("model_refusal_rate", rate))


PEER = """SELECT a.run_id, avg(a.jsd - b.peer) AS mean_delta, count(*) AS n_shared FROM fam a JOIN (SELECT x.run_id, x.key, avg(y.jsd) AS peer FROM fam x JOIN fam y ON x.dataset = y.dataset AND x.tail = y.tail AND x.key = y.key AND x.run_id <> y.run_id GROUP BY ALL) b
    ON a.run_id = b.run_id AND a.key = b.key GROUP BY a.run_id"""
FAM = "SELECT s.*, CASE WHEN s.model IN ('m1', 'm2', 'm3') THEN 'shared-tail' ELSE lower(regexp_extract(c.provider, '([^/]*)$', 1)) END AS tail FROM scored s JOIN models c USING (model) WHERE NOT contains(c.provider, 'baseline') AND NOT starts_with(c.provider, 'ensemble/')"


def families(s):
    names = F.when(F.col("model").isin("m1", "m2", "m3"), "x/Shared-Tail").otherwise(F.col("provider"))
    return s.base.select("run_id", "model").distinct().join(s.models, "model").select("run_id", names.alias("provider"))


@query("j_peers", PEER, "mean_delta", ctes="scored models", fam=FAM)
def j_peers(s):
    return V.peer_deltas(s.scored, families(s))


@query("a_peer_outlier", f"""SELECT run_id, 3 AS tier, 'ANOMALY_PEER_OUTLIER' AS code, 'warning' AS severity, 'per_question' AS path FROM ({PEER}) WHERE n_shared >= 5 AND abs(mean_delta) >= 0.15e0""", "", "tier", "scored models",
       fam=FAM.replace("SELECT s.*", "SELECT s.* REPLACE (CASE WHEN s.model = 'm3' THEN jsd + 0.4e0 ELSE jsd END AS jsd)"))
def a_peer_outlier(s):
    d = s.scored.withColumn("jsd", F.when(F.col("model") == "m3", F.col("jsd") + 0.4).otherwise(F.col("jsd")))
    return V.a_peer_outlier(d, families(s))


@query("run_validity", """SELECT run_id, n_questions, n_uniform, n_uniform / n_questions AS uniform_fraction, refusal_rate, n_questions >= 10 AND n_uniform / n_questions >= 0.8e0 AND refusal_rate <= 0.05e0 AS invalid FROM (
    SELECT run_id, count(*) AS n_questions, count(*) FILTER (dev < 0.01e0) AS n_uniform, avg(rr) AS refusal_rate FROM (SELECT l.run_id, l.key, max(abs(CASE WHEN l.model = 'm5' THEN 1e0 / l.k ELSE p_model END - 1e0 / l.k)) AS dev,
    min(CASE WHEN l.model = 'm5' THEN 0.01e0 ELSE s.model_refusal_rate END) AS rr FROM long l JOIN scored s USING (run_id, key) GROUP BY l.run_id, l.key) GROUP BY run_id)""", "uniform_fraction refusal_rate", ctes="long scored")
def run_validity(s):
    m5 = F.col("model") == "m5"
    flat = F.transform("p_model", lambda x: F.lit(1.0) / F.size("p_model"))
    d = s.scored.withColumn("p_model", F.when(m5, flat).otherwise(F.col("p_model")))
    d = d.withColumn("model_refusal_rate", F.when(m5, 0.01).otherwise(F.col("model_refusal_rate")))
    return V.run_validity(d)


@query("integrity", """SELECT NULL::VARCHAR AS run_id, 'ENTRY_WITHOUT_CONFIG' AS code FROM parts WHERE p_size > 45 UNION ALL
    SELECT DISTINCT key, 'ENTRY_NOT_IN_INDEX' FROM parts WHERE p_size <= 45 AND key NOT IN (SELECT key FROM texts) UNION ALL
    SELECT key, 'ROLLUP_MISSING' FROM texts JOIN parts USING (key) WHERE p_size < 10 UNION ALL
    SELECT NULL, 'N_CONFIGS' FROM (SELECT count(*) AS n FROM texts) WHERE n <> (SELECT count(*) FROM parts) + 1""", ctes="parts texts")
def integrity(s):
    entries = s.part.select(F.when(F.col("p_size") <= 45, F.col("key")).alias("config_id"))
    index = s.texts.select(F.col("key").alias("config_id")).join(s.part.select(F.col("key").alias("config_id"), "p_size"), "config_id", "left")
    index = index.select("config_id", F.when(F.col("p_size").isNotNull(), "full").alias("tier"))
    rollups = s.part.where("p_size >= 10").select(F.col("key").alias("config_id"))
    declared = s.part.agg((F.count("*") + 1).alias("n_configs"))
    return V.integrity(entries, index, rollups, declared)


BACK = {
    "bk": """SELECT s.run_id, s.key, s.jsd, s.tau, s.parity, CASE WHEN n_samples = 1 THEN jsd + 0.1e0 WHEN n_samples = 2 THEN jsd + 0.01e0 ELSE jsd END AS sj FROM scored s""",
}


@query("normalise_backfill", """SELECT run_id, count(*) AS n, count(*) FILTER (abs(sj - round(jsd, 6)) > 3e-2) AS jsd_updated, count(*) FILTER (n_samples = 3) AS dist_normalised FROM (SELECT bk.*, s.n_samples FROM bk JOIN scored s USING (run_id, key)) GROUP BY run_id""", ctes="scored", **BACK)
def normalise_backfill(s):
    from ..operators.rollups import backfill

    n = F.col("n_samples")
    d = s.scored.withColumn("jsd", F.when(n == 1, F.col("jsd") + 0.1).when(n == 2, F.col("jsd") + 0.01).otherwise(F.col("jsd")))
    d = d.withColumn("p_model", F.when(n == 3, F.transform("p_model", lambda x: x * 2.0)).otherwise(F.col("p_model")))
    return backfill(d).groupBy("run_id").agg(
        F.count("*").alias("n"), F.sum("jsd_updated").alias("jsd_updated"), F.sum("dist_normalised").alias("dist_normalised")
    )


@query("validate", f"""SELECT run_id, tier, code, severity, count(*) AS n FROM (SELECT * FROM t1 UNION ALL SELECT * FROM ({union_sql(PERQ, 'repq', 2)}) WHERE run_id NOT IN (SELECT run_id FROM t1 WHERE severity = 'error')
    UNION ALL SELECT * FROM ({union_sql(REAGG, 'ra', 2)}) WHERE run_id NOT IN (SELECT run_id FROM t1 WHERE severity = 'error')) GROUP BY ALL""", "", "tier", "runscore models scored", rep=REP, repq=REPQ, ra=REAGG_SQL.replace("FROM scored", "FROM repq"),
       hs=HOLD["hs"].replace("FROM hq", "FROM (SELECT *, " + private("dataset", "key") + " AS p FROM repq)"),
       t1=union_sql(BOUNDS, "rep", 1) + " UNION ALL SELECT run_id, 1, 'COUNT_MISMATCH', 'error', 'x' FROM rep JOIN (SELECT run_id, count(*) AS n FROM scored GROUP BY run_id) USING (run_id) WHERE n_questions <> n UNION ALL "
          + union_sql(HOLD_RULES, "(SELECT * FROM hs WHERE a + b >= 25 AND dataset <> 'pilot (2024)')", 1))
def validate(s):
    issues = V.validate(reported(s), reported_questions(s))
    return issues.groupBy("run_id", "tier", "code", "severity").agg(F.count("*").alias("n"))
