"""Scalar functions, distribution metrics and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import provider as P
from ..functions import tables as T
from ..functions import text as X
from ..operators import scoring as S
from .oracle import YEAR_OF_SURVEY, jsd_of, private, tau_cte
from .registry import query

LONG = "run_id, key, option"


def melt(df, *cols, arrays):
    """Aligned arrays back to option rows."""
    zipped = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
    return df.select(*cols, F.explode(zipped).alias("_z")).select(
        *cols, *[F.col(f"_z.{a}").alias(a) for a in arrays]
    )


@query("clamp_dist", """
    SELECT key, option, greatest(w, 0e0) / sum(greatest(w, 0e0)) OVER (PARTITION BY key) AS p
    FROM (SELECT key, option, CAST(n - 5 AS DOUBLE) AS w FROM qopt)
    QUALIFY sum(greatest(w, 0e0)) OVER (PARTITION BY key) > 0""", "p", ctes="qopt")
def clamp_dist(s):
    w = F.transform("counts", lambda c: (c - 5).cast("double"))
    d = s.questions.withColumn("p", D.shares(w)).where("p IS NOT NULL")
    return melt(d.withColumn("option", F.col("options")), "key", arrays=["option", "p"])


@query("renorm_model", "SELECT run_id, key, option, p_model FROM long", "p_model", ctes="long")
def renorm_model(s):
    d = s.distributions.withColumn("p_model", D.shares_or_uniform(F.col("p_raw")))
    return melt(d.withColumn("option", F.col("options")), "run_id", "key", arrays=["option", "p_model"])


@query("jsd", "SELECT run_id, key, jsd FROM scored", "jsd", ctes="scored")
def jsd(s):
    d = s.distributions.withColumn("p_model", D.shares_or_uniform(F.col("p_raw")))
    return d.select("run_id", "key", D.jsd(F.col("p_human"), F.col("p_model")).alias("jsd"))


@query("tau_b", "SELECT run_id, key, tau FROM scored", "tau", ctes="scored")
def tau_b(s):
    d = s.distributions.withColumn("p_model", D.shares_or_uniform(F.col("p_raw")))
    return d.select("run_id", "key", D.tau_b(F.col("p_human"), F.col("p_model")).alias("tau"))


@query("parity_pair", f"""SELECT run_id, key, parity,
    0.8e0 * (1e0 - jsd) + 0.2e0 * ((tau + 1e0) / 2e0) AS parity_82 FROM scored""", "parity parity_82", ctes="scored")
def parity_pair(s):
    return s.scored.select("run_id", "key", "parity", D.parity(F.col("jsd"), F.col("tau"), 0.8, 0.2).alias("parity_82"))


@query("human_refusal", "SELECT DISTINCT key, human_refusal_rate FROM scored", "human_refusal_rate", ctes="scored")
def human_refusal(s):
    return s.questions.select("key", S.human_refusal(F.col("options"), F.col("p_human")).alias("human_refusal_rate"))


@query("refusal_exact", """SELECT key, sum(CASE WHEN option = 'Refused' THEN p_human ELSE 0e0 END) AS rate
    FROM qopt GROUP BY key""", "rate", ctes="qopt")
def refusal_exact(s):
    return s.questions.select("key", D.value_of(F.col("options"), F.col("p_human"), T.REFUSED).alias("rate"))


@query("p_refuse_q", """SELECT run_id, key, CASE WHEN count(*) FILTER (option = 'Refused') > 0 THEN 1e0 - abs(
    sum(CASE WHEN option = 'Refused' THEN p_human - p_model ELSE 0e0 END)) END AS p_refuse
    FROM long GROUP BY run_id, key""", "p_refuse", ctes="long")
def p_refuse_q(s):
    d = s.distributions.withColumn("p_model", D.shares_or_uniform(F.col("p_raw")))
    return d.select(
        "run_id", "key", S.p_refuse_question(F.col("options"), F.col("p_human"), F.col("p_model")).alias("p_refuse")
    )


REFUSAL_SQL = r"(?i)\b(I cannot|I can''t|I don''t|As an AI|I''m not able to|I am not able to)\b"


@query("refusal_text", f"""SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '{REFUSAL_SQL}')) AS refusals,
    CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role""")
def refusal_text(s):
    return (
        s.table("conversations").groupBy("role")
        .agg(
            F.count("*").alias("n"),
            F.count_if(X.is_refusal_text(F.col("text"))).alias("refusals"),
            F.sum(F.length("text")).alias("chars"),
        )
    )


@query("topic", "SELECT topic, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM topics GROUP BY topic", ctes="topics")
def topic(s):
    d = s.texts.select(X.topic(F.col("text")).alias("topic"), F.length("text").alias("c"))
    return d.groupBy("topic").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query("wave_year", f"SELECT key, survey, {YEAR_OF_SURVEY} AS year FROM parts", ints="year", ctes="parts")
def wave_year(s):
    return s.part.select("key", "survey", X.wave_year(F.col("survey")).alias("year"))


@query("stem", r"SELECT key, upper(regexp_extract(key, '^(.*)_W', 1)) AS stem FROM (SELECT DISTINCT lower(key) || '_W' || 'x_W1' AS key FROM parts)", ctes="parts")
def stem(s):
    d = s.part.select(F.concat(F.lower("key"), F.lit("_Wx_W1")).alias("key"))
    return d.distinct().select("key", X.stem(F.col("key")).alias("stem"))


@query("canonical_model", """SELECT model, CASE WHEN regexp_matches(model, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$')
    THEN regexp_replace(model, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', '') ELSE regexp_replace(model, '-[0-9]{8}$', '') END AS canonical
    FROM (SELECT DISTINCT replace(p_name, ' ', '-') || CASE WHEN dataset = 'gss' THEN '-2024-07-18' WHEN dataset = 'ntia' THEN '-20251001'
    WHEN dataset = 'subpop' THEN '-20251001-2024-07-18' ELSE '' END AS model FROM parts)""", ctes="parts")
def canonical_model(s):
    suffix = (
        F.when(F.col("dataset") == "gss", "-2024-07-18").when(F.col("dataset") == "ntia", "-20251001")
        .when(F.col("dataset") == "subpop", "-20251001-2024-07-18").otherwise("")
    )
    d = s.part.select(F.concat(F.regexp_replace("p_name", " ", "-"), suffix).alias("model")).distinct()
    return d.select("model", P.canonical_model(F.col("model")).alias("canonical"))


# provider strings of every path shape, derived from the part rows
PROVIDER_SQL = """SELECT key, dataset, CASE dataset
    WHEN 'opinionsqa' THEN 'raw-gemini/' || nm || '-20251001'
    WHEN 'gss' THEN 'openrouter/meta-llama/' || nm
    WHEN 'subpop' THEN 'openrouter/gpt-' || nm
    WHEN 'globalopinionqa' THEN 'panel/claude-' || nm || '-2024-07-18'
    WHEN 'ntia' THEN 'panel/openrouter/' || lower(p_brand) || '/' || nm
    ELSE nm || '-baseline' END || CASE WHEN p_size < 20 THEN ' t=0.' || p_size || ' tpl=v' || p_size WHEN p_size < 30 THEN ' profile=a junk' ELSE '' END AS provider,
    CASE WHEN p_size > 40 THEN 0.5e0 END AS temperature, CASE WHEN p_size > 45 THEN 'prompts/long.md' END AS template,
    CASE WHEN p_size > 10 THEN p_size END AS samples_per_question
    FROM (SELECT *, replace(p_name, ' ', '-') AS nm FROM parts)"""
PARSED_SQL = """SELECT *, CASE WHEN n = 1 AND ends_with(path, '-baseline') THEN 'baseline' WHEN n = 1 OR starts_with(path, 'raw-') OR parts[1] = 'openrouter' THEN 'raw' ELSE parts[1] END AS framework,
    CASE base WHEN 'gemini' THEN 'google' WHEN 'meta-llama' THEN 'meta' ELSE base END AS base_provider, parts[-1] AS model FROM (
    SELECT *, CASE WHEN n = 1 THEN NULL WHEN starts_with(path, 'raw-') THEN substr(parts[1], 5)
      WHEN n = 2 THEN CASE WHEN starts_with(parts[2], 'claude-') THEN 'anthropic' WHEN starts_with(parts[2], 'gemini-') THEN 'google' WHEN starts_with(parts[2], 'gpt-') THEN 'openai' WHEN starts_with(parts[2], 'llama-') THEN 'meta' END
      ELSE parts[-2] END AS base FROM (
    SELECT *, string_split(path, '/') AS parts, len(string_split(path, '/')) AS n,
      nullif(regexp_extract(provider, ' t=([^ ]*)', 1), '') AS kt, nullif(regexp_extract(provider, ' tpl=([^ ]*)', 1), '') AS ktpl,
      nullif(regexp_extract(provider, ' profile=([^ ]*)', 1), '') AS kprofile
    FROM (SELECT *, split_part(provider, ' ', 1) AS path FROM providers)))"""


def providers(s):
    nm = F.regexp_replace("p_name", " ", "-")
    size = F.col("p_size")
    head = (
        F.when(F.col("dataset") == "opinionsqa", F.concat(F.lit("raw-gemini/"), nm, F.lit("-20251001")))
        .when(F.col("dataset") == "gss", F.concat(F.lit("openrouter/meta-llama/"), nm))
        .when(F.col("dataset") == "subpop", F.concat(F.lit("openrouter/gpt-"), nm))
        .when(F.col("dataset") == "globalopinionqa", F.concat(F.lit("panel/claude-"), nm, F.lit("-2024-07-18")))
        .when(F.col("dataset") == "ntia", F.concat(F.lit("panel/openrouter/"), F.lower("p_brand"), F.lit("/"), nm))
        .otherwise(F.concat(nm, F.lit("-baseline")))
    )
    tail = (
        F.when(size < 20, F.concat(F.lit(" t=0."), size, F.lit(" tpl=v"), size))
        .when(size < 30, " profile=a junk").otherwise("")
    )
    return s.part.select(
        "key", "dataset", F.concat(head, tail).alias("provider"),
        F.when(size > 40, 0.5).alias("temperature"),
        F.when(size > 45, "prompts/long.md").alias("template"),
        F.when(size > 10, size).alias("samples_per_question"),
        F.lit(None).cast("string").alias("question_set_hash"),
    )


@query("parse_provider", """SELECT key, provider, framework, base_provider, model, kt AS knob_t, ktpl AS knob_tpl,
    kprofile AS knob_profile FROM parsed""", ctes="parts", providers=PROVIDER_SQL, parsed=PARSED_SQL)
def parse_provider(s):
    knob = lambda k: F.try_element_at("knobs", F.lit(k)).alias(f"knob_{k}")
    return P.parse_provider(providers(s)).select(
        "key", "provider", "framework", "base_provider", "model", knob("t"), knob("tpl"), knob("profile")
    )


@query("config_id", """SELECT key, lower(framework) || '--' || m || '--t' || coalesce(t, 'default') || '--tpl' || coalesce(tpl, 'current') || '--' ||
    substr(sha256('{"base_provider":' || coalesce('"' || base_provider || '"', 'null') || ',"dataset":"' || dataset || '","framework":"' || framework || '","knobs":{' ||
      concat_ws(',', '"profile":"' || kprofile || '"', '"t":' || t, '"tpl":"' || tpl || '"') || '},"model":"' || m || '"' ||
      coalesce(',"samples_per_question":' || samples_per_question, '') || '}'), 1, 8) AS config_id
    FROM (SELECT *, CASE WHEN regexp_matches(model, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN regexp_replace(model, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', '')
      ELSE regexp_replace(model, '-[0-9]{8}$', '') END AS m, CAST(coalesce(temperature, CAST(kt AS DOUBLE)) AS VARCHAR) AS t,
      coalesce(CASE WHEN template IS NOT NULL THEN 'long' END, ktpl) AS tpl FROM parsed)""",
    ctes="parts", providers=PROVIDER_SQL, parsed=PARSED_SQL)
def config_id(s):
    return P.config_id(P.parse_provider(providers(s))).select("key", "config_id")


@query("display_name", """SELECT r.run_id, r.provider, r.display_name, r.family FROM runs r""", ctes="runs")
def display_name(s):
    runs = s.base.select("run_id", "model").distinct().join(s.models, "model")
    return P.with_display(runs, s.names).select("run_id", "provider", "display_name", "family")


@query("qset_hash", """SELECT run_id, sha256(string_agg(key, chr(10) ORDER BY key)) AS question_set_hash, count(*) AS n_keys
    FROM cells GROUP BY run_id""", ctes="cells")
def qset_hash(s):
    keys = s.base.select("run_id", "key").distinct()
    return S.question_set_hash(keys, ["run_id"])


@query("holdout_bucket", f"SELECT dataset, key, {private('dataset', 'key')} AS is_private FROM parts", ctes="parts")
def holdout_bucket(s):
    return s.part.select("dataset", "key", X.is_private(F.col("dataset"), F.col("key")).alias("is_private"))


@query("split_keys", f"""SELECT dataset, count(*) FILTER (NOT p) AS n_public, count(*) FILTER (p) AS n_private,
    min(key) FILTER (p) AS first_private FROM (SELECT *, {private('dataset', 'key')} AS p FROM parts) GROUP BY dataset""", ctes="parts")
def split_keys(s):
    d = s.part.withColumn("p", X.is_private(F.col("dataset"), F.col("key")))
    return d.groupBy("dataset").agg(
        F.count_if(~F.col("p")).alias("n_public"), F.count_if("p").alias("n_private"),
        F.min(F.when(F.col("p"), F.col("key"))).alias("first_private"),
    )


@query("holdout_keys", f"SELECT dataset, key FROM parts WHERE {private('dataset', 'key')}", ctes="parts")
def holdout_keys(s):
    return s.part.where(X.is_private(F.col("dataset"), F.col("key"))).select("dataset", "key")


VERDICT_TEXT = "CASE p_size % 5 WHEN 0 THEN ' Success ' WHEN 1 THEN 'I call it mixed, not failure.' WHEN 2 THEN 'a failure' WHEN 3 THEN 'unsuccessful' ELSE p_name END"


def verdict_rows(s):
    k = F.col("p_size") % 5
    raw = (
        F.when(k == 0, " Success ").when(k == 1, "I call it mixed, not failure.")
        .when(k == 2, "a failure").when(k == 3, "unsuccessful").otherwise(F.col("p_name"))
    )
    truth = F.when(F.col("p_brand") < "Brand#2", "success").when(F.col("p_brand") < "Brand#3", "mixed").otherwise("failure")
    return s.part.select("key", "dataset", raw.alias("raw"), truth.alias("truth"), X.verdict(raw).alias("verdict"))


VERDICT_SQL = f"""SELECT key, dataset, raw, truth, CASE WHEN v = '' THEN 'unparseable' ELSE lower(v) END AS verdict FROM (
    SELECT *, regexp_extract(upper(trim(raw)), '\\b(SUCCESS|MIXED|FAILURE)\\b', 1) AS v FROM (
    SELECT key, dataset, {VERDICT_TEXT} AS raw, CASE WHEN p_brand < 'Brand#2' THEN 'success' WHEN p_brand < 'Brand#3' THEN 'mixed' ELSE 'failure' END AS truth FROM parts))"""


@query("verdict", "SELECT * FROM verdicts", ctes="parts", verdicts=VERDICT_SQL)
def verdict(s):
    return verdict_rows(s)


@query("safe_key", "SELECT url, regexp_replace(url, '[^A-Za-z0-9_\\-]', '_', 'g') AS safe FROM (SELECT DISTINCT url FROM pages)")
def safe_key(s):
    return s.table("pages").select("url").distinct().select("url", X.safe_key(F.col("url")).alias("safe"))


@query("excerpt", "SELECT key, CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '…' ELSE text END AS excerpt FROM texts", ctes="texts")
def excerpt(s):
    return s.texts.select("key", X.excerpt(F.col("text")).alias("excerpt"))


@query("round_or_none", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN round(l_extendedprice / l_tax, 6) END AS x FROM lineitem""")
def round_or_none(s):
    li = s.table("lineitem")
    x = F.try_divide(F.col("l_extendedprice"), F.col("l_tax"))
    x = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(x)
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", D.clean_round(x).alias("x"))


@query("sps", "SELECT run_id, sps, (3e0 * p_dist + 1e0 * p_rank) / 4e0 AS weighted FROM runscore", "sps weighted", ctes="runscore")
def sps(s):
    r = S.run_score(s.scored, median=False)
    w = D.sps({k: F.col(k) for k in ("p_dist", "p_rank", "p_refuse")}, {"p_dist": 3.0, "p_rank": 1.0})
    return r.select("run_id", "sps", w.alias("weighted"))


@query("refusal_calibration", "SELECT run_id, p_refuse FROM runscore", "p_refuse", ctes="runscore")
def refusal_calibration(s):
    return s.scored.groupBy("run_id").agg(
        S.refusal_calibration(F.col("model_refusal_rate"), F.col("human_refusal_rate")).alias("p_refuse")
    )


@query("sample_distribution", """SELECT run_id, key, n_samples, n_parse_failures, model_refusal_rate, in_tok, out_tok, calls, raw_text FROM (
    SELECT s.*, (SELECT 1) AS one FROM scored s) LEFT JOIN (
    SELECT b.run_id, b.key, arg_min(raw_text, (sample_no, raw_text)) AS raw_text FROM base b JOIN qopt o ON o.key = b.key AND o.option = b.selected_option
    WHERE NOT refusal AND raw_text <> '' GROUP BY b.run_id, b.key) USING (run_id, key)""", "model_refusal_rate", ctes="scored")
def sample_distribution(s):
    return s.distributions.select(
        "run_id", "key", "n_samples", "n_parse_failures", "model_refusal_rate", "in_tok", "out_tok", "calls", "raw_text"
    )


@query("question_score", f"""SELECT run_id, s.dataset, s.key, jsd, tau, parity, model_refusal_rate, human_refusal_rate, n_samples, n_parse_failures,
    {YEAR_OF_SURVEY} AS temporal_year FROM scored s JOIN parts p ON p.key = s.key""", "jsd tau parity model_refusal_rate human_refusal_rate", "temporal_year", "scored parts")
def question_score(s):
    d = s.distributions.join(s.part.select("key", "survey"), "key")
    return S.question_score(d, "survey").select(
        "run_id", "dataset", "key", "jsd", "tau", "parity", "model_refusal_rate", "human_refusal_rate",
        "n_samples", "n_parse_failures", "temporal_year",
    )


@query("run_score", "SELECT run_id, dataset, n_questions, mean_jsd, median_jsd, mean_tau, p_dist, p_rank, p_refuse, composite_parity, sps FROM runscore",
       "mean_jsd median_jsd mean_tau p_dist p_rank p_refuse composite_parity sps", ctes="runscore")
def run_score(s):
    return S.run_score(s.scored).select(
        "run_id", "dataset", "n_questions", "mean_jsd", "median_jsd", "mean_tau", "p_dist", "p_rank", "p_refuse",
        "composite_parity", "sps",
    )


@query("run_score_approx")
def run_score_approx(s):
    return S.run_score(s.scored, approx=True).select("run_id", "dataset", "n_questions", "mean_jsd", "median_jsd", "mean_tau", "sps")


@query("temporal_breakdown", f"""SELECT run_id, y AS temporal_year, 1e0 - avg(jsd) AS p_dist, (1e0 + avg(tau)) / 2e0 AS p_rank, avg(jsd) AS mean_jsd, count(*) AS n_questions
    FROM (SELECT s.*, {YEAR_OF_SURVEY} AS y FROM scored s JOIN parts p ON p.key = s.key) WHERE y > 0 GROUP BY run_id, y""",
       "p_dist p_rank mean_jsd", "temporal_year", "scored parts")
def temporal_breakdown(s):
    d = s.scored.join(s.part.select("key", "survey"), "key").withColumn("temporal_year", X.wave_year(F.col("survey")))
    return S.temporal_breakdown(d)


@query("usage_rollup", """SELECT run_id, CAST(sum(in_tok) AS BIGINT) AS input_tokens, CAST(sum(out_tok) AS BIGINT) AS output_tokens, CAST(sum(calls) AS BIGINT) AS call_count,
    CASE WHEN count(*) FILTER (calls > 0) = count(*) THEN 'measured' ELSE 'partial' END AS source FROM scored GROUP BY run_id HAVING count(*) FILTER (calls > 0) > 0""", ctes="scored")
def usage_rollup(s):
    return S.usage_rollup(s.distributions)


@query("parse_failure_rate", "SELECT run_id, sum(n_parse_failures) / (sum(n_samples) + sum(n_parse_failures)) AS parse_failure_rate FROM scored GROUP BY run_id", "parse_failure_rate", ctes="scored")
def parse_failure_rate(s):
    return S.parse_failure_rate(s.distributions)


def baseline_sql(expr: str) -> dict:
    return {
        "bl": f"SELECT *, {expr} AS p_model FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY option) AS pos FROM qopt)",
        "bt": tau_cte("bl", "key"),
        "bj": f"SELECT key, min(dataset) AS dataset, {jsd_of('p_human', 'p_model')} AS jsd FROM bl GROUP BY key",
    }


def _baseline(name: str, expr: str):
    @query(f"baseline_{name}", f"""SELECT dataset, count(*) AS n, avg(jsd) AS mean_jsd, avg(coalesce(tau, 0e0)) AS mean_tau
        FROM bj LEFT JOIN bt USING (key) GROUP BY dataset""", "mean_jsd mean_tau", ctes="qopt", **baseline_sql(expr))
    def run(s):
        d = S.baselines(s.questions).where(F.col("baseline") == name)
        d = S.score_pairs(d.withColumn("p_model", F.col("p_raw")))
        return d.groupBy("dataset").agg(
            F.count("*").alias("n"), F.avg("jsd").alias("mean_jsd"), F.avg("tau").alias("mean_tau")
        )


_baseline("uniform", "1e0 / k")
_baseline("first", "CASE WHEN pos = 1 THEN 1e0 ELSE 0e0 END")
_baseline("mode", "CASE WHEN row_number() OVER (PARTITION BY key ORDER BY n DESC, option) = 1 THEN 1e0 ELSE 0e0 END")


@query("baseline_population", f"""SELECT g.key, g.grp AS "group", {jsd_of('p_group', 'p_pop')} AS jsd FROM (
    SELECT o.key, s.grp, o.option, o.p_human AS p_pop, coalesce(c.n, 0) / s.total AS p_group FROM qopt o
    JOIN (SELECT key, grp, count(*) AS total FROM grouped GROUP BY ALL) s ON s.key = o.key
    LEFT JOIN (SELECT key, grp, option, count(*) AS n FROM grouped GROUP BY ALL) c ON c.key = o.key AND c.grp = s.grp AND c.option = o.option) g
    GROUP BY g.key, g.grp""", "jsd", ctes="qopt grouped")
def baseline_population(s):
    groups = S.question_distributions(s.grouped, ["key", "group"]).withColumn("text", F.col("key"))
    groups = groups.select("key", "group", "text", F.map_from_arrays("options", "p_human").alias("_g"))
    population = s.questions.select(F.col("key").alias("text"), "options", "p_human")
    d = groups.join(population.select("text", "options"), "text")
    d = S.population_baseline(d, population)
    return d.select(
        "key", "group", D.jsd(D.align(F.col("options"), F.col("_g")), F.col("p_model")).alias("jsd")
    )


@query("distribution_from_responses", "SELECT key, option, p_human AS p FROM qopt", "p", ctes="qopt")
def distribution_from_responses(s):
    return melt(s.questions.withColumn("option", F.col("options")).withColumn("p", F.col("p_human")), "key", arrays=["option", "p"])
