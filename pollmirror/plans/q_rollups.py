"""Joins, leaderboards, rollups, demographics and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import provider as P
from ..functions import tables as T
from ..functions import text as X
from ..operators import demographics as G
from ..operators import ensemble as E
from ..operators import pairs as A
from ..operators import rollups as R
from ..operators import scoring as S
from ..operators.ranking import rank_within, top_per_group
from .oracle import jsd_of, parity_of, private, tau_cte
from .q_metrics import VERDICT_SQL
from .registry import query

BL = "('random-baseline', 'majority-baseline')"

# --- joins ------------------------------------------------------------------------


@query("j_equi_multi_intersect", """SELECT c.run_id, c.key FROM cells c JOIN (
    SELECT key FROM cells GROUP BY key HAVING count(DISTINCT model) = 7) k USING (key)""", ctes="cells")
def j_equi_multi_intersect(s):
    cells = s.base.select("run_id", "key", "model").distinct()
    return E.shared_by_all(cells, ["key"], "model", 7).select("run_id", "key")


def pair_sql(group: str) -> str:
    return f"""SELECT {group}, a.model AS model_a, b.model AS model_b, a.key, {jsd_of('a.p_model', 'b.p_model')} AS jsd
        FROM long a JOIN long b ON a.key = b.key AND a.option = b.option AND a.model < b.model GROUP BY ALL"""


def model_maps(s):
    return s.shares.select("dataset", "key", "model", "run_id", F.map_from_arrays("options", "p_model").alias("dist"))


@query("j_pairwise_shared", """SELECT dataset, model_a, model_b, avg(jsd) AS mean_jsd, count(*) AS n_shared FROM pairs GROUP BY ALL""",
       "mean_jsd", ctes="long", pairs=pair_sql("a.dataset"))
def j_pairwise_shared(s):
    return A.pair_jsd(model_maps(s), ["dataset", "key"], "model").groupBy("dataset", "model_a", "model_b").agg(
        F.avg("jsd").alias("mean_jsd"), F.count("*").alias("n_shared")
    )


WAVE_LONG = {
    "wst": r"SELECT DISTINCT key, survey, upper(regexp_extract(key, '^(.*)_W', 1)) AS stem FROM wopt",
    "wpair": f"""SELECT a.stem, a.key AS key_a, b.key AS key_b, a.survey AS survey_a, b.survey AS survey_b FROM wst a JOIN wst b ON a.stem = b.stem AND a.key < b.key""",
    "wj": f"""SELECT stem, key_a, key_b, min(survey_a) AS survey_a, min(survey_b) AS survey_b, {jsd_of('pa', 'pb')} AS jsd FROM (
        SELECT p.*, o.option, coalesce(x.p_human, 0e0) AS pa, coalesce(y.p_human, 0e0) AS pb FROM wpair p
        JOIN (SELECT DISTINCT stem, option FROM wopt JOIN wst USING (key)) o ON o.stem = p.stem
        LEFT JOIN wopt x ON x.key = p.key_a AND x.option = o.option LEFT JOIN wopt y ON y.key = p.key_b AND y.option = o.option)
        GROUP BY stem, key_a, key_b""",
}


@query("j_wave_pairs", "SELECT stem, key_a, key_b, jsd FROM wj", "jsd", ctes="wopt", **WAVE_LONG)
def j_wave_pairs(s):
    d = s.waves.select(X.stem(F.col("key")).alias("stem"), "key", F.map_from_arrays("options", "p_human").alias("dist"))
    return A.pair_jsd(d, ["stem"], "key").select("stem", "key_a", "key_b", "jsd")


@query("j_full_outer_options", """SELECT coalesce(a.key, b.key) AS key, coalesce(a.option, b.option) AS option, coalesce(a.p_human, 0e0) AS p, coalesce(b.c, 0) AS n_model
    FROM qopt a FULL JOIN (SELECT key, option, CAST(sum(c) AS BIGINT) AS c FROM mopt GROUP BY ALL) b ON a.key = b.key AND a.option = b.option""", "p", ctes="qopt mopt")
def j_full_outer_options(s):
    human = s.questions.select("key", F.explode(F.arrays_zip("options", "p_human")).alias("z")).select(
        "key", F.col("z.options").alias("option"), F.col("z.p_human").alias("p")
    )
    model = s.base.where("NOT refusal").groupBy("key", F.col("selected_option").alias("option")).agg(
        F.count("*").alias("n_model")
    )
    return human.join(model, ["key", "option"], "full_outer").fillna(0, ["p", "n_model"])


@query("j_suite_filter", "SELECT b.item_id AS ord, q.dataset, q.key, CAST(sum(q.n) AS BIGINT) AS n FROM benchmark b JOIN qopt q ON q.key = 'P' || b.item_id GROUP BY ALL", ctes="qopt")
def j_suite_filter(s):
    suite = s.table("benchmark").select(F.concat(F.lit("P"), "item_id").alias("key"), F.col("item_id").alias("ord"))
    return s.questions.join(suite, "key").select("ord", "dataset", "key", "n").orderBy("ord")


@query("j_left_pricing", "SELECT run_id, provider, in_price, out_price FROM runs LEFT JOIN prices ON path = split_part(provider, ' ', 1)", "in_price out_price", ctes="runs prices")
def j_left_pricing(s):
    return priced(s).select("run_id", "provider", "in_price", "out_price")


def prices(s):
    from .bridge import PRICES

    return s.small(PRICES, "path string, in_price double, out_price double")


def priced(s):
    return R.cost_fields(s.runs.withColumn("price_path", F.substring_index("provider", " ", 1)), prices(s))


COST_SQL = {
    "costs": """SELECT r.*, CASE WHEN input_tokens = 0 AND output_tokens = 0 THEN 0e0 ELSE (input_tokens * CAST(in_price AS DOUBLE) + output_tokens * CAST(out_price AS DOUBLE)) / 1e6 END AS cost_usd
        FROM runs r LEFT JOIN prices ON path = split_part(provider, ' ', 1)"""
}


@query("cost_fields", """SELECT run_id, cost_usd, cost_usd / n_questions * 100 AS cost_per_100q, CASE WHEN sps >= 0.01e0 THEN cost_usd / sps END AS cost_per_sps_point FROM costs""",
       "cost_usd cost_per_100q cost_per_sps_point", ctes="runs prices", **COST_SQL)
def cost_fields(s):
    return priced(s).select("run_id", "cost_usd", "cost_per_100q", "cost_per_sps_point")


@query("j_self_ensemble_sources", """SELECT e.run_id AS ensemble_run, CASE WHEN count(c.cost_usd) = count(*) THEN sum(c.cost_usd) END AS cost_usd, count(*) AS n_sources
    FROM runs e JOIN (SELECT * FROM (VALUES ('m1'), ('m3'), ('m7')) v(model)) x ON true LEFT JOIN costs c ON c.dataset = e.dataset AND c.model = x.model
    WHERE e.model = 'm4' GROUP BY e.run_id""", "cost_usd", ctes="runs prices", **COST_SQL)
def j_self_ensemble_sources(s):
    cost = priced(s)
    providers = s.models.where(F.col("model").isin("m1", "m3", "m7")).agg(F.collect_list("provider").alias("sources"))
    blends = s.base.where("model = 'm4'").select(F.col("run_id").alias("ensemble_run"), "dataset").distinct()
    # one row: the list of constituents
    sources = blends.crossJoin(F.broadcast(providers)).select("ensemble_run", "dataset", F.explode("sources").alias("provider"))
    return R.ensemble_cost(sources, cost.select("provider", "dataset", "cost_usd"))


def policies(s):
    return s.small([(a, b) for a, b, _ in T.POLICIES], "dataset string, tier string")


@query("j_semi_policy", "SELECT q.dataset, q.key, CAST(sum(q.n) AS BIGINT) AS n FROM qopt q WHERE split_part(dataset, ' ', 1) IN (SELECT dataset FROM policies WHERE tier IN ('full', 'gated')) GROUP BY ALL", ctes="qopt policies")
def j_semi_policy(s):
    out = policies(s).where(F.col("tier").isin("full", "gated")).withColumnRenamed("dataset", "base")
    return s.questions.join(out, X.base_dataset(F.col("dataset")) == F.col("base"), "left_semi").select("dataset", "key", "n")


@query("policy_lookup", "SELECT p.key, p.dataset, coalesce(t.tier, 'aggregates_only') AS tier FROM parts p LEFT JOIN policies t ON t.dataset = split_part(p.dataset, ' ', 1)", ctes="parts policies")
def policy_lookup(s):
    return R.with_tier(s.part.select("key", "dataset"), policies(s))


@query("j_anti_orphans", """SELECT 'no_text' AS kind, key FROM parts WHERE key NOT IN (SELECT key FROM texts) UNION ALL
    SELECT 'no_question', key FROM texts WHERE key NOT IN (SELECT key FROM parts)""", ctes="parts texts")
def j_anti_orphans(s):
    parts, texts = s.part.select("key"), s.texts.select("key")
    return parts.join(texts, "key", "left_anti").select(F.lit("no_text").alias("kind"), "key").union(
        texts.join(parts, "key", "left_anti").select(F.lit("no_question").alias("kind"), "key")
    )


MODAL_SQL = "SELECT run_id, key, arg_max(option, (p_model, -pos)) AS modal FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY option) AS pos FROM long) GROUP BY run_id, key"


@query("j_compare_runs", """SELECT a.dataset, a.key, ma.modal AS a_modal, mb.modal AS b_modal, a.jsd AS a_jsd, b.jsd AS b_jsd, a.jsd - b.jsd AS delta_jsd, ma.modal IS DISTINCT FROM mb.modal AS flip
    FROM scored a JOIN scored b ON a.key = b.key JOIN modal ma ON ma.run_id = a.run_id AND ma.key = a.key JOIN modal mb ON mb.run_id = b.run_id AND mb.key = b.key
    WHERE a.model = 'm1' AND b.model = 'm3'""", "a_jsd b_jsd delta_jsd", ctes="scored", modal=MODAL_SQL)
def j_compare_runs(s):
    a, b = s.shares.where("model = 'm1'"), s.shares.where("model = 'm3'")
    d = R.compare_runs(a, b).join(a.select("key", "dataset"), "key")
    return d.orderBy(F.desc_nulls_last(F.abs("delta_jsd")), "key")


@query("j_range_dominance", """SELECT e.run_id, EXISTS (SELECT 1 FROM costs o WHERE o.run_id <> e.run_id AND o.cost_usd IS NOT NULL AND o.sps >= e.sps AND o.cost_usd <= e.cost_usd AND (o.sps > e.sps OR o.cost_usd < e.cost_usd)
    AND o.family <> 'baseline') AS dominated FROM costs e WHERE cost_usd IS NOT NULL AND family <> 'baseline'""", ctes="runs prices", **COST_SQL)
def j_range_dominance(s):
    d = priced(s).where("cost_usd IS NOT NULL AND family <> 'baseline'").select("run_id", "cost_usd", "sps")
    return R.dominated(d).select("run_id", "dominated")


# --- leaderboards -----------------------------------------------------------------


@query("dedup_best_run", "SELECT display_name, family, dataset, run_id, n_questions FROM runs QUALIFY row_number() OVER (PARTITION BY display_name, family, dataset ORDER BY n_questions DESC, run_id) = 1", ctes="runs")
def dedup_best_run(s):
    return R.dedup_best_run(s.runs).select("display_name", "family", "dataset", "run_id", "n_questions")


TPL = "CASE WHEN template IS NOT NULL THEN regexp_replace(regexp_extract(template, '([^/]*)$', 1), '\\.[^.]*$', '') END"


def configured(s):
    return s.runs.withColumn("template", X.template_name(F.col("template")))


REPL_SQL = {
    "repl": f"""SELECT display_name, family, dataset, temperature, {TPL} AS template, avg(composite_parity) AS mean_sps, stddev_pop(composite_parity) AS std_sps,
        avg(mean_jsd) AS mean_jsd, avg(mean_tau) AS mean_tau, count(*) AS n_runs, arg_min(run_id, (-n_questions, run_id)) AS best_run FROM runs GROUP BY ALL""",
    "base_best": f"SELECT provider, dataset, max(composite_parity) AS best FROM runs WHERE provider IN {BL} GROUP BY ALL",
}


@query("replicate_agg", "SELECT * FROM repl", "temperature mean_sps std_sps mean_jsd mean_tau", ctes="runs", **REPL_SQL)
def replicate_agg(s):
    return R.replicate_agg(configured(s))


@query("count_runs", f"SELECT display_name, family, dataset, temperature, {TPL} AS template, count(*) AS n_runs FROM runs GROUP BY ALL", "temperature", ctes="runs")
def count_runs(s):
    return configured(s).groupBy(*R.CONFIG).agg(F.count("*").alias("n_runs"))


LB_SQL = f"""SELECT p.*, CASE WHEN provider NOT IN {BL} THEN composite_parity - r.best END AS vs_random, CASE WHEN provider NOT IN {BL} THEN composite_parity - m.best END AS vs_majority
    FROM %s p LEFT JOIN base_best r ON r.provider = 'random-baseline' AND r.dataset = p.dataset LEFT JOIN base_best m ON m.provider = 'majority-baseline' AND m.dataset = p.dataset"""


@query("leaderboard", f"SELECT rank, provider, dataset, composite_parity, n_runs, vs_random, vs_majority FROM ({LB_SQL.replace('%s', 'ranked').replace('SELECT p.*', 'SELECT p.*, p.provider AS pp').replace('WHEN provider', 'WHEN p.provider')})",
       "composite_parity vs_random vs_majority", ctes="runs", **REPL_SQL,
       ranked="""SELECT rank, r.provider, x.dataset, mean_sps AS composite_parity, n_runs FROM (SELECT *, row_number() OVER (ORDER BY mean_sps DESC, best_run) AS rank
            FROM (SELECT * REPLACE (round(mean_sps, 4) AS mean_sps) FROM repl)) x JOIN runs r ON r.run_id = x.best_run""")
def leaderboard(s):
    return R.leaderboard(configured(s)).select("rank", "provider", "dataset", "composite_parity", "n_runs", "vs_random", "vs_majority")


@query("leaderboard_detail", f"SELECT run_id, rank, composite_parity, vs_random, vs_majority FROM ({LB_SQL.replace('%s', 'ranked').replace('WHEN provider', 'WHEN p.provider')})",
       "composite_parity vs_random vs_majority", ctes="runs", **REPL_SQL,
       ranked="SELECT run_id, provider, dataset, composite_parity, row_number() OVER (ORDER BY composite_parity DESC, run_id) AS rank FROM runs")
def leaderboard_detail(s):
    return R.leaderboard(s.runs, detail=True).select("run_id", "rank", "composite_parity", "vs_random", "vs_majority")


@query("model_filter", "SELECT run_id, provider, sps FROM runs WHERE contains(lower(provider), 'haiku')", "sps", ctes="runs")
def model_filter(s):
    return s.runs.where(F.lower("provider").contains("HAIKU".lower())).select("run_id", "provider", "sps")


TAGGED = "SELECT *, CASE WHEN dataset IN ('gss', 'ntia') THEN 'political' WHEN dataset = 'subpop' THEN 'consumer' END AS topic FROM runs"


def tagged(s):
    tag = F.when(F.col("dataset").isin("gss", "ntia"), "political").when(F.col("dataset") == "subpop", "consumer")
    return s.runs.withColumn("topic", tag)


@query("topic_scores_tagged", "SELECT provider, topic, round(arg_max(composite_parity, (ts, run_id)), 4) AS score FROM tagged WHERE topic IS NOT NULL GROUP BY ALL", "score", ctes="runs", tagged=TAGGED)
def topic_scores_tagged(s):
    return R.topic_scores_tagged(tagged(s))


@query("topic_filter", "SELECT run_id, sps FROM tagged WHERE topic = 'political'", "sps", ctes="runs", tagged=TAGGED)
def topic_filter(s):
    return tagged(s).where("topic = 'political'").select("run_id", "sps")


@query("baseline_scores", "SELECT * FROM base_best", "best", ctes="runs", **REPL_SQL)
def baseline_scores(s):
    return R.baseline_scores(s.runs)


@query("baseline_delta", f"SELECT run_id, vs_random, vs_majority FROM ({LB_SQL.replace('%s', 'runs').replace('WHEN provider', 'WHEN p.provider')})", "vs_random vs_majority", ctes="runs", **REPL_SQL)
def baseline_delta(s):
    return R.baseline_delta(s.runs, R.baseline_scores(s.runs)).select("run_id", "vs_random", "vs_majority")


@query("sample_sweep", f"""SELECT display_name, samples_per_question, count(*) AS n_runs, max(composite_parity) AS best, avg(round(composite_parity, 4)) AS mean FROM swept
    WHERE display_name IN (SELECT display_name FROM swept GROUP BY display_name HAVING count(DISTINCT samples_per_question) >= 2) GROUP BY ALL""", "best mean", "samples_per_question", ctes="runs",
    swept=f"SELECT * REPLACE (CASE WHEN family = 'raw' THEN 'all raw' ELSE display_name END AS display_name) FROM runs WHERE provider NOT IN {BL}")
def sample_sweep(s):
    name = F.when(F.col("family") == "raw", "all raw").otherwise(F.col("display_name"))
    return R.sample_sweep(s.runs.withColumn("display_name", name))


@query("best_by_rep_count", "SELECT display_name, samples_per_question, max(sps) AS sps FROM runs GROUP BY ALL", "sps", "samples_per_question", ctes="runs")
def best_by_rep_count(s):
    return s.runs.groupBy("display_name", "samples_per_question").agg(F.max("sps").alias("sps"))


ENTRY_SQL = {
    "dedup": "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY display_name, family, dataset ORDER BY n_questions DESC, run_id) = 1",
    "split": f"""SELECT run_id, count(*) FILTER (p) AS n_private, count(*) FILTER (NOT p) AS n_public, {parity_of('avg(jsd) FILTER (NOT p)', 'avg(tau) FILTER (NOT p)')} AS sps_public,
        {parity_of('avg(jsd) FILTER (p)', 'avg(tau) FILTER (p)')} AS sps_private, min(dataset) AS dataset FROM (SELECT *, {private('dataset', 'key')} AS p FROM scored) GROUP BY run_id""",
    "entries": """SELECT d.*, row_number() OVER (PARTITION BY d.dataset ORDER BY sps DESC, d.run_id) AS rank, provider IN ('random-baseline', 'majority-baseline') AS is_baseline, contains(lower(provider), 'ensemble') AS is_ensemble FROM dedup d""",
}
ENTRY_CTES = "runs"


def entries(s):
    d = rank_within(R.dedup_best_run(s.runs), ["dataset"], "sps", ["run_id"], bounds=(0, 1))
    return d.withColumn("is_baseline", F.col("family") == "baseline").withColumn(
        "is_ensemble", F.lower("provider").contains("ensemble")
    )


@query("publish_entries", """SELECT dataset, rank, e.run_id, display_name, family, sps, p_dist, p_rank, p_refuse, mean_jsd, mean_tau, n_questions, is_baseline, is_ensemble FROM entries e""",
       "sps p_dist p_rank p_refuse mean_jsd mean_tau", ctes=ENTRY_CTES, **ENTRY_SQL)
def publish_entries(s):
    return entries(s).select(
        "dataset", "rank", "run_id", "display_name", "family", "sps", "p_dist", "p_rank", "p_refuse", "mean_jsd",
        "mean_tau", "n_questions", "is_baseline", "is_ensemble",
    )


@query("top3", "SELECT dataset, display_name, sps, row_number() OVER (PARTITION BY dataset ORDER BY sps DESC, run_id) AS place FROM entries WHERE NOT is_baseline QUALIFY place <= 3", "sps", ctes=ENTRY_CTES, **ENTRY_SQL)
def top3(s):
    d = R.dedup_best_run(s.runs).where("family <> 'baseline'")
    return top_per_group(d, ["dataset"], [F.desc("sps"), F.asc("run_id")], 3, "place").select("dataset", "display_name", "sps", "place")


@query("best_per_model", "SELECT display_name, arg_max(dataset, (sps, run_id)) AS dataset, max(sps) AS sps FROM entries WHERE NOT is_baseline GROUP BY ALL", "sps", ctes=ENTRY_CTES, **ENTRY_SQL)
def best_per_model(s):
    d = R.dedup_best_run(s.runs).where("family <> 'baseline'")
    per_dataset = top_per_group(d, ["display_name", "dataset"], [F.desc("sps"), F.asc("run_id")])
    return per_dataset.groupBy("display_name").agg(
        F.max_by("dataset", F.struct("sps", "run_id")).alias("dataset"), F.max("sps").alias("sps")
    )


@query("best_per_provider_model", "SELECT provider, display_name, max(sps) AS sps FROM entries GROUP BY ALL", "sps", ctes=ENTRY_CTES, **ENTRY_SQL)
def best_per_provider_model(s):
    return R.dedup_best_run(s.runs).groupBy("provider", "display_name").agg(F.max("sps").alias("sps"))


@query("best_per_dataset", """SELECT dataset, arg_max(display_name, (sps, run_id)) FILTER (NOT is_baseline) AS best_model, max(sps) FILTER (NOT is_baseline) AS best_sps,
    arg_min(sps, rank) FILTER (is_baseline) AS baseline_sps FROM entries GROUP BY dataset""", "best_sps baseline_sps", ctes=ENTRY_CTES, **ENTRY_SQL)
def best_per_dataset(s):
    real, base = ~F.col("is_baseline"), F.col("is_baseline")
    return entries(s).groupBy("dataset").agg(
        F.max_by("display_name", F.when(real, F.struct("sps", "run_id"))).alias("best_model"),
        F.max(F.when(real, F.col("sps"))).alias("best_sps"),
        F.min_by("sps", F.when(base, F.col("rank"))).alias("baseline_sps"),
    )


@query("replicate_span", "SELECT display_name, dataset, strftime(min(ts), '%Y-%m-%d') AS first_run, strftime(max(ts), '%Y-%m-%d') AS last_run FROM runs GROUP BY ALL", ctes="runs")
def replicate_span(s):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return s.runs.groupBy("display_name", "dataset").agg(day(F.min("ts")).alias("first_run"), day(F.max("ts")).alias("last_run"))


@query("run_counts", f"""SELECT e.run_id, n.run_count, c.dataset_coverage_count FROM dedup e
    JOIN (SELECT display_name, family, dataset, temperature, template, count(*) AS run_count FROM runs GROUP BY ALL) n ON n.display_name = e.display_name AND n.family = e.family AND n.dataset = e.dataset AND n.temperature IS NOT DISTINCT FROM e.temperature AND n.template IS NOT DISTINCT FROM e.template
    JOIN (SELECT display_name, family, temperature, template, count(DISTINCT dataset) AS dataset_coverage_count FROM runs GROUP BY ALL) c ON c.display_name = e.display_name AND c.family = e.family AND c.temperature IS NOT DISTINCT FROM e.temperature AND c.template IS NOT DISTINCT FROM e.template""",
    ctes=ENTRY_CTES, **ENTRY_SQL)
def run_counts(s):
    return R.run_counts(R.dedup_best_run(s.runs), s.runs).select("run_id", "run_count", "dataset_coverage_count")


CEIL_SQL = "SELECT dataset, 0.5e0 + 0.5e0 * max(sps) AS ceiling FROM runs GROUP BY dataset"


def ceilings(s):
    return s.runs.groupBy("dataset").agg((F.lit(0.5) + F.lit(0.5) * F.max("sps")).alias("ceiling"))


@query("normalised_sps", """SELECT e.run_id, CASE WHEN c.ceiling - u.unc > 0 THEN greatest(0e0, least(1.05e0, (e.sps - u.unc) / (c.ceiling - u.unc))) END AS normalised_sps
    FROM dedup e LEFT JOIN productraw p ON p.product = e.display_name
    LEFT JOIN (SELECT dataset, display_name, max(sps) AS unc FROM dedup WHERE family = 'raw' AND sps > 0 GROUP BY ALL) u ON u.dataset = e.dataset AND u.display_name = CASE e.family WHEN 'raw' THEN e.display_name WHEN 'product' THEN p.raw_name END
    LEFT JOIN ceil c ON c.dataset = e.dataset""", "normalised_sps", ctes="runs productraw", **ENTRY_SQL, ceil=CEIL_SQL)
def normalised_sps(s):
    from .bridge import PRODUCT_MODELS

    products = s.small(PRODUCT_MODELS, "product string, raw_name string")
    return R.normalised_sps(R.dedup_best_run(s.runs), ceilings(s), products).select("run_id", "normalised_sps")


def raw_dists(s):
    best = R.dedup_best_run(s.runs_of(s.shares)).where("family = 'raw'").select("run_id", F.col("display_name").alias("name"), "mean_jsd")
    d = model_maps(s).join(best, "run_id").drop("model").withColumnRenamed("name", "model")
    return d, best.join(s.base.select("run_id", "dataset").distinct(), "run_id")


RAW_PAIRS = {
    "rawlongs": "SELECT l.*, d.display_name FROM long l JOIN dedup d ON d.run_id = l.run_id AND d.family = 'raw'",
    "rawpairs": f"""SELECT dataset, model_a, model_b, round(avg(jsd), 6) AS mean_jsd, count(*) AS n_shared FROM (
        SELECT a.dataset, a.display_name AS model_a, b.display_name AS model_b, a.key, {jsd_of('a.p_model', 'b.p_model')} AS jsd FROM rawlongs a JOIN rawlongs b
        ON a.key = b.key AND a.option = b.option AND a.display_name < b.display_name GROUP BY ALL) GROUP BY ALL""",
}


@query("concordance", "SELECT * FROM rawpairs", "mean_jsd", ctes=ENTRY_CTES + " long", **ENTRY_SQL, **RAW_PAIRS)
def concordance(s):
    return A.concordance(*raw_dists(s))[0]


@query("concordance_summary", """SELECT p.dataset, avg(p.mean_jsd) AS mean_cross_model_jsd, count(*) AS n_pairs, min(h.m) AS mean_human_jsd FROM rawpairs p
    JOIN (SELECT dataset, avg(mean_jsd) AS m FROM dedup WHERE family = 'raw' GROUP BY dataset) h ON h.dataset = p.dataset GROUP BY p.dataset""",
       "mean_cross_model_jsd mean_human_jsd", ctes=ENTRY_CTES + " long", **ENTRY_SQL, **RAW_PAIRS)
def concordance_summary(s):
    return A.concordance(*raw_dists(s))[1]


# --- topics, configurations, variance ----------------------------------------------


def with_topic(s):
    return s.scored.join(s.topics, "key")


@query("topic_mean", "SELECT run_id, topic, avg(parity) AS mean_parity FROM scored JOIN qtopics USING (key) WHERE topic IS NOT NULL GROUP BY ALL", "mean_parity", ctes="scored qtopics")
def topic_mean(s):
    return with_topic(s).where("topic IS NOT NULL").groupBy("run_id", "topic").agg(F.avg("parity").alias("mean_parity"))


TOPIC_SQL = {"tm": """SELECT run_id, topic, min(dataset) AS dataset, avg(parity) AS sps, count(parity) AS n, 1e0 - avg(jsd) AS p_dist, (1e0 + avg(tau)) / 2e0 AS p_rank,
    greatest(0e0, 1e0 - avg(abs(model_refusal_rate - human_refusal_rate))) AS p_refuse FROM scored JOIN qtopics USING (key) WHERE topic IS NOT NULL GROUP BY run_id, topic"""}


@query("topic_metrics", "SELECT run_id, topic, sps, n, p_dist, p_rank, p_refuse FROM tm", "sps p_dist p_rank p_refuse", ctes="scored qtopics", **TOPIC_SQL)
def topic_metrics(s):
    return R.topic_metrics(with_topic(s))


@query("topic_replicates", "SELECT dataset, topic, avg(sps) AS mean, CASE WHEN count(*) = 1 THEN 0e0 ELSE stddev_samp(sps) END AS std, count(*) AS n_replicates FROM tm GROUP BY ALL", "mean std", ctes="scored qtopics", **TOPIC_SQL)
def topic_replicates(s):
    t = R.topic_metrics(with_topic(s)).withColumn("dataset", F.substring_index("run_id", "_", 1))
    return R.topic_replicates(t, ["dataset"])


def run_configs(s):
    d = P.parse_provider(s.runs.withColumn("question_set_hash", F.lit(None).cast("string")))
    return P.config_id(d)


@query("config_rollup", """SELECT count(*) AS n_replicates, avg(sps) AS sps_mean, CASE WHEN count(*) = 1 THEN 0e0 ELSE stddev_samp(sps) END AS sps_std,
    avg(mean_jsd) AS mean_jsd_mean, CASE WHEN count(*) = 1 THEN 0e0 ELSE stddev_samp(mean_jsd) END AS mean_jsd_std, avg(mean_tau) AS mean_tau_mean, CASE WHEN count(*) = 1 THEN 0e0 ELSE stddev_samp(mean_tau) END AS mean_tau_std,
    string_agg(run_id, ',' ORDER BY ts, run_id) AS replicates FROM runs GROUP BY dataset, CASE WHEN model = 'm2' THEN 'm1' ELSE model END""",
    "sps_mean sps_std mean_jsd_mean mean_jsd_std mean_tau_mean mean_tau_std", ctes="runs")
def config_rollup(s):
    return R.config_rollup(run_configs(s)).drop("config_id")


@query("variance_summary", "SELECT dataset, family, count(sps) AS n_replicates, avg(sps) AS mean, CASE WHEN count(*) = 1 THEN 0e0 ELSE stddev_samp(sps) END AS std, min(sps) AS lo, max(sps) AS hi, CASE WHEN count(*) = 1 THEN 0e0 ELSE stddev_samp(sps) END / avg(sps) AS cv FROM runs GROUP BY ALL", "mean std lo hi cv", ctes="runs")
def variance_summary(s):
    return R.variance_summary(s.runs, ["dataset", "family"])


@query("replicate_report", """SELECT dataset, metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, CASE WHEN avg(value) > 0 THEN stddev_samp(value) / avg(value) ELSE 0e0 END AS cv FROM (
    UNPIVOT (SELECT dataset, sps, p_dist, p_rank, p_refuse FROM runs) ON sps, p_dist, p_rank, p_refuse INTO NAME metric VALUE value) GROUP BY ALL""", "mean std min max cv", ctes="runs")
def replicate_report(s):
    return R.replicate_report(s.runs, ["dataset"], ["sps", "p_dist", "p_rank", "p_refuse"])


@query("suite_variance", "SELECT dataset, avg(sps) AS mean, stddev_samp(sps) AS std, stddev_samp(sps) / avg(sps) > 0.02e0 AS high_variance FROM runs GROUP BY dataset", "mean std", ctes="runs")
def suite_variance(s):
    d = R.variance_summary(s.runs, ["dataset"])
    return d.select("dataset", "mean", "std", (F.col("cv") > 0.02).alias("high_variance"))


WANTED = [("opinionsqa", 30, 2), ("gss", 30, 5), ("subpop", 15, 1), ("wvs", 30, 1), ("ntia", 5, 3)]


@query("suite_gaps", """SELECT w.dataset, w.samples, w.repeats, count(r.run_id) AS n_existing, CASE WHEN count(r.run_id) >= w.repeats THEN 'done' WHEN count(r.run_id) > 0 THEN 'partial' ELSE 'missing' END AS status
    FROM (VALUES ('opinionsqa', 30, 2), ('gss', 30, 5), ('subpop', 15, 1), ('wvs', 30, 1), ('ntia', 5, 3)) w(dataset, samples, repeats) LEFT JOIN runs r ON r.dataset = w.dataset AND r.samples_per_question = w.samples GROUP BY w.dataset, w.samples, w.repeats""", "", "samples repeats", ctes="runs")
def suite_gaps(s):
    wanted = s.small([("any", d, "all", n, r) for d, n, r in WANTED], "provider string, dataset string, topic string, samples int, repeats int")
    runs = s.runs.select(F.lit("any").alias("provider"), "dataset", F.lit("all").alias("topic"), F.col("samples_per_question").alias("samples"), "sps")
    return R.suite_gaps(wanted, runs).select("dataset", "samples", "repeats", "n_existing", "status")


@query("baseline_floors", f"""SELECT provider, dataset, max(sps) AS sps, arg_max(run_id, sps) AS run_id, CASE provider WHEN 'random-baseline' THEN 0.8e0 ELSE 0.85e0 END AS threshold,
    max(sps) >= CASE provider WHEN 'random-baseline' THEN 0.8e0 ELSE 0.85e0 END AS violation FROM runs WHERE provider IN {BL} GROUP BY provider, dataset""", "sps threshold", ctes="runs")
def baseline_floors(s):
    return R.baseline_floors(s.runs)


@query("explore_configs", """SELECT dataset, CASE WHEN model = 'm2' THEN 'm1' ELSE model END AS model, avg(sps) AS sps, count(*) AS n FROM runs WHERE family <> 'baseline' AND n_questions >= 50 AND samples_per_question > 10
    AND (temperature IS NULL OR temperature BETWEEN 0 AND 1) GROUP BY ALL""", "sps", ctes="runs")
def explore_configs(s):
    keep = (F.col("family") != "baseline") & (F.col("n_questions") >= 50) & (F.col("samples_per_question") > 10)
    keep = keep & (F.col("temperature").isNull() | F.col("temperature").between(0, 1))
    d = run_configs(s).where(keep)
    return d.groupBy("config_id").agg(
        F.first("dataset").alias("dataset"), F.min("run_model").alias("model"), F.avg("sps").alias("sps"), F.count("*").alias("n")
    ).drop("config_id")


@query("vs_baselines", f"""SELECT r.run_id, b.provider AS baseline, r.composite_parity - b.composite_parity AS delta, CASE WHEN b.composite_parity > 0 THEN (r.composite_parity - b.composite_parity) / b.composite_parity * 100 ELSE 0e0 END AS pct
    FROM runs r, (SELECT * FROM runs WHERE provider IN {BL} QUALIFY row_number() OVER (PARTITION BY provider ORDER BY n_questions DESC, run_id) = 1) b""", "delta pct", ctes="runs")
def vs_baselines(s):
    return R.vs_baselines(s.runs)


@query("compare_metrics", """PIVOT (SELECT metric, model, avg(value) AS value FROM (UNPIVOT (SELECT model, composite_parity, mean_jsd, median_jsd, mean_tau, CAST(n_questions AS DOUBLE) AS n_questions FROM runs) ON composite_parity, mean_jsd, median_jsd, mean_tau, n_questions INTO NAME metric VALUE value) GROUP BY ALL)
    ON model IN ('m1', 'm2', 'm3', 'm4', 'm5', 'm6', 'm7') USING max(value) GROUP BY metric""", "m1 m2 m3 m4 m5 m6 m7", ctes="runs")
def compare_metrics(s):
    d = s.runs.withColumn("n_questions", F.col("n_questions").cast("double"))
    long = d.unpivot(["run_model"], ["composite_parity", "mean_jsd", "median_jsd", "mean_tau", "n_questions"], "metric", "value")
    return long.groupBy("metric").pivot("run_model", [f"m{i}" for i in range(1, 8)]).agg(F.avg("value"))


@query("best_worst_questions", """SELECT run_id, key, jsd, place, side FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(jsd, 9), key) AS place, 'best' AS side FROM scored UNION ALL
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(jsd, 9) DESC, key), 'worst' FROM scored) WHERE place <= 5""", "jsd", ctes="scored")
def best_worst_questions(s):
    d = s.scored.select("run_id", "key", F.round("jsd", 9).alias("jsd"))
    return R.best_worst_questions(d)


@query("jsd_histogram", "SELECT run_id, CAST(least(floor(jsd * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM scored GROUP BY ALL", ctes="scored")
def jsd_histogram(s):
    return R.jsd_histogram(s.scored, ["run_id"])


# --- questions --------------------------------------------------------------------

QR_SQL = {
    "qr": """SELECT s.*, c.display_name, c.family, c.provider, contains(lower(c.provider), 'ensemble') AS is_ensemble FROM scored s JOIN cfg c ON c.model = s.model WHERE c.family <> 'baseline'
        QUALIFY row_number() OVER (PARTITION BY s.dataset, s.key, c.family, c.display_name, contains(lower(c.provider), 'ensemble') ORDER BY n_samples DESC, run_id) = 1""",
    "qrl": "SELECT l.*, q.display_name, q.family, q.family || '/' || q.display_name AS responder FROM long l JOIN qr q ON q.run_id = l.run_id AND q.key = l.key WHERE NOT q.is_ensemble",
    "qp": f"""SELECT dataset, key, avg(jsd) AS m, max(jsd) AS x FROM (SELECT a.dataset, a.key, a.responder AS ra, b.responder AS rb, {jsd_of('a.p_model', 'b.p_model')} AS jsd FROM qrl a JOIN qrl b
        ON a.key = b.key AND a.option = b.option AND a.responder < b.responder GROUP BY ALL) GROUP BY ALL""",
    "qm": "SELECT run_id, key, arg_max(option, (p_model, -pos)) AS modal FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY option) AS pos FROM qrl) GROUP BY run_id, key",
    "qc": "SELECT key, modal FROM (SELECT key, modal, count(*) AS c FROM qm GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, modal) = 1",
    "qs": """SELECT q.dataset, q.key, count(*) AS n_models, min(qp.m) AS cross_model_jsd_mean, min(qp.x) AS cross_model_jsd_max, min(qc.modal) AS consensus_option, min(h.top) AS human_top_option,
        CASE WHEN count(*) >= 2 THEN max(model_refusal_rate) - min(model_refusal_rate) END AS refusal_rate_spread, avg(round(jsd, 6)) AS jsd_to_human_mean
        FROM qr q LEFT JOIN qp ON qp.key = q.key LEFT JOIN qc ON qc.key = q.key JOIN (SELECT key, arg_max(option, (n, -pos)) AS top FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY option) AS pos FROM qopt) GROUP BY key) h ON h.key = q.key
        WHERE NOT q.is_ensemble GROUP BY q.dataset, q.key""",
}


def qroll(s):
    names = P.with_display(s.models, s.names).select("model", "provider", "display_name", "family")
    return R.question_rollup(s.shares.join(names, "model"))


@query("question_rollup", "SELECT dataset, key, family, display_name, is_ensemble, run_id, n_samples FROM qr", ctes="scored cfg", **QR_SQL)
def question_rollup(s):
    return qroll(s).select("dataset", "key", "family", "display_name", "is_ensemble", "run_id", "n_samples")


@query("question_summary", "SELECT * FROM qs", "cross_model_jsd_mean cross_model_jsd_max refusal_rate_spread jsd_to_human_mean", ctes="scored cfg long", **QR_SQL)
def question_summary(s):
    return R.question_summary(qroll(s))


@query("question_index", "SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY round(cross_model_jsd_mean, 6) DESC NULLS LAST, key) AS position FROM qs", ctes="scored cfg long", **QR_SQL)
def question_index(s):
    return R.question_index(R.question_summary(qroll(s))).select("dataset", "key", "position")


RISK_SQL = {
    "ostd": """SELECT key, option, sum(s) AS p FROM (SELECT key, option, stddev_pop(p_model) AS s FROM long GROUP BY ALL) GROUP BY ALL""",
    "risk": """SELECT r.key, n.n_models, r.mean_std, round(1e0 - least(r.mean_std / 0.5e0, 1e0), 6) AS risk FROM (SELECT key, avg(p) AS mean_std, count(*) AS n_options FROM ostd GROUP BY key) r
        JOIN (SELECT key, count(*) AS n_models FROM cells GROUP BY key) n USING (key) WHERE n.n_models >= 2""",
}


@query("contamination_risk", "SELECT key, n_models, mean_std, risk, CASE WHEN risk >= 0.8e0 THEN 'high' WHEN risk >= 0.5e0 THEN 'medium' ELSE 'low' END AS band FROM risk", "mean_std risk", ctes="long cells", **RISK_SQL)
def contamination_risk(s):
    return A.contamination_risk(model_maps(s), ["key"]).select("key", "n_models", "mean_std", "risk", "band")


@query("risk_topk", """SELECT key, risk, side FROM (SELECT *, 'highest' AS side FROM (SELECT * FROM risk ORDER BY risk DESC, key LIMIT 20)) UNION ALL SELECT key, risk, 'lowest' FROM (SELECT * FROM risk ORDER BY risk, key DESC LIMIT 20)""", "risk", ctes="long cells", **RISK_SQL)
def risk_topk(s):
    d = A.contamination_risk(model_maps(s), ["key"]).select("key", "risk")
    high = d.orderBy(F.desc("risk"), F.asc("key")).limit(20).withColumn("side", F.lit("highest"))
    return high.union(d.orderBy(F.asc("risk"), F.desc("key")).limit(20).withColumn("side", F.lit("lowest")))


@query("deident_drift", f"""SELECT p.key, avg(p.jsd) AS mean_pairwise_jsd, max(CASE WHEN p.model_a = e.lo AND p.model_b = e.hi THEN p.jsd END) AS drift_first_last, min(o.mean_std) AS mean_option_std
    FROM pairs p JOIN (SELECT key, min(model) AS lo, max(model) AS hi FROM cells GROUP BY key) e ON e.key = p.key
    JOIN (SELECT key, avg(p) AS mean_std FROM ostd GROUP BY key) o ON o.key = p.key GROUP BY p.key""", "mean_pairwise_jsd drift_first_last mean_option_std", ctes="long cells", pairs=pair_sql("a.dataset"), **RISK_SQL)
def deident_drift(s):
    return A.deident_drift(model_maps(s).select("key", F.col("model").alias("level"), "dist"))


@query("paraphrase_sensitivity", """SELECT key, original, mean_paraphrase, original - mean_paraphrase AS delta, CASE WHEN original > 0 THEN (original - mean_paraphrase) / original * 100 ELSE 0e0 END AS pct FROM (
    SELECT key, max(parity) FILTER (model = 'm1') AS original, coalesce(avg(parity) FILTER (model <> 'm1'), 0e0) AS mean_paraphrase FROM scored GROUP BY key) WHERE original IS NOT NULL""", "original mean_paraphrase delta pct", ctes="scored")
def paraphrase_sensitivity(s):
    first = F.col("model") == "m1"
    d = s.scored.groupBy("key").agg(
        F.max(F.when(first, F.col("parity"))).alias("original"),
        F.coalesce(F.avg(F.when(~first, F.col("parity"))), F.lit(0.0)).alias("mean_paraphrase"),
    ).where("original IS NOT NULL")
    delta = F.col("original") - F.col("mean_paraphrase")
    return d.withColumn("delta", delta).withColumn(
        "pct", F.when(F.col("original") > 0, delta / F.col("original") * 100).otherwise(F.lit(0.0))
    )


@query("paraphrase_overall", """SELECT avg(parity) FILTER (model = 'm1') AS original_sps, avg(parity) FILTER (model <> 'm1') AS adjusted_sps FROM scored WHERE key IN (SELECT key FROM scored WHERE model = 'm1')""", "original_sps adjusted_sps", ctes="scored")
def paraphrase_overall(s):
    first = F.col("model") == "m1"
    originals = s.base.where(first).select("key").distinct()
    return s.scored.join(originals, "key", "left_semi").agg(
        F.avg(F.when(first, F.col("parity"))).alias("original_sps"), F.avg(F.when(~first, F.col("parity"))).alias("adjusted_sps")
    )


@query("policy_redact", f"""SELECT run_id, s.dataset, key, coalesce(p.tier, 'aggregates_only') AS tier, {private('s.dataset', 'key')} AS is_holdout,
    CASE WHEN coalesce(p.tier, 'aggregates_only') IN ('full', 'gated') AND NOT {private('s.dataset', 'key')} THEN human_refusal_rate END AS human_refusal_rate FROM scored s LEFT JOIN policies p ON p.dataset = split_part(s.dataset, ' ', 1)""", "human_refusal_rate", ctes="scored policies")
def policy_redact(s):
    return R.policy_redact(s.scored, policies(s)).select("run_id", "dataset", "key", "tier", "is_holdout", "human_refusal_rate")


@query("sink_routed", """SELECT run_id, CASE p.tier WHEN 'full' THEN 'public' WHEN 'gated' THEN 'restricted' END AS route FROM (SELECT DISTINCT run_id, dataset FROM base) s LEFT JOIN policies p ON p.dataset = split_part(s.dataset, ' ', 1)""", ctes="base policies")
def sink_routed(s):
    d = R.with_tier(s.base.select("run_id", "dataset").distinct(), policies(s))
    return d.select("run_id", R.route(F.col("tier")).alias("route"))


@query("routes_manifest", f"""SELECT dataset, string_agg(safe, ',' ORDER BY safe) AS keys, count(*) AS n FROM (SELECT DISTINCT p.dataset, regexp_replace(p.key, '[^A-Za-z0-9_\\-]', '_', 'g') AS safe FROM parts p JOIN policies t ON t.dataset = split_part(p.dataset, ' ', 1)
    WHERE t.tier = 'gated' AND NOT {private('p.dataset', 'p.key')}) GROUP BY dataset""", ctes="parts policies")
def routes_manifest(s):
    from ..sources.sinks import routes_manifest as manifest

    d = manifest(R.with_tier(s.part.select("dataset", "key"), policies(s)))
    return d.select("dataset", F.array_join("keys", ",").alias("keys"), F.size("keys").cast("bigint").alias("n"))


@query("rehydrate_text", "SELECT p.key, CASE WHEN length(t.text) > length(p_name) THEN t.text ELSE p_name END AS text FROM parts p LEFT JOIN texts t USING (key)", ctes="parts texts")
def rehydrate_text(s):
    registry = s.texts.join(s.part.select("key", "dataset"), "key")
    return R.rehydrate_text(s.part.select("dataset", "key", F.col("p_name").alias("text")), registry).select("key", "text")


@query("stamp_version", "SELECT key, coalesce(v, 1) AS schema_version FROM (SELECT key, CASE WHEN p_size > 25 THEN 2 END AS v FROM parts)", "", "schema_version", ctes="parts")
def stamp_version(s):
    from ..sources.runs import stamp_version as stamp

    d = s.part.select("key", F.when(F.col("p_size") > 25, 2).alias("schema_version"))
    return stamp(d)


@query("holdout_accuracy", """SELECT truth, dataset AS sector, count(*) AS n, avg(CASE WHEN verdict = truth THEN 1e0 ELSE 0e0 END) AS accuracy FROM verdicts GROUP BY GROUPING SETS ((), (truth), (dataset))""", "accuracy", ctes="parts", verdicts=VERDICT_SQL)
def holdout_accuracy(s):
    from .q_metrics import verdict_rows

    return R.outcome_accuracy(verdict_rows(s).withColumnRenamed("dataset", "sector"))


@query("confusion", """SELECT truth, count(*) FILTER (verdict = 'success') AS success, count(*) FILTER (verdict = 'mixed') AS mixed, count(*) FILTER (verdict = 'failure') AS failure FROM verdicts WHERE verdict <> 'unparseable' GROUP BY truth""", ctes="parts", verdicts=VERDICT_SQL)
def confusion(s):
    from .q_metrics import verdict_rows

    return R.confusion(verdict_rows(s))


@query("partition_valid", """SELECT run_id, CASE WHEN n >= 10 AND uf >= 0.8e0 AND rr <= 0.05e0 THEN 'invalid' ELSE 'valid' END AS state FROM (SELECT run_id, count(*) AS n, avg(CASE WHEN dev < 0.01e0 THEN 1e0 ELSE 0e0 END) AS uf, avg(rr) AS rr FROM (
    SELECT l.run_id, l.key, max(abs(p_model - 1e0 / l.k)) AS dev, min(s.model_refusal_rate) AS rr FROM long l JOIN scored s USING (run_id, key) GROUP BY l.run_id, l.key) GROUP BY run_id)""", ctes="long scored")
def partition_valid(s):
    from ..operators.quality import run_validity

    return run_validity(s.scored).select("run_id", F.when(F.col("invalid"), "invalid").otherwise("valid").alias("state"))


@query("ci_overlap", """SELECT a.run_id AS run_a, b.run_id AS run_b, CASE WHEN a.hi IS NULL OR b.hi IS NULL THEN 'unknown' WHEN greatest(a.lo, b.lo) <= least(a.hi, b.hi) THEN 'overlap' ELSE 'disjoint' END AS verdict
    FROM ci a JOIN ci b ON a.dataset = b.dataset AND a.model = 'm1' AND b.model <> 'm1'""", ctes="runs",
    ci="SELECT run_id, dataset, model, sps - 0.01e0 AS lo, CASE WHEN model <> 'm7' THEN sps + 0.01e0 END AS hi FROM runs")
def ci_overlap(s):
    c = s.runs.select("run_id", "dataset", "run_model", (F.col("sps") - 0.01).alias("lo"), F.when(F.col("run_model") != "m7", F.col("sps") + 0.01).alias("hi"))
    a = c.where("run_model = 'm1'").select(F.col("run_id").alias("run_a"), "dataset", F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = c.where("run_model <> 'm1'").select(F.col("run_id").alias("run_b"), "dataset", F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    return a.join(b, "dataset").select("run_a", "run_b", R.ci_overlap(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb")).alias("verdict"))


# --- demographics -----------------------------------------------------------------

DEMO_SQL = {
    "gh": "SELECT key, grp, option, n / sum(n) OVER (PARTITION BY key, grp) AS p FROM (SELECT key, grp, option, count(*) AS n FROM grouped GROUP BY ALL)",
    "gm": "SELECT run_id, key, grp, selected_option AS option, count(*) AS c FROM grouped WHERE NOT refusal GROUP BY ALL",
    "gt": "SELECT run_id, key, grp FROM grouped GROUP BY ALL",
    "gl": """SELECT t.run_id, t.key, t.grp, o.option, o.k, coalesce(h.p, 0e0) AS p_group, coalesce(m.c, 0) AS c, l.p_model FROM gt t JOIN qopt o ON o.key = t.key
        LEFT JOIN gh h ON h.key = t.key AND h.grp = t.grp AND h.option = o.option LEFT JOIN gm m ON m.run_id = t.run_id AND m.key = t.key AND m.grp = t.grp AND m.option = o.option
        JOIN long l ON l.run_id = t.run_id AND l.key = t.key AND l.option = o.option""",
    "gc": "SELECT *, CASE WHEN s > 0 THEN c / s ELSE 1e0 / k END AS p_cond FROM (SELECT *, sum(c) OVER (PARTITION BY run_id, key, grp) AS s FROM gl)",
    "gj": f"SELECT run_id, key, grp, {jsd_of('p_group', 'p_cond')} AS jc, {jsd_of('p_group', 'p_model')} AS ju FROM gc GROUP BY run_id, key, grp",
    "de": """SELECT run_id, 'SEGMENT' AS attribute, grp AS "group", 1e0 - avg(jc) AS p_dist, 1e0 - avg(ju) AS default_score, avg(greatest(0e0, ju - jc)) AS p_cond, count(*) AS n_questions FROM gj GROUP BY run_id, grp""",
}


def demo_rows(s):
    g = s.grouped
    human = S.question_distributions(g, ["key", "group"]).select(
        "key", "group", F.lit("SEGMENT").alias("attribute"), F.map_from_arrays("options", "p_human").alias("g_human")
    )
    counts = g.groupBy("run_id", "key", "group", "selected_option").agg(F.count_if(~F.col("refusal")).alias("n"))
    cond = counts.groupBy("run_id", "key", "group").agg(
        F.map_from_entries(F.collect_list(F.struct("selected_option", F.col("n").cast("double")))).alias("p_cond")
    )
    return G.group_rows(human, cond, s.sides.select("run_id", "key", "options", "p_model"))


def demo_eval(s):
    return G.demographic_eval(demo_rows(s))


@query("cond_fidelity", 'SELECT run_id, key, grp AS "group", greatest(0e0, ju - jc) AS p_cond FROM gj', "p_cond", ctes="grouped qopt long", **DEMO_SQL)
def cond_fidelity(s):
    return demo_rows(s).select("run_id", "key", "group", G.cond_gain(F.col("jsd_conditioned"), F.col("jsd_unconditioned")).alias("p_cond"))


@query("demographic_eval", "SELECT * FROM de", "p_dist default_score p_cond", ctes="grouped qopt long", **DEMO_SQL)
def demographic_eval(s):
    return demo_eval(s)


@query("subgroup_cv", "SELECT run_id, CASE WHEN count(*) < 2 THEN 1e0 WHEN avg(p_dist) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, 1e0 - stddev_pop(p_dist) / avg(p_dist))) END AS p_sub FROM de GROUP BY run_id", "p_sub", ctes="grouped qopt long", **DEMO_SQL)
def subgroup_cv(s):
    return G.run_groups(demo_eval(s), ["run_id"]).select("run_id", "p_sub")


@query("p_cond_fallback", "SELECT run_id, avg(greatest(0e0, p_dist - default_score)) AS p_cond FROM de GROUP BY run_id", "p_cond", ctes="grouped qopt long", **DEMO_SQL)
def p_cond_fallback(s):
    return G.run_groups(demo_eval(s), ["run_id"]).select("run_id", "p_cond")


@query("run_score_conditioned", """SELECT r.run_id, (p_dist + p_rank + p_refuse + g.p_sub + g.p_cond) / 5e0 AS sps FROM runscore r JOIN (SELECT run_id, greatest(0e0, least(1e0, 1e0 - stddev_pop(p_dist) / avg(p_dist))) AS p_sub,
    avg(greatest(0e0, p_dist - default_score)) AS p_cond FROM de GROUP BY run_id) g USING (run_id)""", "sps", ctes="grouped qopt long runscore", **DEMO_SQL)
def run_score_conditioned(s):
    groups = G.run_groups(demo_eval(s), ["run_id"])
    return S.run_score(s.scored, ["run_id"], groups, median=False).select("run_id", "sps")


@query("best_worst_group", """SELECT run_id, attribute, arg_max("group", (p_dist, "group")) AS best, max(p_dist) AS best_p_dist, arg_min("group", (p_dist, "group")) AS worst, min(p_dist) AS worst_p_dist FROM de GROUP BY ALL""", "best_p_dist worst_p_dist", ctes="grouped qopt long", **DEMO_SQL)
def best_worst_group(s):
    return G.best_worst_group(demo_eval(s))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("heatmap", f"""SELECT run_id, attribute, {', '.join(f"max(de.p_dist) FILTER (\"group\" = '{g}') AS {g}" for g in SEGMENTS)}, min(r.sps) AS sps FROM de JOIN runscore r USING (run_id) GROUP BY run_id, attribute""", "sps " + " ".join(SEGMENTS), ctes="grouped qopt long runscore", **DEMO_SQL)
def heatmap(s):
    return G.heatmap(demo_eval(s), S.run_score(s.scored, median=False), SEGMENTS)


@query("demographic_flatten", 'SELECT run_id, attribute, "group", p_dist, n_questions FROM de', "p_dist", ctes="grouped qopt long", **DEMO_SQL)
def demographic_flatten(s):
    rows = demo_eval(s)
    nested = rows.groupBy("run_id", "attribute").agg(F.collect_list(F.struct("attribute", "group", "p_dist", "n_questions")).alias("g"))
    nested = nested.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "g"))).alias("demographic_breakdown"))
    return G.flatten(nested)


@query("merge_demographics", """SELECT d.run_id AS winner, o.run_id AS source_run, o."group", o.n_questions FROM dedup d JOIN (SELECT e.*, r.display_name, r.family, r.dataset FROM de e JOIN runs r USING (run_id)) o
    ON o.display_name = d.display_name AND o.family = d.family AND o.dataset = d.dataset QUALIFY dense_rank() OVER (PARTITION BY d.run_id ORDER BY (o.run_id <> d.run_id), o.run_id) = 1""", ctes="grouped qopt long runs", **DEMO_SQL, **ENTRY_SQL)
def merge_demographics(s):
    return R.merge_demographics(s.runs, demo_eval(s)).select("winner", "source_run", "group", "n_questions")


# --- blends -----------------------------------------------------------------------

MEMBERS = ["m1", "m3", "m7"]
IN = "('m1', 'm3', 'm7')"


def members(s):
    d = s.scored.where(F.col("model").isin(MEMBERS))
    return E.shared_by_all(d, ["dataset", "key"], "model", len(MEMBERS))


def blend_sql(weight: str) -> dict:
    return {
        "mem": f"SELECT s.* FROM scored s WHERE model IN {IN} AND key IN (SELECT key FROM scored WHERE model IN {IN} GROUP BY key HAVING count(DISTINCT model) = 3)",
        "wts": f"SELECT dataset, model, w / sum(w) OVER (PARTITION BY dataset) AS w FROM (SELECT dataset, model, {weight} AS w FROM mem GROUP BY dataset, model)",
        "bl": "SELECT l.dataset, l.key, l.option, min(l.p_human) AS p_human, sum(w.w * l.p_model) AS p_model FROM long l JOIN mem m ON m.run_id = l.run_id AND m.key = l.key JOIN wts w ON w.dataset = l.dataset AND w.model = l.model GROUP BY l.dataset, l.key, l.option",
        "bt": tau_cte("(SELECT dataset, key, option, p_human, round(p_model, 12) AS p_model FROM bl)", "dataset, key"),
        "bj": f"SELECT dataset, key, {jsd_of('p_human', 'p_model')} AS jsd FROM bl GROUP BY dataset, key",
        "bside": "SELECT m.dataset, m.key, CAST(sum(n_samples) AS BIGINT) AS n_samples, sum(w.w * model_refusal_rate) AS model_refusal_rate, min(human_refusal_rate) AS human_refusal_rate FROM mem m JOIN wts w ON w.dataset = m.dataset AND w.model = m.model GROUP BY m.dataset, m.key",
        "bq": "SELECT bj.dataset, bj.key, jsd, coalesce(tau, 0e0) AS tau, n_samples, model_refusal_rate, human_refusal_rate FROM bj LEFT JOIN bt ON bt.dataset = bj.dataset AND bt.key = bj.key JOIN bside b ON b.key = bj.key AND b.dataset = bj.dataset",
    }


def weights(s, kind: str):
    m = members(s).groupBy("dataset", "model").agg(F.avg("jsd").alias("j"), F.avg("tau").alias("t"))
    w = {"equal": F.lit(1.0), "score": D.parity(F.col("j"), F.col("t")), "inverse": F.lit(1.0) / F.greatest("j", F.lit(0.001))}[kind]
    return m.select("dataset", "model", w.alias("weight"))


def blended(s, kind="equal"):
    return E.blend(members(s), weights(s, kind), ["dataset", "key"])


@query("ensemble_blend", "SELECT dataset, key, jsd, n_samples, model_refusal_rate FROM bq", "jsd model_refusal_rate", ctes="long scored", **blend_sql("1e0"))
def ensemble_blend(s):
    return blended(s).select("dataset", "key", "jsd", "n_samples", "model_refusal_rate")


@query("ensemble_scores", "SELECT dataset, count(*) AS n_questions, avg(jsd) AS mean_jsd, list_sort(list(jsd))[CAST(count(*) // 2 AS BIGINT) + 1] AS median_jsd FROM bq GROUP BY dataset", "mean_jsd median_jsd", ctes="long scored", **blend_sql("1e0"))
def ensemble_scores(s):
    return E.blend_scores(blended(s), ["dataset"]).select("dataset", "n_questions", "mean_jsd", "median_jsd")


WKINDS = {"equal": "1e0", "score": parity_of("avg(jsd)", "avg(tau)"), "inverse": "1e0 / greatest(avg(jsd), 0.001e0)"}


@query("blend_weights", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, dataset, model, {w} AS weight FROM mem GROUP BY dataset, model" for k, w in WKINDS.items()) + ")", "weight", ctes="scored", mem=blend_sql("1e0")["mem"])
def blend_weights(s):
    out = None
    for k in WKINDS:
        d = weights(s, k).select(F.lit(k).alias("kind"), "dataset", "model", "weight")
        out = d if out is None else out.union(d)
    return out


@query("oracle_pick", "SELECT dataset, model, count(*) AS picks FROM (SELECT *, row_number() OVER (PARTITION BY dataset, key ORDER BY round(jsd, 9), model) AS rn FROM mem) WHERE rn = 1 GROUP BY ALL", ctes="scored", mem=blend_sql("1e0")["mem"])
def oracle_pick(s):
    d = members(s).withColumn("jsd", F.round("jsd", 9))
    return E.oracle_pick(d, ["dataset", "key"], "model").groupBy("dataset", "model").agg(F.count("*").alias("picks"))


@query("best_file", "SELECT dataset, run_id, sps FROM runs WHERE run_id IN (SELECT run_id FROM scored GROUP BY run_id HAVING var_pop(jsd) >= 1e-10) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sps DESC, n_questions DESC, run_id) = 1", "sps", ctes="runs scored")
def best_file(s):
    return E.best_run(s.runs, s.metrics, ["dataset"]).select("dataset", "run_id", "sps")


@query("blend_delta", """SELECT a.dataset, count(*) FILTER (a.jsd - s.jsd < -1e-9) AS improved, count(*) FILTER (a.jsd - s.jsd > 1e-9) AS worsened, count(*) AS n, avg(a.jsd - s.jsd) AS mean_delta
    FROM bq a JOIN scored s ON s.key = a.key AND s.model = 'm1' GROUP BY a.dataset""", "mean_delta", ctes="long scored", **blend_sql("1e0"))
def blend_delta(s):
    snap = lambda d: d.withColumn("jsd", F.round("jsd", 9))
    return E.blend_delta(snap(blended(s)), snap(s.scored.where("model = 'm1'")), ["dataset"]).select("dataset", "improved", "worsened", "n", "mean_delta")


@query("split_sps", f"SELECT run_id, n_public, n_private, CASE WHEN n_public > 0 THEN sps_public END AS sps_public, CASE WHEN n_private > 0 THEN sps_private END AS sps_private FROM split", "sps_public sps_private", ctes="scored runs", **ENTRY_SQL)
def split_sps(s):
    from ..operators.quality import split_sps as split

    return split(s.scored).select("run_id", "n_public", "n_private", "sps_public", "sps_private")


@query("verification_badge", "SELECT run_id, CASE WHEN n_private > 0 AND n_public > 0 THEN CASE WHEN abs(sps_public - sps_private) > 0.05e0 THEN 'flagged' ELSE 'verified' END END AS badge FROM split", ctes="scored runs", **ENTRY_SQL)
def verification_badge(s):
    from ..operators.quality import split_sps as split

    d = split(s.scored)
    both = F.col("sps_public").isNotNull() & F.col("sps_private").isNotNull()
    return d.select("run_id", F.when(both, F.when(F.col("flagged"), "flagged").otherwise("verified")).alias("badge"))
