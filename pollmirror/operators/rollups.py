"""Leaderboards, rollups and comparisons over run, question and configuration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import tables as T
from ..functions import text as X
from .pairs import pair_jsd
from .ranking import rank_within, top_per_group

IDENTITY = ["display_name", "family", "dataset"]
CONFIG = [*IDENTITY, "temperature", "template"]


def stddev_or_zero(x: Column) -> Column:
    """Sample standard deviation, 0 for a single value, NULL for none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def is_baseline(provider: Column) -> Column:
    return provider.isin(T.BASELINES)


# --- runs -------------------------------------------------------------------------


def dedup_best_run(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One run per identity: the most questions, the first run id on a tie."""
    return top_per_group(runs, by or IDENTITY, [F.desc("n_questions"), F.asc("run_id")])


def merge_demographics(runs: DataFrame, groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Group rows for each winning run: per attribute its own, else the first run that has it."""
    by = by or IDENTITY
    best = dedup_best_run(runs, by).select(*by, F.col("run_id").alias("winner"))
    owners = runs.select(*by, "run_id").join(best, by)
    sources = groups.select("run_id", "attribute").distinct().join(owners, "run_id")
    chosen = top_per_group(
        sources, [*by, "attribute"], [F.desc(F.col("run_id") == F.col("winner")), F.asc("run_id")]
    )
    return groups.join(chosen.select("winner", "run_id", "attribute"), ["run_id", "attribute"]).withColumnRenamed(
        "run_id", "source_run"
    )


def replicate_agg(runs: DataFrame) -> DataFrame:
    """Replicates per configuration: mean and population std, means, count, representative."""
    return runs.groupBy(*CONFIG).agg(
        F.avg("composite_parity").alias("mean_sps"),
        F.stddev_pop("composite_parity").alias("std_sps"),
        F.avg("mean_jsd").alias("mean_jsd"),
        F.avg("mean_tau").alias("mean_tau"),
        F.count("*").alias("n_runs"),
        F.min(F.struct(-F.col("n_questions"), "run_id")).getField("run_id").alias("best_run"),
    )


def baseline_scores(runs: DataFrame) -> DataFrame:
    return (
        runs.where(is_baseline(F.col("provider")))
        .groupBy("provider", "dataset")
        .agg(F.max("composite_parity").alias("best"))
    )


def baseline_delta(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Distance to the best baselines of the same dataset; NULL for baselines themselves."""
    wide = scores.groupBy("dataset").agg(
        F.max(F.when(F.col("provider") == T.BASELINES[0], F.col("best"))).alias("_r"),
        F.max(F.when(F.col("provider") == T.BASELINES[1], F.col("best"))).alias("_m"),
    )
    own = F.when(~is_baseline(F.col("provider")), F.col("composite_parity"))
    return (
        runs.join(wide, "dataset", "left")
        .withColumn("vs_random", own - F.col("_r"))
        .withColumn("vs_majority", own - F.col("_m"))
        .drop("_r", "_m")
    )


def leaderboard(runs: DataFrame, model_filter: str | None = None, detail: bool = False) -> DataFrame:
    """Ranked by mean composite parity (summary) or by each run's own (detail)."""
    if model_filter:
        runs = runs.where(F.lower("provider").contains(model_filter.lower()))
    if detail:
        ranked = rank_within(runs.withColumn("_all", F.lit(0)), ["_all"], "composite_parity", ["run_id"], bounds=(0, 1))
        return baseline_delta(ranked.drop("_all"), baseline_scores(runs))
    agg = replicate_agg(runs)
    agg = agg.withColumn("mean_sps", F.round("mean_sps", 4)).withColumn("_all", F.lit(0))
    ranked = rank_within(agg, ["_all"], "mean_sps", ["best_run"], bounds=(0, 1)).drop("_all")
    entries = ranked.join(runs.select(F.col("run_id").alias("best_run"), "provider"), "best_run").withColumn(
        "composite_parity", F.col("mean_sps")
    )
    return baseline_delta(entries, baseline_scores(runs))


def sample_sweep(runs: DataFrame) -> DataFrame:
    """Scores per sample count of providers tried at two or more counts."""
    real = runs.where(~is_baseline(F.col("provider")))
    tried = real.groupBy("display_name").agg(F.countDistinct("samples_per_question").alias("_c")).where("_c >= 2")
    return (
        real.join(tried.select("display_name"), "display_name", "left_semi")
        .groupBy("display_name", "samples_per_question")
        .agg(
            F.count("*").alias("n_runs"),
            F.max("composite_parity").alias("best"),
            F.avg(F.round("composite_parity", 4)).alias("mean"),
        )
    )


def topic_scores_tagged(runs: DataFrame) -> DataFrame:
    """Latest score per (provider, topic tag)."""
    return runs.where("topic IS NOT NULL").groupBy("provider", "topic").agg(
        F.round(F.max_by("composite_parity", F.struct("ts", "run_id")), 4).alias("score")
    )


def run_counts(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Add run_count (same configuration) and dataset_coverage_count (same, any dataset)."""
    cov = [c for c in CONFIG if c != "dataset"]

    def keyed(df, cols):
        return df.select(
            "*", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]).alias("_k")
        )

    n = keyed(runs, CONFIG).groupBy("_k").agg(F.count("*").alias("run_count"))
    c = keyed(runs, cov).groupBy("_k").agg(F.countDistinct("dataset").alias("dataset_coverage_count"))
    out = keyed(entries, CONFIG).join(n, "_k", "left").drop("_k")
    out = keyed(out, cov).join(c, "_k", "left").drop("_k")
    return out.fillna(0, ["run_count", "dataset_coverage_count"])


def normalised_sps(entries: DataFrame, ceilings: DataFrame, product_models: DataFrame) -> DataFrame:
    """(sps - raw) / (ceiling - raw), clamped to [0, 1.05]; products use their raw model's row."""
    raw = (
        entries.where((F.col("family") == "raw") & (F.col("sps") > 0))
        .groupBy("dataset", F.col("display_name").alias("_raw"))
        .agg(F.max("sps").alias("_unc"))
    )
    d = entries.join(product_models, entries["display_name"] == product_models["product"], "left")
    d = d.withColumn(
        "_raw", F.when(F.col("family") == "raw", F.col("display_name")).when(F.col("family") == "product", F.col("raw_name"))
    )
    d = d.join(raw, ["dataset", "_raw"], "left").join(ceilings, "dataset", "left")
    denom = F.col("ceiling") - F.col("_unc")
    value = F.when(denom > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.05), (F.col("sps") - F.col("_unc")) / denom)))
    return d.withColumn("normalised_sps", value).drop("_raw", "_unc", "product", "raw_name", "ceiling")


def cost_fields(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_usd, per 100 questions and per score point; zero tokens cost zero, no price gives NULL."""
    d = runs.join(prices.withColumnRenamed("path", "_path"), F.col("price_path") == F.col("_path"), "left").drop("_path")
    used = F.col("input_tokens").isNotNull()
    free = (F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)
    priced = (F.col("input_tokens") * F.col("in_price") + F.col("output_tokens") * F.col("out_price")) / 1e6
    return per_unit_cost(d.withColumn("cost_usd", F.when(used & free, F.lit(0.0)).when(used, priced)))


def per_unit_cost(d: DataFrame) -> DataFrame:
    return d.withColumn(
        "cost_per_100q", F.when(F.col("n_questions") > 0, F.col("cost_usd") / F.col("n_questions") * 100)
    ).withColumn("cost_per_sps_point", F.when(F.col("sps") >= 0.01, F.col("cost_usd") / F.col("sps")))


def ensemble_cost(sources: DataFrame, costs: DataFrame) -> DataFrame:
    """Sum of the constituents' costs per ensemble; NULL when one of them has none."""
    d = sources.join(costs, ["provider", "dataset"], "left")
    return d.groupBy("ensemble_run").agg(
        F.when(F.count("cost_usd") == F.count("*"), F.sum("cost_usd")).alias("cost_usd"), F.count("*").alias("n_sources")
    )


def config_rollup(runs: DataFrame) -> DataFrame:
    """Per configuration: means, sample stds and the replicates in time order."""
    return runs.groupBy("config_id").agg(
        F.count("*").alias("n_replicates"),
        *[f(c).alias(f"{c}_{n}") for c in ("sps", "mean_jsd", "mean_tau") for n, f in (("mean", F.avg), ("std", lambda x: stddev_or_zero(F.col(x))))],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "run_id"))), lambda r: r["run_id"]), ",").alias("replicates"),
    )


def variance_summary(runs: DataFrame, by: list[str], value: str = "sps") -> DataFrame:
    mean, std = F.avg(value), stddev_or_zero(F.col(value))
    return runs.groupBy(*by).agg(
        F.count(value).alias("n_replicates"),
        mean.alias("mean"),
        std.alias("std"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.when(mean != 0, std / mean).otherwise(F.lit(0.0)).alias("cv"),
    )


def replicate_report(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """mean, sample std, min, max and cv per metric name."""
    long = runs.unpivot(by, metrics, "metric", "value")
    mean, std = F.avg("value"), stddev_or_zero(F.col("value"))
    return long.groupBy(*by, "metric").agg(
        mean.alias("mean"), std.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.when(mean > 0, std / mean).otherwise(F.lit(0.0)).alias("cv"),
    )


def suite_gaps(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """done / partial / missing per wanted run, from the runs with the same key."""
    have = runs.groupBy("provider", "dataset", "topic", "samples").agg(
        F.count("*").alias("n_existing"), F.avg("sps").alias("sps_mean")
    )
    d = wanted.join(have, ["provider", "dataset", "topic", "samples"], "left").fillna(0, ["n_existing"])
    return d.withColumn(
        "status",
        F.when(F.col("n_existing") >= F.col("repeats"), "done").when(F.col("n_existing") > 0, "partial").otherwise("missing"),
    )


def baseline_floors(runs: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Best baseline run per (provider, dataset) and whether it breaks its limit."""
    limits = limits or {"random-baseline": 0.80, "majority-baseline": 0.85}
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return (
        runs.where(is_baseline(F.col("provider")))
        .groupBy("provider", "dataset")
        .agg(F.max("sps").alias("sps"), F.min(F.struct(-F.col("sps"), "run_id")).getField("run_id").alias("run_id"))
        .withColumn("threshold", F.try_element_at(limit, F.col("provider")))
        .withColumn("violation", F.col("sps") >= F.col("threshold"))
    )


def dominated(entries: DataFrame, cost: str = "cost_usd", score: str = "sps") -> DataFrame:
    """Mark entries another entry beats: score at least as high, cost at most as high, one strictly.

    The best score among strictly cheaper entries, plus the best at the same cost, decide
    it, so the theta join becomes a prefix maximum.
    """
    from .ranking import max_before

    same = entries.groupBy(cost).agg(F.max(score).alias("_same"))
    d = max_before(entries, cost, score, "_cheaper").join(same, cost)
    return d.withColumn(
        "dominated",
        F.coalesce(F.col("_cheaper") >= F.col(score), F.lit(False)) | (F.col("_same") > F.col(score)),
    ).drop("_cheaper", "_same")


def ci_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    known = lo_a.isNotNull() & hi_a.isNotNull() & lo_b.isNotNull() & hi_b.isNotNull()
    return (
        F.when(~known, "unknown").when(F.greatest(lo_a, lo_b) <= F.least(hi_a, hi_b), "overlap").otherwise("disjoint")
    )


def vs_baselines(runs: DataFrame) -> DataFrame:
    """Every run against the baseline run with the most questions of each baseline provider."""
    best = top_per_group(
        runs.where(is_baseline(F.col("provider"))), ["provider"], [F.desc("n_questions"), F.asc("run_id")]
    ).select(F.col("provider").alias("baseline"), F.col("composite_parity").alias("_base"))
    # at most one row per baseline provider, two in all
    d = runs.select("run_id", "composite_parity").crossJoin(F.broadcast(best))
    delta = F.col("composite_parity") - F.col("_base")
    return d.select(
        "run_id", "baseline", delta.alias("delta"),
        F.when(F.col("_base") > 0, delta / F.col("_base") * 100).otherwise(F.lit(0.0)).alias("pct"),
    )


# --- questions --------------------------------------------------------------------


def topic_metrics(scored: DataFrame) -> DataFrame:
    """Scores per run and topic, each over its own non-NULL rows."""
    diff = F.abs(F.col("model_refusal_rate") - F.col("human_refusal_rate"))
    return (
        scored.where("topic IS NOT NULL")
        .groupBy("run_id", "topic")
        .agg(
            F.avg("parity").alias("sps"),
            F.count("parity").alias("n"),
            (F.lit(1.0) - F.avg("jsd")).alias("p_dist"),
            ((F.lit(1.0) + F.avg("tau")) / 2.0).alias("p_rank"),
            F.greatest(F.lit(0.0), F.lit(1.0) - F.avg(diff)).alias("p_refuse"),
        )
        .where("n > 0")
    )


def topic_replicates(per_run: DataFrame, by: list[str]) -> DataFrame:
    return per_run.groupBy(*by, "topic").agg(
        F.avg("sps").alias("mean"), stddev_or_zero(F.col("sps")).alias("std"), F.count("sps").alias("n_replicates")
    )


def question_rollup(rows: DataFrame) -> DataFrame:
    """Best-sampled row per (dataset, key, family, display name); baselines out, ensembles flagged."""
    d = rows.where("family <> 'baseline'").withColumn("is_ensemble", F.lower("provider").contains("ensemble"))
    return top_per_group(
        d, ["dataset", "key", "family", "display_name", "is_ensemble"], [F.desc("n_samples"), F.asc("run_id")]
    )


def question_summary(rollup: DataFrame) -> DataFrame:
    """Cross-model summary per question from its single-model rows."""
    d = rollup.where(~F.col("is_ensemble")).withColumn(
        "responder", F.concat_ws("/", "family", "display_name")
    ).withColumn("dist", F.map_from_arrays("options", "p_model"))
    pairs = pair_jsd(d, ["dataset", "key"], "responder").groupBy("dataset", "key").agg(
        F.avg("jsd").alias("cross_model_jsd_mean"), F.max("jsd").alias("cross_model_jsd_max")
    )
    picks = (
        d.withColumn("modal", D.top_option(F.col("options"), F.col("p_model")))
        .where("modal IS NOT NULL")
        .groupBy("dataset", "key", "modal")
        .agg(F.count("*").alias("_c"))
        .groupBy("dataset", "key")
        .agg(F.min(F.struct(-F.col("_c"), "modal")).getField("modal").alias("consensus_option"))
    )
    rates = d.groupBy("dataset", "key").agg(
        F.count("*").alias("n_models"),
        F.when(
            F.count("model_refusal_rate") >= 2, F.max("model_refusal_rate") - F.min("model_refusal_rate")
        ).alias("refusal_rate_spread"),
        F.avg(F.round("jsd", 6)).alias("jsd_to_human_mean"),
        F.first(D.top_option(F.col("options"), F.col("p_human"))).alias("human_top_option"),
    )
    return rates.join(pairs, ["dataset", "key"], "left").join(picks, ["dataset", "key"], "left")


def question_index(summary: DataFrame) -> DataFrame:
    """Position of a question in its dataset: most divergent first, unknown last, then the key."""
    return rank_within(
        summary.withColumn("_s", F.round("cross_model_jsd_mean", 6)), ["dataset"], "_s", ["key"], "position", bounds=(0, 1)
    ).drop("_s")


def policy_redact(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Blank the human side where the tier forbids it or the question is private."""
    d = with_tier(rows, policies).withColumn("is_holdout", X.is_private(F.col("dataset"), F.col("key")))
    hide = ~F.col("tier").isin("full", "gated") | F.col("is_holdout")
    for c in ("human_refusal_rate", "p_human"):
        if c in rows.columns:
            d = d.withColumn(c, F.when(~hide, F.col(c)))
    return d


def with_tier(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Redistribution tier of the base dataset; unknown datasets get the most careful one."""
    p = policies.select(F.col("dataset").alias("_d"), "tier")
    return (
        rows.join(p, X.base_dataset(F.col("dataset")) == F.col("_d"), "left")
        .withColumn("tier", F.coalesce("tier", F.lit(T.DEFAULT_TIER)))
        .drop("_d")
    )


def route(tier: Column) -> Column:
    """Where an artifact goes: public, restricted, or nowhere."""
    return F.when(tier == "full", "public").when(tier == "gated", "restricted")


def rehydrate_text(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Take the registered text when it is longer than the stored one."""
    r = registry.select("dataset", "key", F.col("text").alias("_t"))
    own = F.coalesce("text", F.lit(""))
    return (
        rows.join(r, ["dataset", "key"], "left")
        .withColumn("text", F.when(F.length("_t") > F.length(own), F.col("_t")).otherwise(F.col("text")))
        .drop("_t")
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs side by side on shared questions: modal options, flip flag, JSD difference."""

    def side(df, s):
        return df.select(
            "key", D.top_option(F.col("options"), F.col("p_model")).alias(f"{s}_modal"), F.col("jsd").alias(f"{s}_jsd")
        )

    d = side(a, "a").join(side(b, "b"), "key")
    return d.withColumn("delta_jsd", F.col("a_jsd") - F.col("b_jsd")).withColumn(
        "flip", ~F.col("a_modal").eqNullSafe(F.col("b_modal"))
    )


def jsd_histogram(scored: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    cell = F.least(F.floor(F.col("jsd") * bins), F.lit(bins - 1)).cast("bigint")
    return scored.groupBy(*by, cell.alias("bin")).agg(F.count("*").alias("n"))


def best_worst_questions(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest and k highest JSD questions of each run, ties by key."""
    low = top_per_group(scored, ["run_id"], [F.asc("jsd"), F.asc("key")], k, "place").withColumn("side", F.lit("best"))
    high = top_per_group(scored, ["run_id"], [F.desc("jsd"), F.asc("key")], k, "place").withColumn("side", F.lit("worst"))
    return low.unionByName(high)


def outcome_accuracy(results: DataFrame) -> DataFrame:
    """Accuracy overall, by true outcome and by sector, in one grouping-sets pass."""
    hit = (F.col("verdict") == F.col("truth")).cast("double")
    return results.groupingSets([[], ["truth"], ["sector"]], "truth", "sector").agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy")
    )


def confusion(results: DataFrame) -> DataFrame:
    kinds = ["success", "mixed", "failure"]
    return results.where(F.col("verdict").isin(kinds)).groupBy("truth").pivot("verdict", kinds).count().fillna(0)


def backfill(rows: DataFrame) -> DataFrame:
    """Renormalise distributions that are off and replace stored metrics that are off.

    ``rows``: stored jsd, tau, parity and the arrays p_human, p_model. Values within
    tolerance keep their stored form.
    """
    from .scoring import score_pairs

    def fixed(c):
        s = D.total(F.col(c))
        off = (s > 0) & (F.abs(s - 1) > T.DIST_SUM_TOL)
        return F.when(off, F.transform(c, lambda x: F.round(x / s, 4))).otherwise(F.col(c)), off

    h, h_off = fixed("p_human")
    m, m_off = fixed("p_model")
    d = rows.withColumn("_fixed", h_off.cast("int") + m_off.cast("int"))
    d = d.withColumn("p_human", h).withColumn("p_model", m)
    for c in ("jsd", "tau", "parity"):
        d = d.withColumnRenamed(c, f"_{c}")
    d = score_pairs(d)
    keep = lambda c, tol: F.when(F.abs(F.col(f"_{c}") - F.round(c, 6)) <= tol, F.col(f"_{c}")).otherwise(F.round(c, 6))
    d = d.withColumn("jsd", keep("jsd", T.METRIC_TOL)).withColumn("tau", keep("tau", T.METRIC_TOL))
    d = d.withColumn("parity", D.parity(F.col("jsd"), F.col("tau")))
    d = d.withColumn("parity", keep("parity", T.PARITY_TOL))
    for c in ("jsd", "tau", "parity"):
        d = d.withColumn(f"{c}_updated", (F.col(c) != F.col(f"_{c}")).cast("int")).drop(f"_{c}")
    return d.withColumnRenamed("_fixed", "dist_normalised")
