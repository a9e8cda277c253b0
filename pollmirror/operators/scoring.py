"""From answers and samples to scored questions and scored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as X
from .ranking import approx_quantiles, quantiles


def question_distributions(answers: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Long answers -> one row per ``by`` with sorted ``options``, ``counts``, ``n``, ``p_human``.

    The first aggregation combines map-side, so a hot question is reduced to one row
    per option before anything is gathered.
    """
    measure = F.count("*") if weight is None else F.sum(weight)
    per_option = answers.groupBy(*by, "option").agg(measure.alias("_n"))
    rows = per_option.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("option", "_n"))).alias("_o"), F.sum("_n").alias("n")
    )
    return rows.where("n > 0").select(
        *by,
        F.col("_o.option").alias("options"),
        F.col("_o._n").alias("counts"),
        "n",
        F.transform(F.col("_o._n"), lambda c: c / F.col("n")).alias("p_human"),
    )


def sample_distribution(samples: DataFrame, questions: DataFrame) -> DataFrame:
    """Samples -> shares over the declared options with refusals, failures and usage.

    ``samples``: run_id, dataset, key, sample_no, selected_option, raw_text, refusal,
    in_tok, out_tok. ``questions``: dataset, key, options, p_human.
    """
    answered = ~F.col("refusal")
    has_text = answered & (F.coalesce(F.length("raw_text"), F.lit(0)) > 0)
    per_option = samples.groupBy("run_id", "dataset", "key", "selected_option").agg(
        F.count_if(answered).alias("n"),
        F.count_if(F.col("refusal")).alias("refused"),
        F.sum("in_tok").alias("in_tok"),
        F.sum("out_tok").alias("out_tok"),
        F.count("in_tok").alias("calls"),
        F.min(F.when(has_text, F.struct("sample_no", "raw_text"))).alias("first"),
    )
    per_question = per_option.groupBy("run_id", "dataset", "key").agg(
        F.collect_list(
            F.when(F.col("selected_option").isNotNull(), F.struct("selected_option", "n"))
        ).alias("_o"),
        # apart from the counts, so that scores without texts carry none
        F.collect_list(F.when(F.col("first").isNotNull(), F.struct("selected_option", "first"))).alias("_f"),
        F.sum("n").alias("answered"),
        F.sum("refused").alias("refused"),
        F.sum("in_tok").alias("in_tok"),
        F.sum("out_tok").alias("out_tok"),
        F.sum("calls").alias("calls"),
    )
    joined = per_question.join(questions, ["dataset", "key"])
    total = F.greatest(F.col("answered") + F.col("refused"), F.lit(1))
    weights = F.map_from_arrays(F.col("_o.selected_option"), F.col("_o.n"))
    valid = F.filter("_o", lambda o: F.array_contains("options", o["selected_option"]))
    valid_n = F.aggregate(valid, F.lit(0).cast("bigint"), lambda a, o: a + o["n"])
    first = F.array_min(
        F.transform(
            F.filter("_f", lambda o: F.array_contains("options", o["selected_option"])),
            lambda o: F.struct(
                o["first"]["sample_no"].alias("no"),
                o["first"]["raw_text"].alias("text"),
                o["selected_option"].alias("option"),
            ),
        )
    )
    return (
        joined.withColumn("_w", weights)
        .withColumn("p_raw", F.transform(D.align(F.col("options"), F.col("_w")), lambda x: x / total))
        .withColumn("n_samples", F.col("answered") + F.col("refused"))
        .withColumn("n_parse_failures", F.col("answered") - valid_n)
        .withColumn("model_refusal_rate", F.col("refused") / total)
        .withColumn("_first", first)
        .withColumn("raw_text", F.col("_first.text"))
        .withColumn("raw_option", F.col("_first.option"))
        .withColumn("in_tok", F.when(F.col("calls") > 0, F.coalesce("in_tok", F.lit(0))))
        .withColumn("out_tok", F.when(F.col("calls") > 0, F.coalesce("out_tok", F.lit(0))))
        .drop("_o", "_f", "_w", "_first", "answered", "refused")
    )


def human_refusal(options: Column, p: Column) -> Column:
    """Mass on options worded as a refusal or as not knowing."""
    return D.total(F.zip_with(options, p, lambda o, x: F.when(X.is_refusal_option(o), x).otherwise(0.0)))


def score_pairs(df: DataFrame, p: str = "p_human", q: str = "p_model") -> DataFrame:
    """Add jsd, tau and parity for two aligned probability arrays."""
    return (
        df.withColumn("jsd", D.jsd(F.col(p), F.col(q)))
        .withColumn("tau", D.tau_b(F.col(p), F.col(q)))
        .withColumn("parity", D.parity(F.col("jsd"), F.col("tau")))
    )


def question_score(distributions: DataFrame, survey: str | None = None) -> DataFrame:
    """Renormalise the model side over the declared options and score every question."""
    d = distributions.withColumn("p_model", D.shares_or_uniform(F.col("p_raw"))).withColumn(
        "human_refusal_rate", human_refusal(F.col("options"), F.col("p_human"))
    )
    if survey:
        d = d.withColumn("temporal_year", X.wave_year(F.col(survey)))
    return score_pairs(d)


def p_refuse_question(options: Column, p_human: Column, p_model: Column) -> Column:
    """1 - |difference of the exact Refused option|; NULL when it is not an option."""
    from ..functions.tables import REFUSED

    return F.when(
        F.array_contains(options, REFUSED),
        F.lit(1.0) - F.abs(D.value_of(options, p_human, REFUSED) - D.value_of(options, p_model, REFUSED)),
    )


def refusal_calibration(model: Column, human: Column) -> Column:
    """Aggregate: 1 - mean absolute difference, clamped; 1 for no rows."""
    return F.coalesce(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.avg(F.abs(model - human)))), F.lit(1.0)
    )


def subgroup_consistency(score: Column) -> Column:
    """Aggregate: 1 - population coefficient of variation, clamped; 1 below two groups."""
    mean = F.avg(score)
    return (
        F.when(F.count(score) < 2, F.lit(1.0))
        .when(mean == 0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.stddev_pop(score) / mean)))
    )


def run_score(
    scored: DataFrame, by: list[str] | None = None, groups: DataFrame | None = None, median: bool = True, approx: bool = False
) -> DataFrame:
    """Run scores from scored questions; ``groups`` optionally adds p_sub and p_cond per run, ``approx`` takes the median from a sketch."""
    by = by or ["run_id", "dataset"]
    agg = scored.groupBy(*by).agg(
        F.count("*").alias("n_questions"),
        F.avg("jsd").alias("mean_jsd"),
        F.avg("tau").alias("mean_tau"),
        refusal_calibration(F.col("model_refusal_rate"), F.col("human_refusal_rate")).alias("p_refuse"),
    )
    if median:
        q = approx_quantiles(scored, by, "jsd", {"median_jsd": 0.5}) if approx else quantiles(scored, by, "jsd", {"median_jsd": 0.5}, bounds=(0, 1))
        agg = agg.join(q, by)
    agg = (
        agg.withColumn("p_dist", F.lit(1.0) - F.col("mean_jsd"))
        .withColumn("p_rank", (F.lit(1.0) + F.col("mean_tau")) / 2.0)
        .withColumn("composite_parity", D.parity(F.col("mean_jsd"), F.col("mean_tau")))
    )
    parts = {k: F.col(k) for k in ("p_dist", "p_rank", "p_refuse")}
    if groups is not None:
        agg = agg.join(groups, by, "left")
        parts |= {k: F.col(k) for k in ("p_sub", "p_cond") if k in groups.columns}
    return agg.withColumn("sps", D.sps(parts))


def temporal_breakdown(scored: DataFrame) -> DataFrame:
    """Scores per run and survey year, unknown years left out."""
    return (
        scored.where(F.col("temporal_year") > 0)
        .groupBy("run_id", "temporal_year")
        .agg(F.avg("jsd").alias("mean_jsd"), F.avg("tau").alias("_tau"), F.count("*").alias("n_questions"))
        .select(
            "run_id",
            "temporal_year",
            (F.lit(1.0) - F.col("mean_jsd")).alias("p_dist"),
            ((F.lit(1.0) + F.col("_tau")) / 2.0).alias("p_rank"),
            "mean_jsd",
            "n_questions",
        )
    )


def usage_rollup(scored: DataFrame) -> DataFrame:
    """Token sums per run; ``source`` tells whether every question reported usage."""
    return (
        scored.groupBy("run_id")
        .agg(
            F.sum("in_tok").alias("input_tokens"),
            F.sum("out_tok").alias("output_tokens"),
            F.sum(F.when(F.col("calls") > 0, F.col("calls"))).alias("call_count"),
            F.count_if(F.col("calls") > 0).alias("_with"),
            F.count("*").alias("_all"),
        )
        .where("_with > 0")
        .select(
            "run_id",
            "input_tokens",
            "output_tokens",
            "call_count",
            F.when(F.col("_with") == F.col("_all"), "measured").otherwise("partial").alias("source"),
        )
    )


def parse_failure_rate(scored: DataFrame) -> DataFrame:
    """Failures over samples plus failures, per run."""
    fails, n = F.sum("n_parse_failures"), F.sum("n_samples")
    return scored.groupBy("run_id").agg(
        F.when(n + fails > 0, fails / (n + fails)).otherwise(F.lit(0.0)).alias("parse_failure_rate")
    )


def question_set_hash(scored: DataFrame, by: list[str]) -> DataFrame:
    """sha256 over the sorted question keys joined by newlines.

    The hash is defined over one string holding every key of a run, so that string
    exists once per run by definition; only the keys travel, one array per run.
    """
    return scored.groupBy(*by).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("key")), "\n"), 256).alias("question_set_hash"),
        F.count("*").alias("n_keys"),
    )


def baselines(questions: DataFrame) -> DataFrame:
    """Question rows under four baselines: uniform, first listed option, modal option, population."""
    n = F.size("options")
    top = D.top_option(F.col("options"), F.col("p_human"))
    kinds = F.array(
        F.struct(F.lit("uniform").alias("name"), F.transform("options", lambda o: F.lit(1.0) / n).alias("p")),
        F.struct(
            F.lit("first").alias("name"),
            F.transform("options", lambda o, i: F.when(i == 0, 1.0).otherwise(0.0)).alias("p"),
        ),
        F.struct(
            F.lit("mode").alias("name"), F.transform("options", lambda o: F.when(o == top, 1.0).otherwise(0.0)).alias("p")
        ),
        F.struct(F.lit("population").alias("name"), F.col("p_human").alias("p")),
    )
    return (
        questions.withColumn("_b", F.explode(kinds))
        .withColumn("baseline", F.col("_b.name"))
        .withColumn("p_raw", F.col("_b.p"))
        .drop("_b")
    )


def population_baseline(questions: DataFrame, population: DataFrame) -> DataFrame:
    """The population distribution found by question text for every row; unknown text -> uniform."""
    known = population.select("text", F.map_from_arrays("options", "p_human").alias("_m"))
    d = questions.join(known, "text", "left")
    aligned = D.align(F.col("options"), F.col("_m"))
    uniform = F.transform("options", lambda o: F.lit(1.0) / F.size("options"))
    return d.withColumn(
        "p_model",
        F.when(F.col("_m").isNull(), uniform).otherwise(
            D.bind(aligned, lambda a: F.coalesce(D.shares(a), a))
        ),
    ).drop("_m")
