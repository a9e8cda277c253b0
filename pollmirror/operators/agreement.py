"""Agreement, frequency and robustness statistics over long answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import special as SP
from ..functions import text as X


def frequency_table(answers: DataFrame, by: list[str], categories: DataFrame | None = None) -> DataFrame:
    """Count and share per category; listed categories keep zeros, others count in the total only."""
    counts = answers.groupBy(*by, "option").agg(F.count("*").alias("count"))
    total = counts.groupBy(*by).agg(F.sum("count").alias("total"))
    if categories is not None:
        # the category list is per group (or global): a bounded cross of groups and categories
        keys = [c for c in categories.columns if c in by]
        wanted = total.join(categories, keys) if keys else total.crossJoin(categories)
        d = wanted.join(counts, [*by, "option"], "left").fillna(0, ["count"])
    else:
        d = counts.join(total, by)
    return d.withColumn("share", F.col("count") / F.col("total"))


def chi2_gof(counts: DataFrame, by: list[str], count: str = "count", expected: str | None = None) -> DataFrame:
    """Goodness of fit per group, against the uniform distribution unless ``expected`` is given."""
    counts = counts.select(*by, count, *([expected] if expected else []))
    total = counts.groupBy(*by).agg(F.sum(count).alias("total"), F.count("*").alias("k"))
    e = F.col(expected) if expected else F.col("total") / F.col("k")
    d = counts.join(total, by).groupBy(*by, "total", "k").agg(
        F.sum((F.col(count) - e) * (F.col(count) - e) / e).alias("statistic"), F.min(e).alias("min_expected")
    )
    df = F.col("k") - 1
    return d.select(
        *by, "statistic", df.cast("bigint").alias("df"),
        F.when(df > 0, SP.chi2_tail(F.col("statistic"), df)).otherwise(F.lit(1.0)).alias("p_value"),
        F.when((F.col("total") > 0) & (df > 0), F.sqrt(F.col("statistic") / (F.col("total") * df))).otherwise(F.lit(0.0)).alias("cramers_v"),
        (F.col("min_expected") < 5).alias("small_expected"),
    )


def kendall_w(rankings: DataFrame, by: list[str]) -> DataFrame:
    """Concordance of raters over items; ``rankings``: by, rater, item, rank."""
    n = rankings.groupBy(*by).agg(F.countDistinct("rater").alias("n"))
    sums = rankings.groupBy(*by, "item").agg(F.sum("rank").alias("_r"))
    d = sums.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_s2")
    ).join(n, by)
    centre = F.col("n") * (F.col("k") + 1) / 2.0
    s = F.col("_s2") - centre * 2 * F.col("_s") + F.col("k") * centre * centre
    w = s * 12.0 / (F.col("n") * F.col("n") * (F.col("k") * F.col("k") * F.col("k") - F.col("k")))
    d = d.where("k >= 2").withColumn("w", w)
    chi2 = F.col("n") * (F.col("k") - 1) * F.col("w")
    return d.select(*by, "w", chi2.alias("chi_squared"), SP.chi2_tail(chi2, F.col("k") - 1).alias("p_value"), "n", "k")


def borda(rankings: DataFrame, by: list[str]) -> DataFrame:
    """Mean of k - rank per item, best first, ties alphabetical."""
    k = rankings.groupBy(*by).agg(F.countDistinct("item").alias("_k"))
    return (
        rankings.join(k, by).groupBy(*by, "item").agg(F.avg(F.col("_k") - F.col("rank")).alias("score"))
        .orderBy(*by, F.desc("score"), F.asc("item"))
    )


def krippendorff_alpha(ratings: DataFrame, by: list[str], item: str = "item", value: str = "value", level: str = "nominal") -> DataFrame:
    """Krippendorff's alpha per group; missing ratings are simply absent rows.

    No rating pairs are built. Nominal disagreement needs only the squared counts per
    item and value. Interval disagreement is a variance; ordinal is the same on mid-ranks,
    because the ordinal distance of two values is the squared difference of their mid-ranks.
    """
    counts = ratings.where(F.col(value).isNotNull()).groupBy(*by, item, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(*by, item).agg(F.sum("_n").alias("_m")).where("_m >= 2")
    d = counts.join(sizes, [*by, item])
    margins = d.groupBy(*by, "_v").agg(F.sum("_n").alias("_c"))
    if level == "nominal":
        per_item = d.groupBy(*by, item, "_m").agg(F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_same"))
        obs = per_item.groupBy(*by).agg(
            F.sum(F.col("_m")).alias("n"), F.sum(F.col("_same") / (F.col("_m") - 1)).alias("_diag"), F.count("*").alias("n_items")
        )
        exp = margins.groupBy(*by).agg(F.sum(F.col("_c") * F.col("_c")).alias("_sq"), F.count("*").alias("n_values"))
        j = obs.join(exp, by)
        d_o = (F.col("n") - F.col("_diag")) / F.col("n")
        d_e = (F.col("n") * F.col("n") - F.col("_sq")) / (F.col("n") * (F.col("n") - 1))
    else:
        if level == "ordinal":
            w = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
            scores = margins.withColumn("_x", F.sum("_c").over(w) - F.col("_c") / 2.0).select(*by, "_v", "_x")
            d = d.join(scores, [*by, "_v"])
            margins = margins.join(scores, [*by, "_v"])
        else:
            d, margins = (t.withColumn("_x", F.col("_v").cast("double")) for t in (d, margins))
        x, n = F.col("_x"), F.col("_n")
        per_item = d.groupBy(*by, item, "_m").agg(F.sum(n * x).alias("_s"), F.sum(n * x * x).alias("_s2"))
        obs = per_item.groupBy(*by).agg(
            F.sum("_m").alias("n"),
            F.sum((F.col("_m") * F.col("_s2") - F.col("_s") * F.col("_s")) * 2.0 / (F.col("_m") - 1)).alias("_o"),
            F.count("*").alias("n_items"),
        )
        c = F.col("_c")
        exp = margins.groupBy(*by).agg(F.sum(c * x).alias("_e1"), F.sum(c * x * x).alias("_e2"), F.count("*").alias("n_values"))
        j = obs.join(exp, by)
        d_o = F.col("_o") / F.col("n")
        d_e = (F.col("n") * F.col("_e2") - F.col("_e1") * F.col("_e1")) * 2.0 / (F.col("n") * (F.col("n") - 1))
    # identical values leave only rounding noise in the expected disagreement
    alpha = F.when(F.col("n_values") == 1, F.lit(1.0)).otherwise(F.lit(1.0) - d_o / d_e)
    return j.where("n >= 2").select(*by, alpha.alias("alpha"), F.col("n").cast("bigint").alias("n"), "n_items", "n_values")


def alpha_level(alpha: Column) -> Column:
    return F.when(alpha >= 0.8, "strong").when(alpha >= 0.6, "moderate").when(alpha >= 0.4, "weak").otherwise("none")


def two_places(x: Column) -> Column:
    """A number as text with two decimals, halves away from below."""
    h = F.floor(F.round(x * 100.0, 9) + 0.5)
    return F.concat(F.when(h < 0, "-").otherwise(""), F.floor(F.abs(h) / 100), F.lit("."), F.lpad((F.abs(h) % 100).cast("string"), 2, "0"))


def model_convergence(ratings: DataFrame, by: list[str], level: str = "nominal") -> DataFrame:
    """Per question: alpha, its level, every model's shares, the majority's top choice, the models that differ, and the verdict in words.

    ``ratings``: by, rater, item, value. Ties take the alphabetically first value. ``per_model`` has an entry per
    model: rater, n, top and its values with count and share. Every row also bears the report over all questions:
    the mean alpha with its level and how many questions converge (0.6 or more) or diverge (below 0.4).
    """
    alpha = krippendorff_alpha(ratings, by, level=level)
    counts = ratings.where("value IS NOT NULL").groupBy(*by, "rater", "value").agg(F.count("*").alias("_n"))
    tops = counts.groupBy(*by, "rater").agg(
        F.min(F.struct(-F.col("_n"), "value")).getField("value").alias("top"), F.sum("_n").alias("n_ratings"),
        F.array_sort(F.collect_list(F.struct("value", F.col("_n").alias("count")))).alias("_values"),
    )
    votes = tops.groupBy(*by, "top").agg(F.count("*").alias("_n"))
    majority = votes.groupBy(*by).agg(F.min(F.struct(-F.col("_n"), "top")).getField("top").alias("majority"))
    values = F.transform("_values", lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"), (v["count"] / F.col("n_ratings")).alias("share")))
    differs = F.col("top") != F.col("majority")
    models = (
        tops.join(majority, by).groupBy(*by, "majority").agg(
            F.count_if(differs).alias("n_divergent"), F.count("*").alias("n_models"),
            F.array_sort(F.collect_list(F.when(differs, F.col("rater")))).alias("divergent_models"),
            F.array_sort(F.collect_list(F.struct("rater", F.col("n_ratings").alias("n"), "top", values.alias("values")))).alias("per_model"),
        )
    )
    found = alpha.withColumn("level", alpha_level(F.col("alpha"))).join(models, by)
    found = found.withColumn("top_choice_agreement", F.col("n_divergent") == 0).withColumn("interpretation", convergence_verdict())
    # every question that has an alpha has a majority, and both joins leave out questions without a name
    overall = alpha.agg(F.avg("alpha").alias("overall_alpha"), F.count_if(F.col("alpha") >= 0.6).alias("n_convergent"), F.count_if(F.col("alpha") < 0.4).alias("n_not_convergent"))
    return found.crossJoin(F.broadcast(overall)).withColumn("overall_level", alpha_level(F.col("overall_alpha")))


def convergence_verdict() -> Column:
    """What alpha, the majority and the divergent models of a question say, in words."""
    start = lambda word: F.concat(F.lit(f"{word} convergence (alpha="), two_places(F.col("alpha")), F.lit("). "))
    who = F.array_join("divergent_models", ", ")
    who = F.when(who == "", "No model").otherwise(F.concat(F.lit("Models "), who))
    return (
        F.when(F.col("level") == "strong", F.concat(start("Strong"), F.lit("The models agree: "), "majority", F.lit(" is the top choice.")))
        .when(F.col("level") == "moderate", F.concat(start("Moderate"), F.lit("The models mostly agree on "), "majority", F.lit(", with some variation.")))
        .when(F.col("level") == "weak", F.concat(start("Weak"), F.lit("To be read with caution. "), who, F.lit(" differ from the majority.")))
        .otherwise(F.concat(start("No"), F.lit("The choice of model decides this finding. "), who, F.lit(" differ. Not reliable.")))
    )


def robustness(variants: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of each persona's variants equal to ``value``, averaged; ``variants``: by, persona, response."""
    per = variants.groupBy(*by, "persona").agg(
        F.avg((F.col("response") == value).cast("double")).alias("_r"), F.count("*").alias("_k")
    )
    from .ranking import quantiles

    d = per.groupBy(*by).agg(F.avg("_r").alias("robustness"), F.count("*").alias("n_personas"))
    d = d.join(quantiles(per.withColumn("_k", F.col("_k").cast("double")), by, "_k", {"median_k": 0.5}), by)
    r = F.col("robustness")
    label = F.when(r >= 0.8, "robust").when(r >= 0.6, "moderately robust").when(r >= 0.4, "sensitive").otherwise("fragile")
    return d.withColumn("median_k", F.floor("median_k")).withColumn("label", label)


def silhouette(points: DataFrame, by: list[str]) -> DataFrame:
    """Mean silhouette over squared Euclidean distances of one-hot answers.

    ``points``: by, persona, question, answer, label, each persona answering every
    question. The distance of two personas is twice their mismatches, so the mean distance
    to a cluster follows from the cluster's answer counts; no pair of personas is formed.
    A singleton has a = 0.
    """
    people = points.select(*by, "persona", "label").distinct()
    sizes = people.groupBy(*by, "label").agg(F.count("*").alias("_size"))
    counts = points.groupBy(*by, "question", "answer", "label").agg(F.count("*").alias("_n"))
    matches = (
        points.select(*by, "persona", "question", "answer", F.col("label").alias("_own"))
        .join(counts, [*by, "question", "answer"])
        .groupBy(*by, "persona", "_own", "label").agg(F.sum("_n").alias("_match"))
    )
    n_q = points.groupBy(*by).agg(F.countDistinct("question").alias("_q"))
    # one row per persona and cluster; the number of clusters is a small parameter
    cells = people.withColumnRenamed("label", "_own").join(sizes, by).join(n_q, by)
    d = cells.join(matches, [*by, "persona", "_own", "label"], "left").fillna(0, ["_match"])
    total = (F.col("_q") * F.col("_size") - F.col("_match")) * 2.0
    own = F.col("label") == F.col("_own")
    per = d.groupBy(*by, "persona").agg(
        F.max(F.when(own, F.when(F.col("_size") <= 1, 0.0).otherwise(total / (F.col("_size") - 1)))).alias("_a"),
        F.min(F.when(~own, total / F.col("_size"))).alias("_b"),
    )
    top = F.greatest("_a", "_b")
    s = F.when(F.col("_b").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("_b") - F.col("_a")) / top)
    return per.groupBy(*by).agg(F.avg(s).alias("silhouette"), F.count("*").alias("n_personas"))


def concentration(rows: DataFrame, by: list[str], threshold: float = 0.99) -> DataFrame:
    """Mean entropy, KL from uniform, concentration and the share of near-degenerate questions."""
    h = D.entropy(F.col("p_model"))
    k = F.size("p_model")
    d = rows.where(k > 1).withColumn("_h", h).withColumn("_max", F.log2(k.cast("double")))
    return d.groupBy(*by).agg(
        F.avg("_h").alias("entropy"), F.avg(F.col("_max") - F.col("_h")).alias("kl_uniform"),
        F.avg(F.lit(1.0) - F.col("_h") / F.col("_max")).alias("concentration"),
        F.avg((F.array_max("p_model") >= threshold).cast("double")).alias("degenerate_share"),
    )


def core_sample(questions: DataFrame, groups: DataFrame, per_stratum: int, sensitive_share: float = 0.3, seed: str = "core") -> DataFrame:
    """Hash-ordered pick per topic and entropy band, sensitive questions first up to their share.

    ``questions``: key, topic, p_human. ``groups``: key, p (one distribution per group).
    Sensitivity is the between-group variance of the shares, the top third of it counts.
    """
    from .ranking import quantiles, top_per_group

    shares = groups.select("key", F.posexplode("p").alias("pos", "x"))
    variance = shares.groupBy("key", "pos").agg(F.var_pop("x").alias("v")).groupBy("key").agg(F.avg("v").alias("variance"))
    h = D.entropy(F.col("p_human"))
    d = questions.withColumn("entropy", h).withColumn(
        "band", F.when(F.col("entropy") < 1.0, "low").when(F.col("entropy") <= 1.5, "medium").otherwise("high")
    )
    d = d.join(variance, "key", "left").fillna(0.0, ["variance"])
    cut = quantiles(d, [], "variance", {"_cut": 2.0 / 3.0})
    d = d.crossJoin(F.broadcast(cut)).withColumn("sensitive", F.col("variance") >= F.col("_cut")).drop("_cut")
    d = d.withColumn("_u", X.uniform(F.lit(seed), F.col("key")))
    quota = int(-(-per_stratum * sensitive_share // 1))
    chosen = top_per_group(d.where("sensitive"), ["topic", "band"], [F.asc("_u")], quota)
    rest = d.join(chosen.select("key"), "key", "left_anti")
    n = chosen.groupBy("topic", "band").agg(F.count("*").alias("_have"))
    fill = top_per_group(rest, ["topic", "band"], [F.asc("_u")], per_stratum, "_rn").join(n, ["topic", "band"], "left")
    fill = fill.where(F.col("_rn") <= per_stratum - F.coalesce("_have", F.lit(0))).drop("_rn", "_have")
    return chosen.unionByName(fill).drop("_u")
