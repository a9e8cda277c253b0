"""Blends of several runs over the questions they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring as S
from .ranking import quantiles, top_per_group


def shared_by_all(rows: DataFrame, by: list[str], member: str, n_members: DataFrame | int) -> DataFrame:
    """Rows of the keys every member answered."""
    counts = rows.groupBy(*by).agg(F.countDistinct(member).alias("_n"))
    if isinstance(n_members, int):
        keys = counts.where(F.col("_n") == n_members)
    else:
        shared = [c for c in n_members.columns if c in by]
        keys = counts.join(n_members, shared).where(F.col("_n") == F.col("n_members"))
    return rows.join(keys.select(*by), by, "left_semi")


def blend(rows: DataFrame, weights: DataFrame, by: list[str], member: str = "model") -> DataFrame:
    """Weighted mean of the members' distributions per question, rescored.

    ``rows`` hold aligned ``options``, ``p_human`` and ``p_model``; weights are normalised
    over the members. One option row per member and option is summed map-side, so nothing
    but partial sums is shuffled.
    """
    total = weights.groupBy(*[c for c in weights.columns if c not in (member, "weight")]).agg(
        F.sum("weight").alias("_wt")
    )
    keys = [c for c in weights.columns if c not in (member, "weight")]
    w = weights.join(total, keys) if keys else weights.crossJoin(F.broadcast(total))
    w = w.withColumn("_w", F.col("weight") / F.col("_wt")).drop("weight", "_wt")
    d = rows.join(w, [*keys, member])
    options = d.select(
        *by, "_w", F.posexplode(F.arrays_zip("options", "p_human", "p_model")).alias("pos", "z")
    )
    sums = options.groupBy(*by, "pos").agg(
        F.first("z.options").alias("option"),
        F.first("z.p_human").alias("h"),
        F.sum(F.col("_w") * F.col("z.p_model")).alias("m"),
    )
    dist = (
        sums.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "option", "h", "m"))).alias("_o"))
        .select(
            *by, F.col("_o.option").alias("options"), F.col("_o.h").alias("p_human"), F.col("_o.m").alias("p_model")
        )
    )
    side = d.groupBy(*by).agg(
        F.sum("n_samples").alias("n_samples"),
        F.sum("n_parse_failures").alias("n_parse_failures"),
        F.sum(F.col("_w") * F.col("model_refusal_rate")).alias("model_refusal_rate"),
        F.first("human_refusal_rate").alias("human_refusal_rate"),
    )
    return S.score_pairs(dist).join(side, by)


def blend_scores(blended: DataFrame, by: list[str]) -> DataFrame:
    """Blend-level scores; the median is the upper middle value."""
    agg = S.run_score(blended, by, median=False)
    upper = quantiles(blended, by, "jsd", {"median_jsd": 0.5}, bounds=(0, 1), higher=True)
    return agg.join(upper, by)


def oracle_pick(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The lowest-JSD model per question, earlier in ``order`` on a tie."""
    return top_per_group(rows, by, [F.asc("jsd"), F.asc(order)])


def best_run(runs: DataFrame, scored: DataFrame, by: list[str]) -> DataFrame:
    """Best run per group after dropping runs whose JSD hardly varies."""
    varied = scored.groupBy("run_id").agg(F.var_pop("jsd").alias("jsd_var")).where("jsd_var >= 1e-10")
    return top_per_group(
        runs.join(varied.select("run_id"), "run_id", "left_semi"),
        by, [F.desc("sps"), F.desc("n_questions"), F.asc("run_id")],
    )


def blend_delta(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """How many shared questions got better, worse or stayed the same from ``b`` to ``a``."""
    keys = [*by, "key"]
    d = a.select(*keys, F.col("jsd").alias("_a")).join(b.select(*keys, F.col("jsd").alias("_b")), keys)
    diff = F.col("_a") - F.col("_b")
    return d.groupBy(*by).agg(
        F.count_if(diff < 0).alias("improved"), F.count_if(diff > 0).alias("worsened"),
        F.count_if(F.abs(diff) < 1e-10).alias("tied"), F.count("*").alias("n"), F.avg(diff).alias("mean_delta"),
    )
