"""Conditioned answers: group-level fidelity, consistency and conditioning gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from . import scoring as S


def cond_gain(conditioned: Column, unconditioned: Column) -> Column:
    """JSD the conditioning removed, never negative."""
    return F.greatest(F.lit(0.0), unconditioned - conditioned)


def group_rows(group_human: DataFrame, conditioned: DataFrame, unconditioned: DataFrame) -> DataFrame:
    """Per (run, key, group): both JSDs to the group's own human distribution.

    ``group_human``: key, attribute, group, g_human (map). ``conditioned``: run_id, key,
    group, p_cond (map). ``unconditioned``: run_id, key, options, p_model. Equi joins on
    hashed keys; every side is one row per question cell by now.
    """
    d = conditioned.join(group_human, ["key", "group"]).join(unconditioned, ["run_id", "key"])
    human = D.align(F.col("options"), F.col("g_human"))
    return (
        d.withColumn("_h", human)
        .withColumn("_c", D.shares_or_uniform(D.align(F.col("options"), F.col("p_cond"))))
        .withColumn("jsd_conditioned", D.jsd(F.col("_h"), F.col("_c")))
        .withColumn("jsd_unconditioned", D.jsd(F.col("_h"), F.col("p_model")))
        .drop("_h", "_c")
    )


def demographic_eval(rows: DataFrame) -> DataFrame:
    """Per run and group: p_dist, the unconditioned score, p_cond and the question count."""
    return rows.groupBy("run_id", "attribute", "group").agg(
        (F.lit(1.0) - F.avg("jsd_conditioned")).alias("p_dist"),
        (F.lit(1.0) - F.avg("jsd_unconditioned")).alias("default_score"),
        F.avg(cond_gain(F.col("jsd_conditioned"), F.col("jsd_unconditioned"))).alias("p_cond"),
        F.count("*").alias("n_questions"),
    )


def run_groups(groups: DataFrame, by: list[str]) -> DataFrame:
    """Run-level p_sub and the score-difference form of p_cond, ready to join into run scores."""
    return groups.groupBy(*by).agg(
        S.subgroup_consistency(F.col("p_dist")).alias("p_sub"),
        F.avg(F.greatest(F.lit(0.0), F.col("p_dist") - F.col("default_score"))).alias("p_cond"),
    )


def flatten(nested: DataFrame, column: str = "demographic_breakdown") -> DataFrame:
    """attribute -> list of groups into flat rows."""
    keep = [c for c in nested.columns if c != column]
    return (
        nested.select(*keep, F.explode(column).alias("_attr", "_groups"))
        .select(*keep, F.explode("_groups").alias("g"))
        .select(*keep, "g.*")
    )


def best_worst_group(groups: DataFrame) -> DataFrame:
    """Best and worst group per run and attribute by p_dist."""
    return groups.groupBy("run_id", "attribute").agg(
        F.max(F.struct("p_dist", "group")).alias("_b"), F.min(F.struct("p_dist", "group")).alias("_w")
    ).select(
        "run_id", "attribute", F.col("_b.group").alias("best"), F.col("_b.p_dist").alias("best_p_dist"),
        F.col("_w.group").alias("worst"), F.col("_w.p_dist").alias("worst_p_dist"),
    )


def heatmap(groups: DataFrame, runs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """run x group cells of p_dist as one wide row per run."""
    wide = groups.groupBy("run_id", "attribute")
    wide = (wide.pivot("group", columns) if columns else wide.pivot("group")).agg(F.max("p_dist"))
    return wide.join(runs.select("run_id", "sps"), "run_id")
