"""Pairwise comparison of distributions inside a group, split into bounded cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D

CELL_ROWS = 64


def _union_jsd(a: Column, b: Column) -> Column:
    """JSD of two maps over the union of their options."""
    return D.bind(
        F.array_union(F.map_keys(a), F.map_keys(b)), lambda o: D.jsd(D.align(o, a), D.align(o, b))
    )


def pair_jsd(dists: DataFrame, by: list[str], item: str, dist: str = "dist", extra: list[str] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """JSD of every pair ``item_a < item_b`` sharing a ``by`` group.

    A group of n rows is cut into ceil(n / cell_rows) cells. Every pair of cells is one row that
    holds both, so no task ever holds more than two cells of a hot group, and a group of one cell,
    the usual case, is gathered once and never joined. Callers fold the pairs at once; the
    partial aggregate runs where they are made and only its sums are shuffled. Pair results themselves are the wanted output
    (a model x model matrix), so the comparisons cannot be avoided, only spread.
    """
    extra = extra or []
    cols = [item, dist, *extra]
    sizes = dists.where(F.col(item).isNotNull()).groupBy(*by).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("_cells"))
    d = dists.where(F.col(item).isNotNull()).select(*by, *cols).join(sizes, by)
    d = d.withColumn("_own", F.pmod(F.xxhash64(item), F.col("_cells")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("_cells") - 1),
        lambda c: F.struct(F.least("_own", c).alias("_ci"), F.greatest("_own", c).alias("_cj")),
    )
    d = d.withColumn("_m", F.explode(meets)).select(*by, "_m._ci", "_m._cj", F.struct("_own", *cols).alias("_r"))
    cells = d.groupBy(*by, "_ci", "_cj").agg(F.collect_list("_r").alias("_rows"))
    one = cells.withColumn("_a", F.explode("_rows"))
    # within a cell every pair once; between two cells only pairs across
    after = F.filter("_rows", lambda r: (F.col(f"_a.{item}") < r[item]) & ((F.col("_ci") == F.col("_cj")) | (F.col("_a._own") != r["_own"])))
    two = one.withColumn("_b", F.explode(after))
    ends = [F.col(f"_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in [item, *extra]]
    return two.select(*by, *ends, _union_jsd(F.col(f"_a.{dist}"), F.col(f"_b.{dist}")).alias("jsd"))


def concordance(dists: DataFrame, run_jsd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean pairwise JSD per (dataset, model pair), and the per-dataset summary.

    ``dists``: dataset, key, model, dist. ``run_jsd``: dataset, model, mean_jsd.
    """
    pairs = (
        pair_jsd(dists, ["dataset", "key"], "model")
        .groupBy("dataset", "model_a", "model_b")
        .agg(F.round(F.avg("jsd"), 6).alias("mean_jsd"), F.count("*").alias("n_shared"))
    )
    summary = (
        pairs.groupBy("dataset")
        .agg(F.avg("mean_jsd").alias("mean_cross_model_jsd"), F.count("*").alias("n_pairs"))
        .join(run_jsd.groupBy("dataset").agg(F.avg("mean_jsd").alias("mean_human_jsd")), "dataset")
    )
    return pairs, summary


def deident_drift(levels: DataFrame) -> DataFrame:
    """Drift over text levels per key: mean pairwise JSD, mean option std, first vs last JSD.

    ``levels``: key, level, dist. Levels of a key form a short fixed ladder.
    """
    pairs = pair_jsd(levels, ["key"], "level")
    ends = levels.groupBy("key").agg(F.min("level").alias("_first"), F.max("level").alias("_last"))
    drift = pairs.join(ends, "key")
    agg = drift.groupBy("key").agg(
        F.avg("jsd").alias("mean_pairwise_jsd"),
        F.max(F.when((F.col("level_a") == F.col("_first")) & (F.col("level_b") == F.col("_last")), F.col("jsd"))).alias(
            "drift_first_last"
        ),
    )
    return agg.join(option_std(levels, ["key"]).select("key", F.col("mean_std").alias("mean_option_std")), "key")


def option_std(dists: DataFrame, by: list[str]) -> DataFrame:
    """Mean over options of the population std of each option's share across rows.

    Rows lacking an option count as 0, so the std follows from n, the sum and the sum of
    squares of the present values: no models x options cross product is built.
    """
    n = dists.groupBy(*by).agg(F.count("*").alias("n_models"))
    options = dists.select(*by, F.explode("dist").alias("option", "p"))
    sums = options.groupBy(*by, "option").agg(
        F.sum("p").alias("_s"), F.var_pop("p").alias("_v"), F.count("*").alias("_c")
    )
    d = sums.join(n, by)
    total, present = F.col("n_models"), F.col("_c")
    mean = F.col("_s") / total
    inner = F.col("_s") / present
    # variance around the overall mean, absent rows contribute mean^2 each
    var = (present * (F.col("_v") + (inner - mean) * (inner - mean)) + (total - present) * mean * mean) / total
    return (
        d.withColumn("_std", F.when(total < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0)))))
        .groupBy(*by, "n_models")
        .agg(F.avg("_std").alias("mean_std"), F.count("*").alias("n_options"))
    )


def contamination_risk(dists: DataFrame, by: list[str], min_models: int = 2) -> DataFrame:
    """Per question: 1 - min(mean option std / 0.5, 1), with its risk band."""
    d = option_std(dists, by).where(F.col("n_models") >= min_models)
    risk = F.round(F.lit(1.0) - F.least(F.col("mean_std") / 0.5, F.lit(1.0)), 6)
    return d.withColumn("risk", risk).withColumn(
        "band", F.when(F.col("risk") >= 0.8, "high").when(F.col("risk") >= 0.5, "medium").otherwise("low")
    )
