"""Human ceilings by subgroup: margins and cross-cuts from one aggregation, exact means, spread.

A ceiling is one less the mean JSD of two independent halves of a question's answers. Per
option the JSD is phi(a)/2 + phi(b)/2 - phi((a + b)/2) with phi(x) = x log2 x; both halves have
one law, and the sum of two binomials of h draws is one of 2h draws. So the mean is
E phi(h draws) - E phi(2h draws), summed over options, exact and without draws. The interval
needs the joint law and comes from the drawn ceiling.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import resample as R
from .curves import expected_value

#: Questions answered by fewer respondents of a group have no ceiling there.
LEAST = 10


def _phi(e: np.ndarray, _: np.ndarray) -> np.ndarray:
    return np.where(e > 0, e * np.log2(np.where(e > 0, e, 1.0)), 0.0)


def expected_ceiling(counts: DataFrame) -> DataFrame:
    """``counts`` (an array column ``counts`` and any others) with the exact mean ceiling, n_effective and flag.

    A question of fewer than two answers has a ceiling of 0, one without answers no row. Row-local;
    a batch evaluates each distinct (count, pool) pair once.
    """
    rows = counts.withColumn("counts", F.col("counts").cast("array<bigint>"))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    names = rows.columns
    schema = rows.withColumn("mean", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = batch["counts"]
            count = one.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), one.value_lengths().to_numpy())
            pool = np.bincount(row, weights=count, minlength=batch.num_rows).astype(np.int64)
            pairs, which = np.unique(np.stack([count, pool[row]]), axis=1, return_inverse=True)
            half = pairs[1] // 2
            terms, real = np.zeros(pairs.shape[1]), half > 0
            terms[real] = expected_value(_phi, pairs[0][real], pairs[1][real], half[real]) - expected_value(_phi, pairs[0][real], pairs[1][real], 2 * half[real])
            distance = np.bincount(row, weights=terms[which.reshape(-1)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(pool >= 2, 1.0 - distance, 0.0))], [*names, "mean"])

    d = rows.where(total > 0).mapInArrow(run, schema)
    return d.withColumn("n_effective", total).withColumn("flag", R.quality_flag(total))


def cross_cuts(answers: DataFrame, by: list[str], attributes: Mapping[str, Column], option: str = "option", depth: int = 2, least: int = LEAST) -> DataFrame:
    """by, attribute, group, counts: option counts of every margin and of every cross-cut of up to ``depth`` attributes.

    The answers are aggregated once, to cells of all attributes together; every cell is then added to
    each cut it belongs to, like grouping sets, so raw rows are never multiplied. An answer without a
    value of an attribute is left out of the cuts that need it. A cross-cut is named A_B, its
    groups "a × b". Groups of fewer than ``least`` answers to a question are dropped.
    """
    named = answers.select(*by, F.col(option).alias("_option"), *[c.cast("string").alias(f"_a{i}") for i, c in enumerate(attributes.values())])
    at = [f"_a{i}" for i in range(len(attributes))]
    cells = named.groupBy(*by, *at, "_option").agg(F.count(F.lit(1)).alias("_n"))
    cuts = [c for size in range(1, depth + 1) for c in combinations(range(len(attributes)), size)]
    labels = list(attributes)
    group = lambda cut: F.concat(*[x for j, i in enumerate(cut) for x in ([F.lit(" × ")] if j else []) + [F.col(at[i])]])  # null if a part is
    wanted = F.array(*[F.struct(F.lit("_".join(labels[i] for i in cut)).alias("attribute"), group(cut).alias("group")) for cut in cuts])
    d = cells.withColumn("_cut", F.explode(F.filter(wanted, lambda c: c["group"].isNotNull())))
    d = d.groupBy(*by, F.col("_cut.attribute").alias("attribute"), F.col("_cut.group").alias("group"), "_option").agg(F.sum("_n").alias("_n"))
    d = d.groupBy(*by, "attribute", "group").agg(F.array_sort(F.collect_list(F.struct("_option", "_n"))).alias("_c"))  # one entry per option
    d = d.select(*by, "attribute", "group", F.col("_c._n").alias("counts"))
    return d.where(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) >= least)


def subgroup_ceilings(cuts: DataFrame, level: Sequence[str] = ("attribute", "group"), resamples: int | None = 1000) -> DataFrame:
    """One ceiling per (level): weighted over its questions, with n, question count and the worst flag.

    With ``resamples`` each distinct question cell is drawn and the ceiling has an interval; with
    none the exact mean is taken.
    """
    each = expected_ceiling(cuts) if resamples is None else R.ceiling(cuts, resamples=resamples)
    return R.ceiling_agg(each, list(level))
