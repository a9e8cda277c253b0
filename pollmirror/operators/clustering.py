"""Persona clusters of answer patterns, k picked by silhouette: bisecting k-means, and exact Ward for small cohorts."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.common import shared_folder

MAX_PATTERNS = 2_000


def _ward_labels(x: np.ndarray, weight: np.ndarray, wanted: range) -> dict[int, np.ndarray]:
    """Labels for every k in ``wanted`` from one agglomeration of weighted one-hot rows."""
    n = len(x)
    size = weight.astype(float).copy()
    sq = ((x[:, None, :] != x[None, :, :]).sum(axis=2) * 2).astype(float)
    # Ward's merge cost of two weighted points, on the scale of squared distances of singletons
    cost = 2.0 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]) * sq
    np.fill_diagonal(cost, np.inf)
    member = np.arange(n)
    alive = n
    out = {}
    if alive in wanted:
        out[alive] = member.copy()
    while alive > 1:
        i, j = divmod(int(np.argmin(cost)), n)
        i, j = min(i, j), max(i, j)
        d_ij, s_i, s_j = cost[i, j], size[i], size[j]
        new = ((size + s_i) * cost[i] + (size + s_j) * cost[j] - size * d_ij) / (size + s_i + s_j)
        new[~np.isfinite(cost[i]) | ~np.isfinite(cost[j])] = np.inf
        new[[i, j]] = np.inf
        cost[i], cost[:, i] = new, new
        cost[j], cost[:, j] = np.inf, np.inf
        size[i] = s_i + s_j
        member[member == j] = i
        alive -= 1
        if alive in wanted:
            out[alive] = member.copy()
    return out


def _silhouette(x: np.ndarray, weight: np.ndarray, label: np.ndarray) -> float:
    sq = ((x[:, None, :] != x[None, :, :]).sum(axis=2) * 2).astype(float)
    ids = np.unique(label)
    if len(ids) < 2:
        return 0.0
    mass = np.array([weight[label == c].sum() for c in ids], dtype=float)
    total = np.stack([sq[:, label == c] @ weight[label == c] for c in ids], axis=1)
    own = np.searchsorted(ids, label)
    rows = np.arange(len(x))
    a = np.where(mass[own] > 1, total[rows, own] / np.maximum(mass[own] - 1, 1), 0.0)
    other = total / mass
    other[rows, own] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    s = np.where(top > 0, (b - a) / np.where(top > 0, top, 1.0), 0.0)
    return float((s * weight).sum() / weight.sum())


def ward_clusters(points: DataFrame, by: list[str], min_k: int = 2, max_k: int = 5) -> DataFrame:
    """Exact Ward clusters of small cohorts: every distinct answer pattern with its size and the silhouette.

    ``points``: by, persona, question, answer. Personas with the same answers are merged
    by Spark first, so a cohort of any size reaches the kernel as its distinct patterns
    with their counts. That number is bounded by the answer sheet, and it is checked: a
    cohort with more than ``MAX_PATTERNS`` patterns stops the job and needs splitting.
    """
    sheets = points.groupBy(*by, "persona").agg(
        F.array_sort(F.collect_list(F.struct("question", "answer"))).alias("_s")
    )
    patterns = sheets.groupBy(*by, F.col("_s.answer").alias("pattern")).agg(F.count("*").alias("size"))
    n = patterns.groupBy(*by).agg(F.count("*").alias("_k"))
    ok = F.when(F.col("_k") <= MAX_PATTERNS, True).otherwise(
        F.raise_error(F.concat(F.lit("too many distinct patterns in cohort: "), F.col("_k").cast("string"))).cast("boolean")
    )
    d = patterns.join(n, by).where(ok).drop("_k")
    schema = T.StructType(
        [points.schema[c] for c in by]
        + [T.StructField("pattern", T.StringType()), T.StructField("size", T.LongType()), T.StructField("cluster", T.LongType()), T.StructField("n_clusters", T.LongType()), T.StructField("silhouette", T.DoubleType())]
    )

    def run(keys: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_p=["|".join(p) for p in pdf["pattern"]]).sort_values("_p")
        codes = pd.factorize(np.concatenate([np.asarray(list(p), dtype=object) for p in pdf["pattern"]]))[0]
        x = codes.reshape(len(pdf), -1)
        w = pdf["size"].to_numpy()
        top = max(min_k, min(max_k, int(w.sum()) - 1))
        best, label, score = min_k, np.zeros(len(x), dtype=int), -2.0
        for k, lab in sorted(_ward_labels(x, w, range(min_k, top + 1)).items()):
            s = _silhouette(x, w, lab)
            if s > score:
                best, label, score = k, lab, s
        compact = pd.factorize(label)[0]
        out = {c: keys[i] for i, c in enumerate(by)}
        return pd.DataFrame({**out, "pattern": pdf["_p"], "size": w, "cluster": compact, "n_clusters": best, "silhouette": score})

    return d.groupBy(*by).applyInPandas(run, schema)


def dominant_answers(points: DataFrame, by: list[str]) -> DataFrame:
    """Most common answer per cluster and question with its share, ties alphabetical."""
    counts = points.groupBy(*by, "cluster", "question", "answer").agg(F.count("*").alias("_n"))
    return counts.groupBy(*by, "cluster", "question").agg(
        F.min(F.struct(-F.col("_n"), "answer")).getField("answer").alias("dominant"),
        (F.max("_n") / F.sum("_n")).alias("share"),
    )


# --- any number of patterns: bisecting k-means, all cohorts at once -------------------


def _held(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that rounds do not pile up."""
    path = shared_folder(df.sparkSession, "clusters")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _summaries(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group ``s``: its weight, and how many personas gave each answer, as many as the answer sheet has."""
    cells = rows.select(*by, "size", F.explode("answers").alias("answer")).groupBy(*by, "answer").agg(F.sum("size").alias("_n"))
    maps = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("answer", F.col("_n").cast("double")))).alias("counts"))
    weights = rows.groupBy(*by).agg(F.sum("size").cast("double").alias("weight"))
    return maps.join(weights, by).select(*by, F.struct("counts", "weight").alias("s"))


def _matches(answers: Column, s: Column) -> Column:
    """Answers that a sheet shares with the personas of a group, added up."""
    return F.aggregate(answers, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(s["counts"], x), F.lit(0.0)))


def _to_mean(answers: Column, s: Column) -> Column:
    """Squared distance of a one-hot sheet to the mean of a group."""
    square = F.aggregate(F.map_values(s["counts"]), F.lit(0.0), lambda a, n: a + n * n)
    return F.round(F.size(answers) - _matches(answers, s) * 2.0 / s["weight"] + square / (s["weight"] * s["weight"]), 9)


def _split(rows: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """by, pattern of the right halves of the cluster that deviates most in every cohort; none if no cluster has two patterns."""
    far = rows.join(_summaries(rows, [*by, "cluster"]), [*by, "cluster"]).withColumn("_d", _to_mean(F.col("answers"), F.col("s")))
    clusters = far.groupBy(*by, "cluster").agg(
        F.sum(F.col("_d") * F.col("size")).alias("_sse"), F.count("*").alias("_k"), F.min(F.struct(-F.col("_d"), "pattern", "answers")).getField("answers").alias("_a")
    )
    worst = clusters.where("_k > 1").groupBy(*by).agg(F.min(F.struct(-F.round("_sse", 6), "cluster", "_a")).alias("_p"))
    mine = rows.join(worst.select(*by, F.col("_p.cluster").alias("cluster"), F.col("_p._a").alias("_a")), [*by, "cluster"])
    same = lambda seed: F.size(F.array_intersect("answers", seed))
    second = mine.groupBy(*by).agg(F.min(F.struct(same("_a"), "pattern", "answers")).getField("answers").alias("_b"))
    side = _held(mine.join(second, by).withColumn("right", same("_b") > same("_a")).select(*by, "pattern", "answers", "size", "right"))
    for _ in range(rounds):
        means = _summaries(side, [*by, "right"])
        of = lambda right: F.first(F.when(F.col("right") == right, F.col("s")), ignorenulls=True)  # one row a side
        pair = means.groupBy(*by).agg(of(False).alias("_l"), of(True).alias("_r"))
        nearer = _to_mean(F.col("answers"), F.col("_r")) < _to_mean(F.col("answers"), F.col("_l"))
        side = _held(side.join(pair, by).withColumn("right", F.coalesce(nearer, "right")).drop("_l", "_r"))
    return side.where("right").select(*by, "pattern")


def _silhouettes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean silhouette per cohort over squared distances, from the clusters' answer counts; a singleton has a = 0."""
    clusters = _summaries(rows, [*by, "cluster"]).groupBy(*by).agg(F.collect_list(F.struct("cluster", "s")).alias("_all"))  # few clusters
    total = lambda c: (F.size("answers") * c["s"]["weight"] - _matches(F.col("answers"), c["s"])) * 2.0
    own = F.filter("_all", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.filter("_all", lambda c: c["cluster"] != F.col("cluster"))
    a = F.when(own["s"]["weight"] > 1, total(own) / (own["s"]["weight"] - 1)).otherwise(0.0)
    d = rows.join(clusters, by).select(*by, "size", a.alias("_a"), F.array_min(F.transform(others, lambda c: total(c) / c["s"]["weight"])).alias("_b"))
    top = F.greatest("_a", "_b")
    one = F.when(F.col("_b").isNull() | (top == 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / top)
    return d.groupBy(*by).agg((F.sum(one * F.col("size")) / F.sum("size")).alias("silhouette"))


def cluster_patterns(points: DataFrame, by: list[str], min_k: int = 2, max_k: int = 5, rounds: int = 4) -> DataFrame:
    """by, pattern, size, cluster, n_clusters, silhouette of every distinct answer pattern per cohort.

    In every cohort at once, the cluster of the largest squared deviation is split in two, ``max_k``
    - 1 times. A split starts from the pattern farthest from the mean and the one that shares least
    with it, and moves patterns to the nearer mean ``rounds`` times. Of the divisions into ``min_k``
    to ``max_k`` clusters the one of the largest silhouette is taken, the coarser of equal ones.

    Patterns meet one row per cohort, the answer counts of its clusters, whose size is that of the
    answer sheet. No two patterns are compared and no cohort is gathered, so it may have any number
    of them. A cohort with fewer patterns than clusters is split as far as it goes; of one pattern it is
    one cluster with a silhouette of 0. Ties go to the first pattern by name, so the result does not
    depend on the partitioning. ``points``: by, persona, question, answer, every persona answering
    every question.
    """
    sheets = points.groupBy(*by, "persona").agg(F.array_sort(F.collect_list(F.struct("question", "answer"))).alias("_s"))
    named = F.transform("_s", lambda x: F.concat_ws("=", x["question"], x["answer"]))
    rows = sheets.groupBy(*by, named.alias("answers"), F.array_join("_s.answer", "|").alias("pattern")).agg(F.count("*").alias("size"))
    rows = _held(rows.withColumn("cluster", F.lit(0)))
    scores, labels = None, rows.select(*by, "pattern", "size", F.array(F.lit(0)).alias("_l"))
    for level in range(1, max_k):
        right = _split(rows, by, rounds).withColumn("_m", F.lit(True))
        rows = rows.join(right, [*by, "pattern"], "left").withColumn("cluster", F.when(F.col("_m"), level).otherwise(F.col("cluster"))).drop("_m")
        rows = _held(rows)
        labels = labels.join(rows.select(*by, "pattern", "cluster"), [*by, "pattern"]).withColumn("_l", F.concat("_l", F.array("cluster"))).drop("cluster")
        if level + 1 >= min_k:
            one = _silhouettes(rows, by).withColumn("_k", F.lit(level + 1))
            scores = one if scores is None else scores.unionByName(one)
    best = scores.groupBy(*by).agg(F.min(F.struct(-F.round("silhouette", 9), "_k", "silhouette")).alias("_b"))
    found = labels.join(best.select(*by, F.col("_b._k").alias("_k"), F.col("_b.silhouette").alias("silhouette")), by).withColumn("cluster", F.element_at("_l", F.col("_k")))
    made = found.groupBy(*by).agg(F.countDistinct("cluster").alias("n_clusters"))
    return found.join(made, by).select(*by, "pattern", "size", F.col("cluster").cast("bigint").alias("cluster"), "n_clusters", "silhouette")
