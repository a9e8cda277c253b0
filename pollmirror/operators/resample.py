"""Bootstrap, ceilings and convergence curves.

Two random sources. The hash source draws from a counter-based hash, so SQL engines get
the same draws; it suits checks and small grids. The kernel source uses numpy inside
Arrow batches, seeded per row or chunk, so results do not depend on the partitioning.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special as SP
from ..functions import text as X
from ..functions.tables import SAMPLE_SIZES
from .ranking import approx_quantiles, dense_index, quantiles, rank_within

CHUNK_ROWS = 20_000
#: Distinct count vectors whose ceilings a task remembers.
KNOWN = 50_000
DRAWS_AT_ONCE = 2_000_000
#: Draws of bootstrap weights that a kernel holds at once; few enough for a core's cache.
BLOCK_DRAWS = 200_000


def _number(*parts) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """Even partitions for a CPU-bound kernel. The explicit number keeps adaptive execution
    from merging them because their bytes are few."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(n, *by)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow form in which a kernel returns rows of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def in_order(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """``columns`` of the rows in order of ``_key``, then of the columns: the same wherever the rows came from."""
    at = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("_key", *columns)])
    return np.column_stack([rows[c].to_numpy() for c in columns]).astype(float, copy=False)[at.to_numpy()]


# --- bootstrap replicates of a mean -------------------------------------------------


def boot_means_hash(df: DataFrame, by: list[str], key: str, value: str, resamples: int, seed: Column | int = 42) -> DataFrame:
    """(by, b, mean) with hash draws: draw i of replicate b takes row floor(u * n) of the group."""
    rows = dense_index(df.select(*by, key, F.col(value).alias("_x")), by, key)
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    s = seed if isinstance(seed, Column) else F.lit(seed)
    group = F.concat_ws("/", *by)
    draws = (
        rows.select(*by, F.col("idx").alias("_i")).join(n, by)
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .select(*by, "b", F.floor(X.uniform(s, group, F.col("b"), F.col("_i")) * F.col("_n")).alias("idx"))
    )
    return draws.join(rows.select(*by, "idx", "_x"), [*by, "idx"]).groupBy(*by, "b").agg(F.avg("_x").alias("mean"))


def boot_means(df: DataFrame, by: list[str], key: str, value: str, resamples: int = 2000, seed: int = 42, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(by, b, mean) with numpy draws; a group of any size is split into chunks.

    How many of a replicate's n draws fall into each chunk is one multinomial every chunk
    task derives alike from the group's seed; inside its chunk a task draws that many rows
    and returns one partial sum per replicate. The sums add up to exactly the bootstrap over
    the whole group, while no task holds more than about ``chunk_rows`` rows of it.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(key).cast("string").alias("_key"), F.col(value).cast("double").alias("_x")).join(sizes, by)
    d = d.withColumn("_chunk", F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / chunk_rows)).cast("int"))
    chunks = d.groupBy(*by, "_chunk").agg(F.count("*").alias("_m"))
    layout = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_m"))).alias("_layout"))
    layout = layout.select(*by, F.to_json(F.struct(F.col("_layout._chunk").alias("ids"), F.col("_layout._m").alias("sizes"))).alias("_head"))
    # the layout travels on one row per chunk, as text: a null text costs the data rows nothing, a null array much
    first = chunks.join(layout, by).select(*by, "_chunk", F.lit("").alias("_key"), F.lit(None).cast("double").alias("_x"), "_head")
    rows = d.select(*by, "_chunk", "_key", "_x", F.lit(None).cast("string").alias("_head"))
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField("b", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_t", T.LongType())])
    arrow = arrow_schema(schema)

    def draw(keys: tuple[Any, ...], rows_: pa.Table) -> pa.Table:
        keys = [k.as_py() for k in keys]
        head = json.loads(rows_.filter(rows_["_head"].is_valid())["_head"][0].as_py())
        data = in_order(rows_.filter(rows_["_head"].is_null()), ["_x"])[:, 0]
        sizes_ = np.asarray(head["sizes"], dtype=np.int64)
        n = int(sizes_.sum())
        mine = head["ids"].index(keys[-1])
        group = [str(k) for k in keys[:-1]]
        split = np.random.default_rng(_number(seed, *group)).multinomial(n, sizes_ / n, size=resamples)[:, mine]
        own = np.random.default_rng(_number(seed, *group, keys[-1], "rows"))
        # all draws of a block of replicates at once, block ends cut them into replicates; long replicates one at a time,
        # so that they stay in the cache
        sums = np.zeros(resamples)
        ends = np.concatenate([[0], np.cumsum(split)])
        block = max(1, int(BLOCK_DRAWS // max(1, split.max()))) if len(data) <= 2000 else 1
        for b in range(0, resamples, block):
            e = min(resamples, b + block)
            drawn = data.take(own.integers(0, len(data), size=int(ends[e] - ends[b])))
            if block == 1:
                sums[b] = drawn.sum()
            else:
                run = np.concatenate([[0.0], np.cumsum(drawn)])
                sums[b:e] = run[ends[b + 1 : e + 1] - ends[b]] - run[ends[b:e] - ends[b]]
        columns = [*[pa.array([k] * resamples, f.type) for k, f in zip(keys[:-1], arrow)], pa.array(np.arange(resamples)), pa.array(sums), pa.array(split)]
        return pa.Table.from_arrays(columns, schema=arrow)

    parts = rows.unionByName(first).groupBy(*by, "_chunk").applyInArrow(draw, schema)
    return parts.groupBy(*by, "b").agg((F.sum("_s") / F.sum("_t")).alias("mean"))


# --- intervals and tests ------------------------------------------------------------


def bca_interval(df: DataFrame, replicates: DataFrame, by: list[str], value: str, resamples: int, confidence: float = 0.95) -> DataFrame:
    """BCa interval of a mean from its replicates; groups below five values are left out.

    The jackknife of a mean is closed form, so the acceleration is skewness / (6 sqrt(n)).
    Replicates are ``resamples`` rows per group, a parameter, so ordering them is bounded.
    """
    moments = df.groupBy(*by).agg(
        F.avg(value).alias("estimate"), F.count(value).alias("n"), F.skewness(value).alias("_skew")
    ).where("n >= 5")
    # drawn once: ``resamples`` values a group, in order, serve both the share below the estimate and the ends
    ordered = replicates.groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("_means"))
    below = F.size(F.filter("_means", lambda m: F.round(m, 12) < F.round("estimate", 12))) / F.size("_means")
    lo, hi = 1.0 / (resamples + 1), resamples / (resamples + 1.0)
    clamp = lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    d = moments.join(ordered, by).withColumn("_z0", SP.normal_quantile(clamp(below)))
    d = d.withColumn("_a", F.when(F.isnan("_skew") | F.col("_skew").isNull(), 0.0).otherwise(F.col("_skew") / (F.sqrt("n") * 6.0)))
    alpha = (1.0 - confidence) / 2.0

    def place(p):
        z = F.col("_z0") + SP.normal_quantile(F.lit(p))
        x = F.col("_z0") + z / (F.lit(1.0) - F.col("_a") * z)
        return F.floor(clamp(F.when(F.lit(1.0) - F.col("_a") * z == 0, 0.5).otherwise(SP.normal_cdf(x))) * resamples)

    at = lambda p: F.get("_means", place(p).cast("int"))
    return d.select(*by, "estimate", "n", at(alpha).alias("ci_lower"), at(1.0 - alpha).alias("ci_upper"))


RUN_METRICS = {"p_dist": 42, "p_rank": 43, "p_refuse": 44, "sps": 45}


def run_metric_rows(scored: DataFrame) -> DataFrame:
    """The four per-question values a run's intervals resample; sps resamples parity."""
    d = scored.withColumn("_refuse", F.abs(F.col("model_refusal_rate") - F.col("human_refusal_rate")))
    return d.select(
        "run_id", "key",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("x")) for m, c in zip(RUN_METRICS, ("jsd", "tau", "_refuse", "parity"))])).alias("_m"),
    ).select("run_id", "key", "_m.metric", "_m.x")


def run_ci(scored: DataFrame, resamples: int = 2000, hashed: bool = False) -> DataFrame:
    """Intervals of p_dist, p_rank, p_refuse and sps per run."""
    rows = run_metric_rows(scored)
    by = ["run_id", "metric"]
    reps = (boot_means_hash if hashed else boot_means)(rows, by, "key", "x", resamples)
    ci = bca_interval(rows, reps, by, "x", resamples)
    lo, hi, m = F.col("ci_lower"), F.col("ci_upper"), F.col("metric")
    flip = m.isin("p_dist", "p_refuse")
    new_lo = F.when(flip, F.lit(1.0) - hi).when(m == "p_rank", (lo + 1.0) / 2.0).otherwise(lo)
    new_hi = F.when(flip, F.lit(1.0) - lo).when(m == "p_rank", (hi + 1.0) / 2.0).otherwise(hi)
    return ci.select("run_id", "metric", "n", new_lo.alias("ci_lower"), new_hi.alias("ci_upper"))


def percentile_ci(replicates: DataFrame, by: list[str], lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval of the replicate means."""
    return replicates.groupBy(*by).agg(
        F.percentile("mean", lo).alias("ci_low"), F.percentile("mean", hi).alias("ci_high")
    )


def paired_diffs(a: DataFrame, b: DataFrame, by: list[str], value: str = "parity") -> DataFrame:
    """by, key, d: a minus b on the questions both sides have."""
    side = lambda d, n: d.select(*by, "key", F.col(value).alias(n))
    return side(a, "_a").join(side(b, "_b"), [*by, "key"]).select(*by, "key", (F.col("_a") - F.col("_b")).alias("d"))


def run_pair_diffs(scored: DataFrame, by: list[str], run: str = "model", value: str = "parity") -> DataFrame:
    """by, run_a, run_b, key, d for every pair of runs that share questions; a question has few runs."""
    side = lambda s: scored.select(*by, "key", F.col(run).alias(f"run_{s}"), F.col(value).alias(f"_{s}"))
    pairs = side("a").join(side("b"), [*by, "key"]).where("run_a < run_b")
    return pairs.select(*by, "run_a", "run_b", "key", (F.col("_a") - F.col("_b")).alias("d"))


def paired_bootstrap(diffs: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 42, hashed: bool = False) -> DataFrame:
    """Centred bootstrap of the mean difference per group: delta, p value and verdict."""
    obs = diffs.groupBy(*by).agg(F.avg("d").alias("delta"), F.count("*").alias("n"))
    reps = (boot_means_hash if hashed else boot_means)(diffs, by, "key", "d", resamples, seed)
    p = F.avg((F.round(F.abs(F.col("mean") - F.col("delta")), 12) >= F.round(F.abs("delta"), 12)).cast("double"))
    return reps.join(obs, by).groupBy(*by, "delta", "n").agg(p.alias("p_value")).withColumn(
        "verdict", F.when(F.col("p_value") < 0.05, "significant").otherwise("not significant")
    )


def paired_test(a: DataFrame, b: DataFrame, by: list[str], value: str = "parity", resamples: int = 10_000, seed: int = 42, hashed: bool = False) -> DataFrame:
    """Centred paired bootstrap on shared keys: delta, p value and verdict."""
    return paired_bootstrap(paired_diffs(a, b, by, value), by, resamples, seed, hashed)


def proportion_ci(counts: DataFrame, resamples: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """BCa interval of every category share in a frequency table (count, total).

    Resampling n answers and counting one category is a binomial draw, so each row needs
    its count and total only.
    """
    d = counts.where("total > 0").withColumn("_id", F.xxhash64(*[F.col(c) for c in counts.columns]))
    schema = T.StructType(d.schema.fields + [T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType())])
    edge = 1.0 / (resamples + 1)
    ends = [SP.normal_quantile_number(q) for q in ((1.0 - confidence) / 2.0, (1.0 + confidence) / 2.0)]

    def interval(seeded: int, count: int, total: int) -> tuple[float, float]:
        p = count / total
        if total < 5:
            return p, p
        draws = np.sort(np.random.default_rng([seed, seeded & 0xFFFFFFFFFFFFFFFF]).binomial(total, p, resamples))
        z0 = SP.normal_quantile_number(min(1.0 - edge, max(edge, float((draws < count).mean()))))
        skew = (1.0 - 2.0 * p) / np.sqrt(p * (1.0 - p)) if 0.0 < p < 1.0 else 0.0
        accel = skew / (6.0 * np.sqrt(total))
        at = [SP.normal_cdf_number(z0 + (z0 + z) / (1.0 - accel * (z0 + z))) for z in ends]
        lo, hi = (draws[int(min(1.0 - edge, max(edge, a)) * resamples)] / total for a in at)
        return float(lo), float(hi)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [interval(int(i), int(c), int(n)) for i, c, n in zip(pdf["_id"], pdf["count"], pdf["total"])]
            yield pdf.assign(ci_lower=[f[0] for f in found], ci_upper=[f[1] for f in found])

    return d.mapInPandas(draw, schema).drop("_id")


# --- split-half ceilings -------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.where(x > 0, x, 1.0))


def _jsd_rows(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """JSD of every row of ``p`` and the row of ``q`` beside it, or the one ``q`` there is."""
    both = (_xlogx(p).sum(axis=-1) + _xlogx(q).sum(axis=-1)) / 2.0
    return np.maximum(both - _xlogx((p + q) / 2.0).sum(axis=-1), 0.0)


def _tau_rows(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(p.shape[-1], 1)
    sp, sq = np.sign(p[:, i] - p[:, j]), np.sign(q[:, i] - q[:, j])
    den = np.sqrt((sp * sp).sum(axis=1) * (sq * sq).sum(axis=1))
    return np.where(den > 0, (sp * sq).sum(axis=1) / np.where(den > 0, den, 1.0), 0.0)


KERNELS = {"jsd": (_jsd_rows, True), "tau": (_tau_rows, False)}


def quality_flag(n: Column) -> Column:
    return F.when(n >= 400, "high").when(n >= 200, "medium").otherwise("low")


def ceiling(counts: DataFrame, metric: str = "jsd", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Split-half ceiling per row of ``counts`` (array column, options in sorted order).

    Each row draws pairs of multinomial halves in one numpy call, all from the same seed, so
    rows of equal counts have equal ceilings and a task draws each distinct one once. Rows are
    spread by Spark and share nothing.
    """
    kernel, is_distance = KERNELS[metric]
    schema = T.StructType(counts.schema.fields + [T.StructField(c, T.DoubleType()) for c in ("mean", "ci_low", "ci_high")])

    def one(c: np.ndarray) -> tuple[float, float, float]:
        n = int(c.sum())
        if n // 2 < 1:
            return 0.0, 0.0, 0.0
        half = np.random.default_rng(seed).multinomial(n // 2, c / n, size=(resamples, 2)) / (n // 2)
        d = kernel(half[:, 0], half[:, 1])
        lo, hi = np.percentile(d, [2.5, 97.5])
        return (1.0 - d.mean(), 1.0 - hi, 1.0 - lo) if is_distance else (d.mean(), lo, hi)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple[float, float, float]] = {}
        for pdf in batches:
            rows = []
            for c in pdf["counts"]:
                c = np.asarray(c, dtype=np.float64)
                if (key := c.tobytes()) not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = one(c)
                rows.append(known[key])
            yield pdf.assign(**{k: [r[i] for r in rows] for i, k in enumerate(("mean", "ci_low", "ci_high"))})

    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    d = spread(counts.where(total > 0), [c for c in counts.columns if c != "counts"][:2])
    return d.mapInPandas(run, schema).withColumn("n_effective", total.cast("bigint")).withColumn("flag", quality_flag(total))


def ceiling_agg(ceilings: DataFrame, by: list[str], weight: str = "n_effective", inferred: bool = False) -> DataFrame:
    """Weighted means of estimate and, where there are any, bounds, summed n, worst flag; inferred counts cap it at medium."""
    w = F.col(weight)
    rank = F.when(F.col("flag") == "low", 0).when(F.col("flag") == "medium", 1).otherwise(2)
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    worst = F.min(rank)
    worst = F.least(worst, F.lit(1)) if inferred else worst
    return ceilings.groupBy(*by).agg(
        *[mean(c).alias(c) for c in ("mean", "ci_low", "ci_high") if c in ceilings.columns],
        F.sum("n_effective").alias("n_effective"), F.count("*").alias("n_questions"),
        F.when(worst == 0, "low").when(worst == 1, "medium").otherwise("high").alias("flag"),
    )


def ceiling_levels(ceilings: DataFrame, level: list[str], inferred: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per-level ceilings (weighted by n) and the overall one (weighted by question counts)."""
    per = ceiling_agg(ceilings, level, inferred=inferred)
    overall = ceiling_agg(per.withColumnRenamed("n_questions", "_w"), [], "_w")
    return per, overall


def ceiling_spread(per_group: DataFrame, worst: int = 5, ties: Sequence[str] = (), approx: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quartiles of the group ceilings (``approx``: by sketch), the worst groups (equal ones by ``ties``) and the flag counts."""
    probs = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0}
    q = approx_quantiles(per_group, [], "mean", probs) if approx else quantiles(per_group, [], "mean", probs, bounds=(0, 1))
    return q, per_group.orderBy("mean", *ties).limit(worst), per_group.groupBy("flag").agg(F.count("*").alias("n"))


def counts_from_probs(p: Column, n: int) -> Column:
    """Whole counts adding up to n: half-even rounding, the residual goes to one option.

    When short it is the largest fraction's option, when over the smallest one's; the
    earliest wins a tie.
    """
    from ..functions.distance import bind

    raw = F.transform(p, lambda x: x * n)
    frac = F.transform(raw, lambda x: x - F.floor(x))
    base = F.transform(raw, lambda x: F.rint(x).cast("bigint"))
    parts = F.struct(base.alias("c"), frac.alias("f"), (F.lit(n) - F.aggregate(base, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("d"))

    def fix(s):
        best = F.when(s["d"] > 0, F.array_max(s["f"])).otherwise(F.array_min(s["f"]))
        at = F.array_position(s["f"], best) - 1
        return F.transform(s["c"], lambda x, i: F.when(i == at, x + s["d"]).otherwise(x))

    return bind(parts, fix)


# --- convergence curves ---------------------------------------------------------------


def multinomial_hash(questions: DataFrame, n: int, replicates: int = 1, seed: int = 42) -> DataFrame:
    """n hash draws per question and replicate, counted per option: (key, b, option, draws)."""
    cum = F.transform(
        "options",
        lambda o, i: F.struct(
            o.alias("option"),
            F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("lo"),
            F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("hi"),
        ),
    )
    d = questions.select("key", cum.alias("_c"), "n")
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.floor(X.uniform(F.lit(seed), F.col("key"), F.col("b"), F.col("i")) * F.col("n"))
    d = d.withColumn("_at", at)
    hit = F.filter("_c", lambda c: (c["lo"] <= F.col("_at")) & (F.col("_at") < c["hi"]))[0]["option"]
    return d.groupBy("key", "b", hit.alias("option")).agg(F.count("*").alias("draws"))


def multinomial_counts(questions: DataFrame, n: int, replicates: int = 1, seed: int = 42) -> DataFrame:
    """dataset, key, option, draws: per option its count in every replicate of ``n`` draws.

    Counts are split off option by option with conditional binomials, from a generator seeded by the
    question, so no draw is a row and ``n`` may be any number. Rows leave in batches of bounded draws,
    so a task holds the same few whatever the number of questions. Question rows without answers have no
    rows. ``questions``: dataset, key, options, counts.
    """

    schema = pa.schema([("dataset", pa.string()), ("key", pa.string()), ("option", pa.string()), ("draws", pa.list_(pa.int64()))])

    def made(out: list[tuple]) -> pa.RecordBatch:
        ds, key, option, taken = zip(*out)
        draws = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * replicates), pa.array(np.concatenate(taken)))
        return pa.RecordBatch.from_arrays([pa.array(ds, pa.string()), pa.array(key, pa.string()), pa.array(option, pa.string()), draws], schema=schema)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = max(1, DRAWS_AT_ONCE // (4 * replicates))  # rows that leave at once
        out: list[tuple] = []
        for batch in batches:
            for at in range(batch.num_rows):
                ds, key, options, counts = (batch[c][at].as_py() for c in ("dataset", "key", "options", "counts"))
                rng, left = np.random.default_rng(_number(seed, ds, key)), np.full(replicates, n, dtype=np.int64)
                rest = float(np.sum(counts))
                for option, c in zip(options, counts):
                    taken = rng.binomial(left, min(1.0, c / rest)) if rest > 0 else np.zeros_like(left)
                    out.append((ds, key, option, taken))
                    left, rest = left - taken, rest - c
                    if len(out) >= full:
                        yield made(out)
                        out = []
        if out:
            yield made(out)

    rows = questions.select("dataset", "key", "options", "counts").where(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) > 0)
    return spread(rows, ["key"]).mapInArrow(draw, "dataset string, key string, option string, draws array<bigint>")


CURVE = "dataset string, key string, n long, jsd_mean double, jsd_p10 double, jsd_p90 double, replicates long"
#: Cells (replicates x options) that a kernel holds at once.
AT_ONCE = 200_000
#: Uniforms of one size that questions share at most; with more of them every question draws by itself.
SHARED = 8_000_000


@lru_cache(maxsize=16)
def _uniforms(seed: int, n: int, replicates: int) -> np.ndarray:
    """replicates x n uniforms in order, made once per Python worker."""
    return np.sort(np.random.default_rng(_number(seed, n)).random((replicates, n)), axis=1)


class OptionCells:
    """The options of many questions side by side, to draw and compare samples of all of them at once.

    Draws with replacement share one stream of uniforms per size: the shares of a question part a
    circle, turned by the question's own seed, and an option gets the uniforms that fall on its part.
    That is a multinomial draw of every question, and the turns keep questions apart. Draws
    without replacement come from a generator per question and size. Neither depends on which
    questions stand together. Weights are not negative and have mass.
    """

    def __init__(self, names: Sequence[tuple], weights: Sequence[np.ndarray], seed: int):
        self.names, self.weights, self.seed = list(names), list(weights), seed
        self.ends = np.cumsum([len(w) for w in self.weights])
        self.starts = self.ends - [len(w) for w in self.weights]
        self.row = np.repeat(np.arange(len(self.weights)), self.ends - self.starts)
        self.share = np.concatenate([w / w.sum() for w in self.weights])
        self.own = _xlogx(self.share)
        run = [np.cumsum(w, dtype=np.float64) for w in self.weights]
        before = np.concatenate([np.concatenate([[0.0], r[:-1]]) / r[-1] for r in run])
        turn = np.array([(_number(seed, "turn", *name) >> 11) / 2.0**53 for name in self.names])
        place = turn[self.row] + before
        self.past = place >= 1.0
        place = place - self.past
        order = np.argsort(place, kind="stable")
        self.places, self.at = place[order], np.argsort(order, kind="stable")

    def _shared(self, n: int, uniforms: np.ndarray) -> np.ndarray:
        r, m = len(uniforms), len(self.places)
        cell = np.searchsorted(self.places, uniforms.ravel(), side="right").reshape(r, n) + np.arange(r)[:, None] * (m + 1)
        below = np.cumsum(np.bincount(cell.ravel(), minlength=r * (m + 1)).reshape(r, m + 1), axis=1, dtype=np.int32)
        reached = below.take(self.at, axis=1)
        reached += self.past * np.int32(n)
        drawn = -reached
        drawn[:, :-1] += reached[:, 1:]
        drawn[:, self.ends - 1] += reached.take(self.starts, axis=1)
        drawn[:, self.ends - 1] -= reached.take(self.ends % m, axis=1) * (self.ends < m)
        drawn[:, self.ends - 1] += n
        return drawn

    def _jsd(self, drawn: np.ndarray, n: int, cells: slice, starts: np.ndarray) -> np.ndarray:
        """JSD of every sample and its population; ``drawn``: replicates x options."""
        both = drawn / n
        both += self.share[cells]
        both /= 2.0
        log = np.log2(np.maximum(both, 1e-300))
        log *= both
        terms = (_xlogx(np.arange(n + 1) / n) / 2.0).take(drawn)
        terms += self.own[cells] / 2.0
        terms -= log
        return np.maximum(np.add.reduceat(terms, starts, axis=1), 0.0)

    def replicates(self, n: int, count: int, replace: bool = True) -> np.ndarray:
        """questions x ``count`` drawn JSDs at size ``n``, in order."""
        out = np.empty((len(self.weights), count))
        if replace and n * count <= SHARED:
            u = _uniforms(self.seed, n, count)
            step = max(1, AT_ONCE // max(n, len(self.row)))
            for a in range(0, count, step):
                out[:, a : a + step] = self._jsd(self._shared(n, u[a : a + step]), n, slice(None), self.starts).T
        else:
            first = 0
            while first < len(self.weights):
                last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + AT_ONCE // count, side="right")))
                drawn = []
                for name, w in zip(self.names[first:last], self.weights[first:last]):
                    rng = np.random.default_rng(_number(self.seed, *name, n))
                    drawn.append(rng.multinomial(n, w / w.sum(), size=count) if replace else rng.multivariate_hypergeometric(w, n, size=count, method="marginals"))
                cells = slice(self.starts[first], self.ends[last - 1])
                out[first:last] = self._jsd(np.concatenate(drawn, axis=1), n, cells, self.starts[first:last] - self.starts[first]).T
                first = last
        out.sort(axis=1)
        return out


def ordered_percentile(ordered: np.ndarray, percent: float) -> np.ndarray:
    """Percentile of every row, whose values are in order, between two values linearly."""
    at = (ordered.shape[1] - 1) * percent / 100.0
    low = int(np.floor(at))
    high = min(low + 1, ordered.shape[1] - 1)
    return ordered[:, low] + (ordered[:, high] - ordered[:, low]) * (at - low)


def _curve(rows: DataFrame, sizes: Sequence[int], replicates: int, seed: int, replace: bool) -> DataFrame:
    """Curve points of (dataset, key, w) rows. A batch of questions is drawn and compared at once, size by size."""
    wanted = [int(s) for s in sizes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights = [np.maximum(np.asarray(w, dtype=np.float64), 0.0) if replace else np.asarray(w, dtype=np.int64) for w in pdf["w"]]
            mass = np.array([w.sum() for w in weights], dtype=np.float64)
            names = list(zip(pdf["dataset"], pdf["key"]))
            cells = None
            for n in wanted:
                if replace and (mass <= 0).any():  # nothing to draw from: as far apart as can be
                    yield points([names[i] for i in np.flatnonzero(mass <= 0)], n, np.ones((int((mass <= 0).sum()), replicates)))
                kept = np.flatnonzero((mass > 0) & (replace | (mass >= n)))
                if not len(kept):
                    continue
                if cells is None or len(cells.names) != len(kept):
                    cells = OptionCells([names[i] for i in kept], [weights[i] for i in kept], seed)
                yield points(cells.names, n, cells.replicates(n, replicates, replace))

    def points(names: list[tuple], n: int, ordered: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "dataset": [x[0] for x in names], "key": [x[1] for x in names], "n": n, "jsd_mean": ordered.mean(axis=1),
            "jsd_p10": ordered_percentile(ordered, 10), "jsd_p90": ordered_percentile(ordered, 90), "replicates": ordered.shape[1],
        })

    return spread(rows, ["dataset", "key"]).mapInPandas(run, CURVE)


def curve_bootstrap(questions: DataFrame, sizes: Sequence[int] = SAMPLE_SIZES, replicates: int = 500, seed: int = 42) -> DataFrame:
    """Mean, p10 and p90 of the JSD between a sample of n and its population, per (question, n).

    ``questions``: dataset, key, p_human. Questions are spread evenly and drawn many at once,
    see ``OptionCells``.
    """
    rows = questions.where(F.size("p_human") > 0).select("dataset", "key", F.col("p_human").alias("w"))
    return _curve(rows, sizes, replicates, seed, True)


def curve_real_counts(questions: DataFrame, sizes: Sequence[int] = SAMPLE_SIZES, replicates: int = 500, seed: int = 42) -> DataFrame:
    """The curve of respondents drawn without replacement, from a question's option counts alone.

    Tallying n respondents drawn without replacement is a multivariate hypergeometric draw
    from the option counts, so no respondent row is copied: this is the path for large
    microdata. Sizes above the pool are skipped. ``questions``: dataset, key, counts.
    """
    rows = questions.where(F.size("counts") > 0).select("dataset", "key", F.col("counts").alias("w"))
    return _curve(rows, sizes, replicates, seed, False)


def curve_real(answers: DataFrame, sizes: Sequence[int] = SAMPLE_SIZES, replicates: int = 500, seed: int = 42) -> DataFrame:
    """The same curve by hash order of the respondent rows; SQL engines get the same draws.

    Per replicate the respondents of a question are put in hash order once and every n
    takes its prefix, so points of one replicate at different n are correlated; each
    point's own distribution is that of a fresh subsample. Sizes above the pool are
    skipped before anything is copied. Ranks come from hash cells, so a hot question is
    never sorted in one task. ``answers``: dataset, key, respondent, option.
    """
    from ..functions import distance as D

    by = ["dataset", "key"]
    pool = answers.groupBy(*by).agg(F.count("*").alias("_pool"))
    usable = F.filter(F.array(*[F.lit(int(s)) for s in sizes]), lambda s: s <= F.col("_pool"))
    pool = pool.withColumn("_sizes", usable).where(F.size("_sizes") > 0)
    d = answers.join(pool, by).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    d = d.withColumn("_u", -X.uniform(F.lit(seed), F.col("key"), F.col("b"), F.col("respondent")))
    ranked = rank_within(d, [*by, "b"], "_u", ["respondent", "option"], "_rank", bounds=(-1, 0))
    taken = ranked.withColumn("n", F.explode(F.filter("_sizes", lambda s: s >= F.col("_rank"))))
    per = taken.groupBy(*by, "b", "n", "option").agg(F.count("*").alias("_c"))
    full = answers.groupBy(*by, "option").agg(F.count("*").alias("_n"))
    full = full.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("option", F.col("_n").cast("double")))).alias("_full"))
    sample = per.groupBy(*by, "b", "n").agg(F.map_from_entries(F.collect_list(F.struct("option", F.col("_c").cast("double")))).alias("_s"))
    j = sample.join(full, by).withColumn("_o", F.array_sort(F.map_keys("_full")))
    j = j.withColumn("jsd", D.jsd(D.align(F.col("_o"), F.col("_s")), D.align(F.col("_o"), F.col("_full"))))
    # `replicates` values per point, a parameter
    return j.groupBy(*by, "n").agg(
        F.avg("jsd").alias("jsd_mean"), F.percentile("jsd", 0.1).alias("jsd_p10"), F.percentile("jsd", 0.9).alias("jsd_p90"),
        F.count("*").alias("replicates"),
    )


def convergence_n(curves: DataFrame, by: list[str], epsilon: float = 0.02, delta: float = 0.005) -> DataFrame:
    """Smallest n below epsilon that drops by at most delta over the next two sizes.

    The search stops, without an answer, at the first n below epsilon that lacks two
    following sizes. A curve has one row per size, so its window is tiny.
    """
    w = Window.partitionBy(*by).orderBy("n")
    one, two = F.lead("jsd_mean", 1).over(w), F.lead("jsd_mean", 2).over(w)
    d = curves.withColumn("_1", one).withColumn("_2", two)
    low = F.col("jsd_mean") < epsilon
    flat = F.greatest(F.col("jsd_mean") - F.col("_1"), F.col("jsd_mean") - F.col("_2")) <= delta
    stop = low & (F.col("_2").isNull() | flat)
    found = F.min(F.when(stop, F.struct("n", F.when(F.col("_2").isNotNull(), F.col("n")).alias("hit"))))
    return d.groupBy(*by).agg(found.getField("hit").alias("convergence_n"))


def curve_summary(converged: DataFrame, by: list[str], approx: bool = False) -> DataFrame:
    """Question counts and p50 / p90 / p99 of the reached n (``approx``: by sketch), cut to whole numbers."""
    probs = {"convergence_n_p50": 0.5, "convergence_n_p90": 0.9, "convergence_n_p99": 0.99}
    n = converged.groupBy(*by).agg(F.count("*").alias("n_questions"), F.count("convergence_n").alias("n_converged"))
    q = (approx_quantiles if approx else quantiles)(converged.withColumn("_n", F.col("convergence_n").cast("double")), by, "_n", probs)
    j = n.join(q, by, "left") if by else n.join(q, F.lit(True), "left")
    return j.select(
        *by, "n_questions", "n_converged", (F.col("n_questions") - F.col("n_converged")).alias("n_unconverged"),
        *[F.floor(c).alias(c) for c in probs],
    )


def curve_compare(real: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """Real minus bootstrap mean at the sizes both have."""
    b = bootstrap.select("dataset", "key", "n", F.col("jsd_mean").alias("_b"))
    return real.join(b, ["dataset", "key", "n"]).select("dataset", "key", "n", (F.col("jsd_mean") - F.col("_b")).alias("delta_jsd_mean"))


def curve_payload(curves: DataFrame, summary: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-question rows for full and gated tiers, summaries for all but citation-only ones."""
    from .rollups import with_tier

    rows = with_tier(curves, policies).where(F.col("tier").isin("full", "gated"))
    return rows, with_tier(summary, policies).where(F.col("tier") != "citation_only")


def baseline_lookup(questions: DataFrame, policies: DataFrame, dataset: str, key: str) -> DataFrame:
    """One question's distribution of a full-tier dataset; an exact key or one unique suffix match."""
    from .rollups import with_tier

    d = with_tier(questions.where(X.base_dataset(F.col("dataset")) == dataset), policies).where("tier = 'full'")
    exact = F.col("key") == key
    cand = d.where(exact | F.col("key").endswith("_" + key)).withColumn("_exact", exact)
    n = cand.agg(F.count_if("_exact").alias("_e"), F.count("*").alias("_n"))
    return cand.crossJoin(F.broadcast(n)).where(F.col("_exact") | ((F.col("_e") == 0) & (F.col("_n") == 1))).drop("_exact", "_e", "_n")


def temporal_drift(waves: DataFrame, resamples: int = 1000, hashed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSD of every wave pair of a stem, its mean with an interval, and the means by year gap."""
    from .pairs import pair_jsd

    d = waves.withColumn("stem", X.stem(F.col("key"))).withColumn("year", X.wave_year(F.col("survey"))).where("stem IS NOT NULL AND year > 0")
    d = d.withColumn("dist", F.map_from_arrays("options", "p_human"))
    pairs = pair_jsd(d, ["stem"], "key", extra=["year"]).withColumn("gap", F.abs(F.col("year_a") - F.col("year_b")))
    pairs = pairs.withColumn("pair", F.concat_ws("|", "stem", "key_a", "key_b")).withColumn("all", F.lit("all"))
    reps = (boot_means_hash if hashed else boot_means)(pairs, ["all"], "pair", "jsd", resamples)
    overall = pairs.groupBy("all").agg(
        F.avg("jsd").alias("mean_drift"), F.count("*").alias("n_pairs"), F.countDistinct("stem").alias("n_stems")
    ).join(percentile_ci(reps, ["all"]), "all").drop("all")
    by_gap = pairs.groupBy("gap").agg(F.avg("jsd").alias("mean_jsd"), F.count("*").alias("n_pairs"))
    return pairs, overall, by_gap
