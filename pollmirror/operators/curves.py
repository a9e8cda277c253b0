"""Convergence curves: exact means from option counts, and walks with a bound on their error.

A curve point is the JSD between the answers of n respondents and the whole distribution. The
JSD is a sum over options, and each term depends on one option's count alone, whose law is
binomial (draws with replacement) or hypergeometric (without). So a point's mean is a sum over
one-dimensional laws, exact and without draws. Percentiles need the joint law and are drawn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import SAMPLE_SIZES
from .resample import OptionCells, _jsd_rows, _number, ordered_percentile, spread

EPSILON, DELTA = 0.02, 0.005
#: A count this many deviations (and as many units) off its mean has no weight in double precision.
REACH = 10
CELLS = 1 << 20


def expected_value(value: Callable[[np.ndarray, np.ndarray], np.ndarray], count: np.ndarray, pool: np.ndarray, n: int | np.ndarray, replace: bool = True) -> np.ndarray:
    """Mean of ``value(x / n, count / pool)`` when x of n drawn answers fall on an option that ``count`` of ``pool`` chose.

    ``value`` is not asked where no or every respondent chose the option: the draw is certain, and 0 is
    returned. The weights of the possible draws follow from the ratio of neighbouring ones and are
    normalised, so no factorials are needed.
    """
    count, pool = count.astype(np.float64), pool.astype(np.float64)
    n = np.broadcast_to(np.asarray(n, np.float64), count.shape)
    out = np.zeros(len(count))
    p = count / pool
    sd = np.sqrt(n * p * (1 - p) * (1.0 if replace else np.maximum(pool - n, 0) / np.maximum(pool - 1, 1)))
    low = np.maximum(0.0 if replace else n - (pool - count), np.floor(n * p - REACH * sd - REACH))
    high = np.minimum(n if replace else np.minimum(n, count), np.ceil(n * p + REACH * sd + REACH))
    low = np.maximum(low, 0)
    todo = np.flatnonzero((count > 0) & (count < pool))
    width = int((high - low)[todo].max(initial=0)) + 1
    step = max(1, CELLS // width)
    for a in range(0, len(todo), step):
        i = todo[a : a + step]
        size, top, q = n[i, None], high[i, None], p[i, None]
        x = low[i, None] + np.arange(width)
        inside = x <= top
        before = np.maximum(np.where(inside, x, top)[:, 1:] - 1, 0)  # each weight from the one before it
        if replace:
            ratio = (size - before) / (before + 1) * (q / (1 - q))
        else:
            c, rest = count[i, None], pool[i, None] - count[i, None]
            ratio = (c - before) / (before + 1) * (size - before) / np.maximum(rest - size + before + 1, 1)
        log = np.concatenate([np.zeros((len(i), 1)), np.cumsum(np.log(np.where(inside[:, 1:], ratio, 1.0)), axis=1)], axis=1)
        log = np.where(inside, log, -np.inf)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        out[i] = (weight * np.where(inside, value(np.minimum(x, top) / size, q), 0.0)).sum(axis=1) / weight.sum(axis=1)
    return out


def _jsd_term(e: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = (e + q) / 2
    return (np.where(e > 0, e * np.log2(np.where(e > 0, e, 1.0) / m), 0.0) + q * np.log2(q / m)) / 2


def expected_terms(count: np.ndarray, pool: np.ndarray, n: int, replace: bool = True) -> np.ndarray:
    """Mean JSD term of an option that ``count`` of ``pool`` chose, when n answers are drawn."""
    return expected_value(_jsd_term, count, pool, n, replace)


def expected_curve(questions: DataFrame, sizes: Sequence[int] = SAMPLE_SIZES, replace: bool = True) -> DataFrame:
    """dataset, key, n, jsd_mean: the exact mean of every curve point.

    With replacement it is the mean that bootstrap replicates of the distribution tend to, without
    it that of subsamples of the respondents, for sizes up to their number. Row-local: a
    batch evaluates each distinct (count, pool) pair once per size. A question without counts has
    no points. ``questions``: dataset, key, counts.
    """
    wanted = [int(s) for s in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["counts"].value_lengths().to_numpy()
            counts = batch["counts"].flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            pool = np.bincount(row, weights=counts, minlength=batch.num_rows).astype(np.int64)
            pairs, which = np.unique(np.stack([counts, pool[row]]), axis=1, return_inverse=True)
            for n in wanted:
                kept = np.flatnonzero((pool > 0) if replace else (pool >= n))
                usable = (pairs[1] > 0) if replace else (pairs[1] >= n)
                terms = np.zeros(pairs.shape[1])
                terms[usable] = expected_terms(pairs[0][usable], pairs[1][usable], n, replace)
                mean = np.bincount(row, weights=terms[which.reshape(-1)], minlength=batch.num_rows)
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([batch["dataset"].take(at), batch["key"].take(at), pa.array(np.full(len(kept), n, np.int64)), pa.array(mean[kept])], ["dataset", "key", "n", "jsd_mean"])

    rows = questions.select("dataset", "key", F.col("counts").cast("array<bigint>").alias("counts")).where(F.size("counts") > 0)
    return rows.mapInArrow(run, "dataset string, key string, n bigint, jsd_mean double")


def stop_size(points: Sequence[tuple[int, float]], epsilon: float = EPSILON, delta: float = DELTA) -> tuple[bool, int | None]:
    """Whether the points decide the converged size, and that size; undecided if a candidate lacks its two followers."""
    for i, (n, mean) in enumerate(points):
        if mean >= epsilon:
            continue
        after = [m for _, m in points[i + 1 : i + 3]]
        if len(after) < 2:
            return False, None
        if max(mean - m for m in after) <= delta:
            return True, n
    return False, None


def quantile_error(ordered: np.ndarray, q: float, z: float = 1.96) -> float | np.ndarray:
    """Half the distance of the order statistics that hold the quantile with 95 % confidence, whatever the law.

    ``ordered``: values in order, or rows of such.
    """
    b = ordered.shape[-1]
    half = z * np.sqrt(b * q * (1 - q))
    low, high = max(int(np.floor(b * q - half)) - 1, 0), min(int(np.ceil(b * q + half)), b - 1)
    return (ordered[..., high] - ordered[..., low]) / 2


WALK = "dataset string, key string, n bigint, jsd_mean double, jsd_p10 double, jsd_p90 double, replicates bigint, mean_error double, quantile_error double, convergence_n bigint"


def curve_walk(
    questions: DataFrame, sizes: Sequence[int] = SAMPLE_SIZES, replicates: int = 500, replace: bool = True, tolerance: float | None = None,
    epsilon: float = EPSILON, delta: float = DELTA, block: int = 100, seed: int = 42, whole: bool = False,
) -> DataFrame:
    """Drawn curve points, their error bounds and the converged size; one kernel walks the sizes of its questions.

    The walk of a question ends where the rule of ``stop_size`` is decided, unless the ``whole`` curve is
    wanted. A batch of questions is drawn and compared at once, see ``OptionCells``. With a
    ``tolerance`` a question's replicates come in blocks instead, and end as soon as the mean's and the
    percentiles' 95 % errors are within it. Draws need the option counts alone. Without replacement, sizes above the pool are left
    out. ``questions``: dataset, key, counts.
    """
    wanted = sorted(int(s) for s in sizes)

    def point(rng: np.random.Generator, counts: np.ndarray, n: int) -> tuple[float, ...]:
        share = counts / counts.sum()
        found = np.zeros(0)
        while len(found) < replicates:
            size = min(block, replicates - len(found))
            drawn = rng.multinomial(n, share, size=size) if replace else rng.multivariate_hypergeometric(counts, n, size=size, method="marginals")
            found = np.concatenate([found, _jsd_rows(drawn / n, share)])
            ordered = np.sort(found)
            errors = 1.96 * float(found.std(ddof=1)) / np.sqrt(len(found)) if len(found) > 1 else np.inf, max(quantile_error(ordered, 0.1), quantile_error(ordered, 0.9))
            if max(errors) <= tolerance:
                break
        low, high = np.percentile(found, [10, 90])
        return float(found.mean()), float(low), float(high), len(found), *errors

    def points(names: list[tuple], counts: list[np.ndarray], n: int) -> list[tuple[float, ...]]:
        if tolerance is not None:
            return [point(np.random.default_rng(_number(seed, *name, n)), c, n) for name, c in zip(names, counts)]
        d = OptionCells(names, counts, seed).replicates(n, replicates, replace)
        error = 1.96 * d.std(axis=1, ddof=1) / np.sqrt(replicates) if replicates > 1 else np.full(len(d), np.inf)
        edge = np.maximum(quantile_error(d, 0.1), quantile_error(d, 0.9))
        return list(zip(d.mean(axis=1).tolist(), ordered_percentile(d, 10).tolist(), ordered_percentile(d, 90).tolist(), [replicates] * len(d), error.tolist(), edge.tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = list(zip(pdf["dataset"], pdf["key"]))
            counts = [np.asarray(c, dtype=np.int64) for c in pdf["counts"]]
            pool = [int(c.sum()) for c in counts]
            rows: list[list[tuple]] = [[] for _ in names]
            state: list[tuple[bool, int | None]] = [(False, None)] * len(names)
            for n in wanted:
                going = [i for i in range(len(names)) if (whole or not state[i][0]) and (replace or n <= pool[i])]
                if not going:
                    continue
                for i, found in zip(going, points([names[i] for i in going], [counts[i] for i in going], n)):
                    rows[i].append((n, *found))
                    if not state[i][0]:
                        state[i] = stop_size([r[:2] for r in rows[i]], epsilon, delta)
            out = [(*name, *r, answer) for name, of, (_, answer) in zip(names, rows, state) for r in of]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in WALK.split(", ")])
            yield frame.astype({"convergence_n": "Int64"})

    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = questions.select("dataset", "key", F.col("counts").cast("array<bigint>").alias("counts")).where(total > 0)
    return spread(rows, ["dataset", "key"]).mapInPandas(run, WALK)


def walk_convergence(walk: DataFrame) -> DataFrame:
    """dataset, key, convergence_n of a walk; a question without an answer keeps a null."""
    return walk.groupBy("dataset", "key").agg(F.max("convergence_n").alias("convergence_n"))
