"""BCa bootstrap intervals of any statistic, over groups of any size.

A statistic is a state that adds up over rows, each times a weight, and a value made from it.
A bootstrap replicate weighs every row by how often it was drawn, and a jackknife value leaves
the rows of a block out; both are sums of states, so a large group is cut into chunks whose
states are merged. Groups that fit into one chunk are finished there, row by row where the
statistic has a row form, and there any callable will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special as SP
from .resample import CHUNK_ROWS, BLOCK_DRAWS, _number, arrow_schema, in_order

#: Blocks that the jackknife of a group leaves out one at a time; a group of fewer rows leaves out rows.
JACKKNIFE = 1000
#: Points of the grid of quantiles, dense round the middle, that part a column into cells, and cells of each side of
#: a joint table, in groups of several chunks.
GRID, JOINT = 1024, 24
FEWEST = 5

Rows = np.ndarray  # rows x columns
Weights = np.ndarray  # samples x rows


@dataclass(frozen=True)
class Statistic:
    """A statistic of ``columns`` value columns.

    ``state(rows, weights, frame)`` gives one state per sample, ``finish(states, frame)`` its values.
    ``frame`` holds what the group fixes beforehand: the mean of every column, and edges between
    cells. ``exact(rows, weights)``, where given, gives the values of a group of up to ``exact_rows``
    rows that lies in one place.
    """

    name: str
    columns: int
    state: Callable[[Rows, Weights, dict], np.ndarray] | None
    finish: Callable[[np.ndarray, dict], np.ndarray] | None
    exact: Callable[[Rows, Weights], np.ndarray] | None = None
    exact_rows: int = CHUNK_ROWS

    def whole(self, rows: Rows, weights: Weights) -> np.ndarray:
        if self.exact is not None:
            return self.exact(rows, weights)
        frame = {"centre": rows.mean(axis=0)}
        return self.finish(self.state(rows, weights, frame), frame)


def _terms(rows: Rows, frame: dict) -> np.ndarray:
    x = rows - frame["centre"]
    return np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]])


def _moments(rows: Rows, weights: Weights, frame: dict) -> np.ndarray:
    return weights @ _terms(rows, frame)


def _mean(s: np.ndarray, frame: dict) -> np.ndarray:
    return frame["centre"][0] + s[:, 1] / s[:, 0]


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.where(bottom != 0, top / np.where(bottom != 0, bottom, 1.0), 0.0)


def _cv(s: np.ndarray, frame: dict) -> np.ndarray:
    """Sample deviation over the mean."""
    n, m = s[:, 0], s[:, 1] / s[:, 0]
    spread = np.sqrt(np.maximum(s[:, 2] - n * m * m, 0.0) / np.maximum(n - 1, 1))
    return _ratio(spread, frame["centre"][0] + m)


def _correlation(s: np.ndarray, frame: dict) -> np.ndarray:
    n, x, y, xx, xy, yy = s.T
    return _ratio(n * xy - x * y, np.sqrt(np.maximum(n * xx - x * x, 0.0) * np.maximum(n * yy - y * y, 0.0)))


def _median_exact(rows: Rows, weights: Weights) -> np.ndarray:
    order = np.argsort(rows[:, 0], kind="stable")
    x, run = rows[order, 0], np.cumsum(weights[:, order], axis=1)
    total = run[:, -1]
    at = [(run < np.floor((total + i) / 2)[:, None]).sum(axis=1) for i in (1, 2)]
    return (x[at[0]] + x[at[1]]) / 2


def _counted(cell: np.ndarray, weights: Weights, cells: int) -> np.ndarray:
    """Weights added up per cell, samples x cells."""
    order = np.argsort(cell, kind="stable")
    run = np.concatenate([np.zeros((len(weights), 1)), np.cumsum(weights[:, order], axis=1)], axis=1)
    return np.diff(run[:, np.searchsorted(cell[order], np.arange(cells + 1))], axis=1)


def _cell_of(rows: Rows, frame: dict) -> tuple[np.ndarray, int]:
    """The cell of every row, and how many there are: of one column, or of the joint table of two."""
    at = [np.searchsorted(edges, rows[:, i]) for i, edges in enumerate(frame["edges"])]
    wide = [len(edges) + 1 for edges in frame["edges"]]
    return (at[0], wide[0]) if len(at) == 1 else (at[0] * wide[1] + at[1], wide[0] * wide[1])


def _cells(rows: Rows, weights: Weights, frame: dict) -> np.ndarray:
    cell, cells = _cell_of(rows, frame)
    return _counted(cell, weights, cells)


def _median_of_cells(s: np.ndarray, frame: dict) -> np.ndarray:
    """The upper edges, which are values of the column, of the cells that hold the middle ranks."""
    edges, run = np.asarray(frame["edges"][0]), np.cumsum(np.rint(s), axis=1)
    total = run[:, -1]
    at = [np.minimum((run < np.floor((total + i) / 2)[:, None]).sum(axis=1), len(edges) - 1) for i in (1, 2)]
    return (edges[at[0]] + edges[at[1]]) / 2


def _tau_of_table(table: np.ndarray) -> np.ndarray:
    """Kendall's tau-b of joint counts, samples x rows x columns, in order of the values."""
    below = np.zeros_like(table)
    below[:, 1:, 1:] = np.cumsum(np.cumsum(table, axis=1), axis=2)[:, :-1, :-1]
    beside = np.zeros_like(table)
    mirrored = np.cumsum(np.cumsum(table, axis=1)[:, :, ::-1], axis=2)[:, :, ::-1]
    beside[:, 1:, :-1] = mirrored[:, :-1, 1:]
    score = (table * (below - beside)).sum(axis=(1, 2))
    pairs = lambda c: (c * (c - 1) / 2).sum(axis=1)
    n = table.sum(axis=(1, 2))
    all_ = n * (n - 1) / 2
    return _ratio(score, np.sqrt((all_ - pairs(table.sum(axis=2))) * (all_ - pairs(table.sum(axis=1)))))


def _block_states(stat: Statistic, rows: Rows, block: np.ndarray, blocks: int, frame: dict) -> np.ndarray:
    """The state of the rows of every block of the jackknife, blocks x state; every row is looked at once."""
    if stat.state is _moments:
        return np.column_stack([np.bincount(block, weights=t, minlength=blocks) for t in _terms(rows, frame).T])
    if stat.state is _cells:
        cell, cells = _cell_of(rows, frame)
        return np.bincount(block * cells + cell, minlength=blocks * cells).reshape(blocks, cells).astype(float)
    return np.concatenate([stat.state(rows[block == j], np.ones((1, int((block == j).sum()))), frame) for j in range(blocks)])


def _tau_of_cells(s: np.ndarray, frame: dict) -> np.ndarray:
    return _tau_of_table(np.rint(s).reshape(len(s), len(frame["edges"][0]) + 1, -1))


def _tau_exact(rows: Rows, weights: Weights) -> np.ndarray:
    """Pairs of rows are compared once, for all samples at once."""
    sign = np.sign(rows[:, None, 0] - rows[None, :, 0]), np.sign(rows[:, None, 1] - rows[None, :, 1])
    weigh = lambda m: np.einsum("bi,bi->b", weights @ m, weights)
    return _ratio(weigh(sign[0] * sign[1]), np.sqrt(weigh(sign[0] ** 2) * weigh(sign[1] ** 2)))


STATISTICS = {
    s.name: s
    for s in (
        Statistic("mean", 1, _moments, _mean),
        Statistic("cv", 1, _moments, _cv),
        Statistic("median", 1, _cells, _median_of_cells, _median_exact),
        Statistic("correlation", 2, _moments, _correlation),
        Statistic("tau", 2, _cells, _tau_of_cells, _tau_exact, 1000),
    )
}


def of_callable(fn: Callable[..., float], columns: int = 1) -> Statistic:
    """A statistic from a function of one array per column. It has no state, so its groups must fit a chunk."""

    def exact(rows: Rows, weights: Weights) -> np.ndarray:
        drawn = [np.repeat(rows, w.astype(np.int64), axis=0) for w in weights]
        return np.array([float(fn(*d.T)) for d in drawn])

    return Statistic(getattr(fn, "__name__", "statistic"), columns, None, None, exact)


def draw_weights(rng: np.random.Generator, rows: int, drawn: np.ndarray) -> np.ndarray:
    """How often each of ``rows`` is drawn in samples of ``drawn`` draws each. A sample at a time where samples are
    long, so that its counts stay in the cache; the draws are the same."""
    if rows > 2000:
        out = np.empty((len(drawn), rows))
        for i, n in enumerate(drawn):
            out[i] = np.bincount(rng.integers(0, rows, int(n)), minlength=rows)
        return out
    at = np.repeat(np.arange(len(drawn)), drawn) * rows + rng.integers(0, rows, int(drawn.sum()))
    return np.bincount(at, minlength=len(drawn) * rows).reshape(len(drawn), rows).astype(float)


def bca(estimate: float, replicates: np.ndarray, jackknife: np.ndarray, confidence: float = 0.95) -> tuple[float, float]:
    """Ends of the BCa interval from the estimate, the replicates and the jackknife values."""
    r = len(replicates)
    low, high = 1.0 / (r + 1), r / (r + 1.0)
    clamp = lambda p: min(high, max(low, p))
    z0 = SP.normal_quantile_number(clamp(float(np.mean(np.round(replicates, 12) < round(estimate, 12)))))
    d = jackknife.mean() - jackknife
    squares = float((d * d).sum())
    a = float((d**3).sum()) / (6.0 * squares**1.5) if squares > 1e-300 else 0.0
    ordered, ends = np.sort(replicates), []
    for q in ((1.0 - confidence) / 2.0, (1.0 + confidence) / 2.0):
        z = z0 + SP.normal_quantile_number(q)
        p = 0.5 if 1.0 - a * z == 0 else SP.normal_cdf_number(z0 + z / (1.0 - a * z))
        ends.append(float(ordered[min(int(clamp(p) * r), r - 1)]))
    return ends[0], ends[1]


def statistic_ci(
    df: DataFrame, by: list[str], key: str, values: Sequence[str], statistic: Statistic | str = "mean", resamples: int = 2000, seed: int = 42,
    confidence: float = 0.95, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """by, estimate, n, ci_lower, ci_upper of a statistic of ``values`` per group; groups below five rows are left out.

    ``statistic``: a name of ``STATISTICS``, a ``Statistic``, or ``of_callable(fn)``. A group of up to
    ``chunk_rows`` rows is one task's work and exact. A larger one is split by hash of its key:
    every chunk derives the same split of the draws from the group's seed and returns one state per
    replicate and per jackknife block; states are added up by Spark, and no task holds more than about
    ``chunk_rows`` rows. There the median is the upper edge of a cell, within a sixteenth of its
    standard error, and tau (in groups of over 1,000 rows) is that of a table of ``JOINT`` by ``JOINT``
    cells. Both are exact where every value near the middle, or every value, holds a cell's share of
    the rows, as answers on a scale do; moments are exact. Rows with a null value are left out; results do not depend on the partitioning.
    """
    stat = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    if len(values) != stat.columns:
        raise ValueError(f"{stat.name} takes {stat.columns} value columns, not {len(values)}")
    x = [f"_x{i}" for i in range(len(values))]
    d = df.select(*by, F.col(key).cast("string").alias("_key"), *[F.col(v).cast("double").alias(c) for v, c in zip(values, x)]).dropna(subset=x)
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= FEWEST)
    sized = d.join(sizes, by)
    kept = [df.schema[c] for c in by]
    out = T.StructType(kept + [T.StructField("estimate", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType())])

    arrow = arrow_schema(out)

    def whole(keys: tuple[Any, ...], group: pa.Table) -> pa.Table:
        keys = [k.as_py() for k in keys]
        rows = in_order(group, x)
        n = len(rows)
        rng = np.random.default_rng(_number(seed, *[str(k) for k in keys]))
        step = max(1, BLOCK_DRAWS // n)
        found = [stat.whole(rows, draw_weights(rng, n, np.full(min(step, resamples - a), n))) for a in range(0, resamples, step)]
        block = np.arange(n) % min(n, JACKKNIFE)
        left_out = [
            stat.whole(rows, (block[None, :] != np.arange(a, min(a + step, int(block.max()) + 1))[:, None]).astype(float)) for a in range(0, int(block.max()) + 1, step)
        ]
        estimate = float(stat.whole(rows, np.ones((1, n)))[0])
        low, high = bca(estimate, np.concatenate(found), np.concatenate(left_out), confidence)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((*keys, estimate, n, low, high), arrow)], schema=arrow)

    one_place = min(chunk_rows, stat.exact_rows) if stat.exact else chunk_rows
    small = sized.where(F.col("_n") <= one_place).groupBy(*by).applyInArrow(whole, out)
    if stat.state is None:
        too_large = sizes.where(F.col("_n") > one_place)
        check = F.raise_error(F.lit(f"{stat.name} has no state to merge: a group has more than {one_place} rows"))
        return small.unionByName(too_large.select(*by, check.cast("double").alias("estimate"), F.col("_n").alias("n"), F.lit(0.0).alias("ci_lower"), F.lit(0.0).alias("ci_upper")))
    return small.unionByName(_large(sized.where(F.col("_n") > one_place), by, x, stat, resamples, seed, confidence, chunk_rows, out))


#: Where the quantiles of the grid lie: the nearer the middle, the closer.
_POINTS = [0.5 + 0.5 * t**3 for t in np.linspace(-1, 1, GRID + 1)[1:-1]]


def _edges(stat: Statistic, x: list[str]) -> list:
    """Values that part each column into cells."""
    if len(x) == 1:
        return [F.percentile_approx(x[0], F.array(*[F.lit(float(p)) for p in _POINTS]), 50_000)]
    return [F.percentile_approx(c, F.array(*[F.lit(i / JOINT) for i in range(1, JOINT + 1)]), 10_000) for c in x]


def _frame(fixed: dict) -> dict:
    frame: dict = {"centre": np.asarray(fixed["centre"], float)}
    if fixed.get("edges") is not None:
        edges = [np.asarray(e, float) for e in fixed["edges"]]
        if len(edges) == 1:  # six deviations of the middle rank on either side
            edges = [edges[0][np.abs(np.array(_POINTS) - 0.5) <= 3.0 / np.sqrt(fixed["size"])]]
        frame["edges"] = [np.unique(e) for e in edges]
    return frame


def _large(sized: DataFrame, by: list[str], x: list[str], stat: Statistic, resamples: int, seed: int, confidence: float, chunk_rows: int, out: T.StructType) -> DataFrame:
    """The groups of several chunks: states per chunk, added up, finished per group.

    The few sums of a moment travel as columns, which a hash aggregation adds up; the counts of many cells travel
    as one array per sample.
    """
    needs_edges, blocks = stat.state is not _moments, JACKKNIFE
    frames = sized.groupBy(*by).agg(
        F.max("_n").alias("_size"),
        F.array(*[F.avg(c) for c in x]).alias("_centre"),
        (F.array(*_edges(stat, x)) if needs_edges else F.lit(None).cast("array<array<double>>")).alias("_edges"),
    )
    # texts stay behind: a number orders the rows of a chunk, another one deals them to the blocks of the jackknife
    d = sized.select(
        *by, *x, F.xxhash64("_key").alias("_key"), F.pmod(F.xxhash64(F.lit("block"), "_key"), F.lit(blocks)).cast("int").alias("_block"),
        F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / chunk_rows)).cast("int").alias("_chunk"),
    )
    chunks = d.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_m"))
    layout = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_m"))).alias("_l"))  # one entry per chunk
    fixed = [F.col(f"_{c}").alias(c) for c in ("size", "centre", "edges")]
    head = layout.join(frames, by).select(*by, F.to_json(F.struct(F.col("_l._chunk").alias("ids"), F.col("_l._m").alias("sizes"), *fixed)).alias("_head"))
    # what a group fixes travels on one row per chunk, as text: a null text costs the other rows nothing, a null array much
    empty = [F.lit(None).cast("double").alias(c) for c in x]
    first = chunks.select(*by, "_chunk").join(head, by).select(*by, "_chunk", F.lit(0).cast("bigint").alias("_key"), F.lit(0).alias("_block"), *empty, "_head")
    rows = d.select(*by, "_chunk", "_key", "_block", *x, F.lit(None).cast("string").alias("_head"))
    kept = out.fields[: len(by)]
    sums = [f"_s{i}" for i in range(1 + len(x) + len(x) * (len(x) + 1) // 2)]
    state_fields = [T.StructField("state", T.ArrayType(T.DoubleType()))] if needs_edges else [T.StructField(c, T.DoubleType()) for c in sums]
    state_schema = T.StructType([*kept, T.StructField("b", T.IntegerType()), *state_fields])
    arrow, last = arrow_schema(state_schema), arrow_schema(out)

    def states(keys: tuple[Any, ...], group: pa.Table) -> pa.Table:
        """One state per replicate, per jackknife block left out, and of all rows, in this order of ``b``."""
        keys = [k.as_py() for k in keys]
        top = json.loads(group.filter(group["_head"].is_valid())["_head"][0].as_py())
        own = group.filter(group["_head"].is_null())
        both = in_order(own, [*x, "_block"])
        data, block = np.ascontiguousarray(both[:, :-1]), both[:, -1].astype(np.int64)
        frame = _frame(top)
        sizes_ = np.asarray(top["sizes"], dtype=np.int64)
        n, m = int(sizes_.sum()), len(data)
        named = [str(k) for k in keys[:-1]]
        mine = top["ids"].index(keys[-1])
        split = np.random.default_rng(_number(seed, *named)).multinomial(n, sizes_ / n, size=resamples)[:, mine]
        rng = np.random.default_rng(_number(seed, *named, keys[-1], "rows"))
        step = max(1, BLOCK_DRAWS // m)
        parts = [stat.state(data, draw_weights(rng, m, split[a : a + step]), frame) for a in range(0, resamples, step)]
        whole_ = stat.state(data, np.ones((1, m)), frame)
        made = np.concatenate([*parts, whole_ - _block_states(stat, data, block, blocks, frame), whole_])
        many = len(made)
        columns = [pa.array([k] * many, f.type) for k, f in zip(keys[:-1], arrow)] + [pa.array(np.arange(many, dtype=np.int32))]
        if needs_edges:
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel())))
        else:
            columns += [pa.array(np.ascontiguousarray(c)) for c in made.T]
        return pa.Table.from_arrays(columns, schema=arrow)

    parts = rows.unionByName(first).groupBy(*by, "_chunk").applyInArrow(states, state_schema)
    if needs_edges:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        total = parts.withColumn("state", array_to_vector("state")).groupBy(*by, "b").agg(Summarizer.sum(F.col("state")).alias("state")).withColumn("state", vector_to_array("state"))
    else:
        total = parts.groupBy(*by, "b").agg(*[F.sum(c).alias(c) for c in sums]).select(*by, "b", F.array(*sums).alias("state"))
    # what a group fixes travels on the row of its whole state
    total = total.join(frames.select(*by, F.lit(resamples + blocks).alias("b"), F.to_json(F.struct(*fixed)).alias("_head")), [*by, "b"], "left")

    def finish(keys: tuple[Any, ...], group: pa.Table) -> pa.Table:
        # resamples + JACKKNIFE + 1 rows
        keys = [k.as_py() for k in keys]
        group = group.sort_by("b").combine_chunks()
        fixed = json.loads(group["_head"][-1].as_py())
        value = stat.finish(group["state"].chunk(0).flatten().to_numpy().reshape(group.num_rows, -1), _frame(fixed))
        estimate = float(value[-1])
        low, high = bca(estimate, value[:resamples], value[resamples:-1], confidence)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((*keys, estimate, fixed["size"], low, high), last)], schema=last)

    return total.groupBy(*by).applyInArrow(finish, out)
