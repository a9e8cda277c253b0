"""Ranks, quantiles and prefix aggregates that never sort a whole group in one task.

A plain window over a group sorts that group in one task, which fails when one key
holds a large share of the rows. The helpers here split a group into ordered cells,
aggregate the cells first (a bounded table), and only then look inside a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def _cell(value: Column, lo: Column, hi: Column, cells: int) -> Column:
    width = F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return F.least(F.floor(width * cells), F.lit(cells - 1)).cast("int")


def _with_cells(df: DataFrame, by: list[str], value: str, cells: int, bounds=None) -> DataFrame:
    """Add ``_cell``: the value's position between its group's minimum and maximum.

    With known ``bounds`` no pass for the ends is needed; values outside go to the end cells.
    """
    if bounds is not None:
        lo, hi = (F.lit(float(b)) for b in bounds)
        cell = _cell(F.greatest(lo, F.least(hi, F.col(value))), lo, hi, cells)
        return df.withColumn("_cell", F.when(F.col(value).isNotNull(), cell))
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))
    return joined.withColumn("_cell", _cell(F.col(value), F.col("_lo"), F.col("_hi"), cells)).drop("_lo", "_hi")


def _before(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def rank_within(
    df: DataFrame, by: list[str], score: str, ties: Sequence[str], name: str = "rank", cells: int = CELLS, bounds=None
) -> DataFrame:
    """1-based rank by descending ``score`` (NULL last), then by ``ties`` ascending.

    Rows are ranked inside score cells; the number of rows in better cells is added.
    At most ``cells`` rows per group enter the offset window.
    """
    d = df.withColumn("_s", -F.coalesce(F.col(score), F.lit(-1.0e300)))
    d = d.withColumn("_k", F.when(F.col(score).isNull(), None).otherwise(F.col("_s")))
    if bounds is not None:
        bounds = (-bounds[1], -bounds[0])
    d = _with_cells(d, by, "_k", cells, bounds).withColumn("_cell", F.coalesce(F.col("_cell"), F.lit(cells)))
    counts = d.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(_before(by, "_cell")), F.lit(0))
    ).drop("_n")
    w = Window.partitionBy(*by, "_cell").orderBy("_s", *ties)
    return (
        d.join(offsets, [*by, "_cell"])
        .withColumn(name, F.row_number().over(w) + F.col("_off"))
        .drop("_s", "_k", "_cell", "_off")
    )


def dense_index(df: DataFrame, by: list[str], key: str, name: str = "idx") -> DataFrame:
    """0-based index of each row in its group, ordered by (md5 prefix of key, key).

    The hash prefix spreads a hot group over 256 buckets of about equal size.
    """
    d = df.withColumn("_b", F.substring(F.md5(F.col(key)), 1, 2))
    counts = d.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(_before(by, "_b")), F.lit(0))
    ).drop("_n")
    w = Window.partitionBy(*by, "_b").orderBy(key)
    return (
        d.join(offsets, [*by, "_b"])
        .withColumn(name, F.row_number().over(w) - 1 + F.col("_off"))
        .drop("_b", "_off")
    )


def quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], cells: int = CELLS, bounds=None, higher: bool = False
) -> DataFrame:
    """Exact quantiles per group, one column per named probability.

    Between two values they are interpolated linearly, or take the ``higher`` one.

    Equal values are counted before anything is ordered, so a value shared by many rows
    costs one row. Cell counts give the cells holding the wanted ranks, and only their
    values are ordered.
    """
    values = (
        df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    )
    d = _with_cells(values, by, "_v", cells, bounds)
    # at most `cells` rows per group reach this window
    per_cell = (
        d.groupBy(*by, "_cell").agg(F.sum("_n").alias("_cn"))
        .withColumn("_off", F.coalesce(F.sum("_cn").over(_before(by, "_cell")), F.lit(0)))
        .withColumn("_total", F.sum("_cn").over(Window.partitionBy(*by)))
    )
    # the ranks each probability needs, kept on the cells that hold one of them
    positions = F.array(
        *[
            F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(float(x))).alias("pos"))
            for i, x in enumerate(probs.values())
        ]
    )
    end = F.col("_off") + F.col("_cn")
    holds = lambda r: (r >= F.col("_off")) & (r < end)
    wanted = F.filter(positions, lambda w: holds(F.floor(w["pos"])) | holds(F.ceil(w["pos"])))
    targets = per_cell.withColumn("_w", wanted).where(F.size("_w") > 0).select(*by, "_cell", "_off", "_w")
    inside = d.join(targets, [*by, "_cell"]).withColumn(
        "_start", F.col("_off") + F.coalesce(F.sum("_n").over(_before([*by, "_cell"], "_v")), F.lit(0))
    )
    here = lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_n"))
    found = inside.withColumn("_w", F.explode("_w")).select(
        *by, F.col("_w.i").alias("_i"), F.col("_w.pos").alias("_pos"), "_v",
        here(F.floor("_w.pos")).alias("_lo"), here(F.ceil("_w.pos")).alias("_hi"),
    ).where("_lo OR _hi")
    pick = lambda i, side: F.max(F.when((F.col("_i") == i) & F.col(side), F.col("_v")))
    frac = lambda i: F.max(F.when(F.col("_i") == i, F.col("_pos") - F.floor("_pos")))
    return found.groupBy(*by).agg(
        *[
            (pick(i, "_hi") if higher else pick(i, "_lo") + (pick(i, "_hi") - pick(i, "_lo")) * frac(i)).alias(name)
            for i, name in enumerate(probs)
        ]
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First k rows per group. The rank filter lets Spark cut each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(rank or "_rn", F.row_number().over(w)).where(F.col(rank or "_rn") <= k)
    return out if rank else out.drop("_rn")


def max_before(df: DataFrame, order: str, value: str, name: str, cells: int = CELLS) -> DataFrame:
    """Maximum of ``value`` over rows with a strictly smaller ``order`` (whole table)."""
    d = _with_cells(df, [], order, cells)
    per_cell = d.groupBy("_cell").agg(F.max(value).alias("_m"))
    # at most `cells` rows
    per_cell = per_cell.withColumn(
        "_head", F.max("_m").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    ).drop("_m")
    strict = (
        d.groupBy("_cell", order)
        .agg(F.max(value).alias("_m"))
        .withColumn(
            "_in",
            F.max("_m").over(
                Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("_cell", order, "_in")
    )
    return (
        d.join(strict, ["_cell", order])
        .join(F.broadcast(per_cell), "_cell")
        .withColumn(name, F.greatest("_in", "_head"))
        .drop("_cell", "_in", "_head")
    )


# --- opt-in approximations --------------------------------------------------------------

#: Size of a quantile sketch; its rank error is about 1.3 % at 200 and shrinks almost in proportion.
SKETCH = 800


def quantile_sketch(df: DataFrame, by: list[str], value: str, k: int = SKETCH) -> DataFrame:
    """by, sketch: a mergeable quantile sketch (KLL) of ``value`` per group, of bounded size.

    Sketches are made map-side, may be stored per partition of a table, and merge to any coarser
    group without the values (``merged_sketches``).
    """
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str], k: int = SKETCH) -> DataFrame:
    """by, sketch of coarser groups from the sketches of finer ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """One column per named probability, a value whose rank is near it; ends are exact."""
    return sketches.select(*by, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])


def approx_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], k: int = SKETCH) -> DataFrame:
    """``quantiles`` by sketch: one aggregation of bounded state in place of ordering cells; not interpolated."""
    return sketch_quantiles(quantile_sketch(df, by, value, k), by, probs)
