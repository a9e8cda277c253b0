"""Approximate nearest neighbours by inner product on shifted Hilbert orderings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Curves of ``COORDINATES`` projected coordinates each; a query probes those where its projection is longest.
CURVES, COORDINATES, PROBES = 32, 3, 16
#: Vectors are ordered in bands of equal numbers by their distance from the mean; a query is put in every
#: band, in its own direction, at this many times the band's radius.
BANDS, REACH = 4, 1.4
#: A probe reads at least this share of a band, in blocks of the ordering of bounded size.
SHARE = 0.05
BLOCK_ROWS, MAX_BLOCK_ROWS, SIDE = 512, 8192, 1
BITS = 13
EVERY, TOP = 20, 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates (one row each)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | (((v ^ turn) >> level) & 1)
    return key


def windows(rows: int) -> tuple[int, int]:
    """Rows of a block, and blocks that a probe reads on each side of its own, for ``rows`` distinct vectors.

    A window holds at least ``SHARE`` of a band. Up to about 120,000 rows it is 3 blocks of 512; then
    blocks grow to ``MAX_BLOCK_ROWS``, which bounds the memory of a task; then more blocks are read.
    """
    wanted = int(np.ceil(SHARE * rows / BANDS))
    block = min(max(BLOCK_ROWS, -(-wanted // (2 * SIDE + 1))), MAX_BLOCK_ROWS)
    return block, max(SIDE, -(-(-(-wanted // block) - 1) // 2))


def curve_keys(vectors: np.ndarray, curves: int = CURVES) -> tuple[np.ndarray, np.ndarray]:
    """Keys and projected lengths of vectors (one row each, of about unit variance a component) on every curve.

    Coordinates come in groups of ``COORDINATES`` from random rotations, as many as the curves need;
    every curve has a shift of its own.
    """
    dim = vectors.shape[1]
    rng = np.random.default_rng([dim, 17])
    turned = []
    while sum(t.shape[1] for t in turned) < COORDINATES * curves:
        turned.append(vectors @ np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    y = np.concatenate(turned, axis=1)[:, : COORDINATES * curves].reshape(len(vectors), curves, COORDINATES)
    shift = rng.random((curves, COORDINATES)) * 0.25
    cells = np.clip((y + 4 + shift) / 8.25 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    keys = hilbert_keys(cells.reshape(-1, COORDINATES), BITS).reshape(len(vectors), curves)
    return keys, np.linalg.norm(y, axis=2)


@dataclass
class Layout:
    """Where vectors of one length lie: their mean, and the edges and radii of the bands round it."""

    mean: np.ndarray
    edges: np.ndarray
    radii: np.ndarray

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band and keys of vectors as candidates."""
        z = vectors - self.mean
        radius = np.linalg.norm(z, axis=1)
        band = np.searchsorted(self.edges, radius)
        unit = np.maximum(self.radii[band], np.finfo(float).tiny) / np.sqrt(vectors.shape[1])
        return band, curve_keys(z / unit[:, None])[0]

    @staticmethod
    def query_keys(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of vectors as queries, the same in every band, and which curves they probe.

        What counts is the product with a candidate's difference from the mean, so only the
        direction of the whole vector matters.
        """
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        keys, lengths = curve_keys(vectors / size * REACH * np.sqrt(vectors.shape[1]))
        return keys, np.argsort(np.argsort(-lengths, axis=1), axis=1) < PROBES


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _layouts(classes: DataFrame) -> dict[int, Layout]:
    """The layout of every length, from one pass for the means and one for the radii."""
    parts = classes.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x"))
    means: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("dim", "at").agg(F.avg(F.col("x").cast("double")).alias("m")).collect():  # one row per component
        means.setdefault(r.dim, {})[r["at"]] = r.m
    mean = {dim: np.array([m[i] for i in range(dim)]) for dim, m in means.items()}

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["v"].value_lengths().to_numpy()
            for dim in np.unique(sizes):
                some = batch.filter(pa.array(sizes == dim))
                r = np.linalg.norm(_matrix(some["v"]) - mean[int(dim)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), dim, np.int64)), pa.array(r)], ["dim", "r"])

    at = [i / (2 * BANDS) for i in range(1, 2 * BANDS)]
    found = classes.select("v").mapInArrow(radii, "dim bigint, r double").groupBy("dim").agg(F.percentile_approx("r", F.array(*map(F.lit, at)), 10_000).alias("q"))
    return {r.dim: Layout(mean[r.dim], np.array(r.q[1::2]), np.array(r.q[::2])) for r in found.collect()}  # one row per length


def nearest(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id is divisible by ``every`` its ``top`` nearest found.

    The largest inner product is sought, so lengths and the mean matter: distinct vectors less their mean
    are parted in ``BANDS`` bands by length, and within a band put in order along ``CURVES`` Hilbert
    curves of ``COORDINATES`` projected coordinates, range-partitioned by (curve, key) and cut into
    blocks of equal size. A query is put in every band in its own direction and reads its block and
    blocks on each side (``windows``) of the curves where its projection is longest; what it finds
    there is merged and ranked by the inner product in double precision. Only ids and keys are
    ordered; vectors join the blocks afterwards. Windows hold a fixed share of the rows at least,
    so that recall does not fall as rows are added; the work is queries times rows.

    Equal vectors are one entry; of each at most ``top`` + 1 smallest ids can be in a result, and
    only those are expanded. Ties go to the smaller id. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null id, take no part. Vectors of different
    lengths are never compared. Repeated rows are one candidate. An empty table gives no rows; other
    columns are not read.
    """
    kind = vectors.schema[vec].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(f"`{vec}`").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v"))).distinct()
    asks = F.pmod("id", F.lit(every)) == 0
    classes = written(rows.groupBy("v").agg(F.min("id").alias("cls"), F.max(asks).alias("asks")), "nn-classes")
    ids = written(rows.join(classes.select("v", "cls"), "v").select("id", "cls"), "nn-ids")
    layouts = _layouts(classes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries(cls: pa.Array, row: np.ndarray, curve: np.ndarray, key: np.ndarray, ask: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(curve), pa.array(key), cls.take(pa.array(row)), pa.array(np.full(len(row), ask))], ["curve", "key", "cls", "ask"])

        for batch in batches:
            sizes = batch["v"].value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                first = int(dim) * BANDS * CURVES
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    x = _matrix(some["v"])
                    band, keys = layouts[int(dim)].keys(x)
                    curve = first + band[:, None] * CURVES + np.arange(CURVES)
                    yield entries(some["cls"], np.repeat(np.arange(len(x)), CURVES), curve.reshape(-1), keys.reshape(-1), False)
                    asking = np.flatnonzero(some["asks"].to_numpy(zero_copy_only=False))
                    if len(asking):
                        keys, probe = Layout.query_keys(x[asking])
                        row, c = np.nonzero(probe)
                        for b in range(BANDS):
                            yield entries(some["cls"], asking[row], first + b * CURVES + c, keys[row, c], True)

    schema = "curve bigint, key bigint, cls bigint, ask boolean"
    placed = classes.select("cls", "asks", "v").mapInArrow(place, schema)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("cls")
    ordered = placed.withColumn("tie", tie).repartitionByRange(parts, "curve", "key", "tie").sortWithinPartitions("curve", "key", "tie").drop("tie")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every entry with the number of candidates before it in its partition."""
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = ~batch["ask"].to_numpy(zero_copy_only=False)
            upto = at + np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(upto - own)], [*batch.schema.names, "part", "at"])
            at = int(upto[-1]) if len(own) else at

    index = written(ordered.mapInArrow(number, f"{schema}, part int, at bigint"), "nn-index")
    sizes = {r.part: r.n for r in index.groupBy("part").agg(F.count_if(~F.col("ask")).alias("n")).collect()}  # one row per partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offset = F.lit(0).cast("bigint")
    if before:
        offset = F.element_at(F.create_map(*[F.lit(x) for p in before for x in (p, before[p])]), F.col("part")).cast("bigint")
    block_rows, side = windows(total // CURVES)
    index = index.withColumn("block", F.floor((offset + F.col("at")) / block_rows).cast("bigint"))
    near = F.when(F.col("ask"), F.sequence(F.col("block") - side, F.col("block") + side)).otherwise(F.array("block"))
    both = index.select(F.explode(near).alias("block"), "curve", "cls", "ask").join(classes.select("cls", "v"), "cls")

    def search(table: pa.Table) -> pa.Table:
        ask, curve = table["ask"].to_numpy(), table["curve"].to_numpy()
        cls = table["cls"].to_numpy()
        out: list[list] = [[], [], []]
        for c in np.unique(curve[ask]):
            q, e = np.flatnonzero(ask & (curve == c)), np.flatnonzero(~ask & (curve == c))
            if not len(e):
                continue
            e = e[np.argsort(cls[e])]  # ties go to the smaller id
            there = _matrix(table["v"].take(pa.array(e)))
            for a in range(0, len(q), 512):
                scores = _matrix(table["v"].take(pa.array(q[a : a + 512]))) @ there.T
                k = min(top + 1, len(e))
                least = np.partition(scores, len(e) - k, axis=1)[:, len(e) - k]
                row, col = np.nonzero(scores >= least[:, None])
                order = np.lexsort((col, -scores[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[rank < k].reshape(-1, k), col[rank < k].reshape(-1, k)
                out[0] += cls[q[a : a + 512]].tolist()
                out[1] += list(cls[e][col])
                out[2] += list(scores[row, col])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))], names=["q", "c", "s"])

    found = both.groupBy("block").applyInArrow(search, "q bigint, c array<bigint>, s array<double>")
    pairs = found.select("q", F.explode(F.arrays_zip("c", "s")).alias("x")).groupBy("q", F.col("x.c").alias("c")).agg(F.max("x.s").alias("score"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "c")
    pairs = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).drop("r")
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= top + 1)
    named = pairs.join(first.select(F.col("cls").alias("c"), "id"), "c")
    closest = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    named = named.withColumn("r", F.row_number().over(closest)).where(F.col("r") <= top + 1)
    lists = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))  # at most top + 1 each
    queries = ids.where(asks).select(F.col("id").alias("query_id"), F.col("cls").alias("q")).join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, top)
    return queries.select("query_id", F.posexplode(others).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")
    )
