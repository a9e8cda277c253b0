"""Whitening of embeddings by principal components, found with a block Jacobi-Davidson method.

The covariance is never formed: all that is asked of the data are its centred products with a
few vectors, each one pass over the rows. A small search space is kept on the driver (dimension
x some tens of vectors). Its Rayleigh-Ritz pairs are corrected by solving, with MINRES, the
correction equations projected against them; all equations advance together, so an inner step
is one pass. Pairs are locked as their residuals reach double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 32
#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64.0, 1_000_000
#: Vectors beyond the wanted ones in the first search space, inner steps of an outer one at most, outer steps at most.
EXTRA, INNER, OUTER = 8, 8, 60
#: Matrix cells that a task works on at once.
CELLS = 1 << 21
EPS = float(np.finfo(np.float64).eps)

Product = Callable[[np.ndarray], np.ndarray]


def minres(op: Product, rhs: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """Approximate solutions of op(x) = rhs for every column, all advanced together.

    ``op`` is symmetric per column. Ends after ``steps`` products, or when every column's residual
    has fallen to ``reduce`` of its right-hand side.
    """
    safe = lambda x: np.where(x > 0, x, 1.0)
    size = np.linalg.norm(rhs, axis=0)
    x, last, w0, w1 = (np.zeros_like(rhs) for _ in range(4))
    v, beta, eta = rhs / safe(size), size, size.copy()
    c0, c1, s0, s1 = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        av = op(v)
        alpha = (v * av).sum(axis=0)
        new = av - alpha * v - beta * last
        norm = np.linalg.norm(new, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        r1, r2, r3 = np.hypot(delta, norm), s1 * alpha + c0 * c1 * beta, s0 * beta
        live = r1 > 0
        c2, s2 = np.where(live, delta / safe(r1), 1.0), np.where(live, norm / safe(r1), 0.0)
        w2 = np.where(live, (v - r3 * w0 - r2 * w1) / safe(r1), 0.0)
        x = x + c2 * eta * w2
        eta = -s2 * eta
        last, v, beta, w0, w1, c0, c1, s0, s1 = v, new / safe(norm), norm, w1, w2, c1, c2, s1, s2
        if (np.abs(eta) <= reduce * size).all():
            break
    return x


def _against(t: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``t`` adds to the orthonormal ``basis``."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        t = t - basis @ (basis.T @ t)
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    t = u[:, s > 1e-8]
    for _ in range(2):
        t = t - basis @ (basis.T @ t)
        t = np.linalg.qr(t)[0] if t.shape[1] else t
    return t


def jacobi_davidson(product: Product, dim: int, wanted: int, inner: int = INNER, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix known by its products.

    Every residual is at most max(dim, 64) * 4 eps times the largest eigenvalue, checked on fresh
    products. If rounding in the products stops the fall above that, the best reached is taken where
    it is within a thousand times of it; else an error says so.
    """
    wanted = min(wanted, dim)
    most = min(dim, max(3 * wanted, wanted + 3 * EXTRA))
    rng = np.random.default_rng([dim, wanted])
    basis = np.linalg.qr(rng.standard_normal((dim, min(dim, wanted + EXTRA))))[0]
    image = product(basis)
    locked, locked_values = np.zeros((dim, 0)), np.zeros(0)
    tolerance, top, best, stale = max(dim, 64) * 4 * EPS, 0.0, np.inf, 0
    for step in range(outer):
        # Rayleigh-Ritz in the part of the space that is not locked
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        need = wanted - locked.shape[1]
        top = max(top, float(np.abs(theta).max(initial=0.0)))
        residual = image[:, :need] - basis[:, :need] * theta[:need]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        done = norms <= tolerance * top
        ready = int(np.argmin(done)) if not done.all() else need
        if ready:  # only leading pairs are locked, and only when fresh products agree
            image[:, :ready] = product(basis[:, :ready])
            fresh = np.linalg.norm(image[:, :ready] - basis[:, :ready] * theta[:ready], axis=0) <= 2 * tolerance * top
            ready = int(np.argmin(fresh)) if not fresh.all() else ready
        worst = float(norms.max(initial=0.0))
        stale = stale + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if stale >= 4 and worst <= 1000 * tolerance * top:
            ready = need
        locked = np.concatenate([locked, basis[:, :ready]], axis=1)
        locked_values = np.concatenate([locked_values, theta[:ready]])
        if locked.shape[1] == wanted:
            order = np.argsort(-locked_values, kind="stable")
            return locked_values[order], locked[:, order]
        basis, image = basis[:, ready:], image[:, ready:]
        theta, residual = theta[ready:need], residual[:, ready:]
        active = theta.shape[0]
        if basis.shape[1] + active > most - locked.shape[1]:  # thick restart with the best of the space
            keep = max(active + EXTRA, most - locked.shape[1] - active) if most < dim else basis.shape[1]
            basis, image = basis[:, :keep], image[:, :keep]
        held = np.concatenate([locked, basis], axis=1)
        if held.shape[1] < dim:
            near = np.concatenate([locked, basis[:, :active]], axis=1)
            away = lambda t, near=near: t - near @ (near.T @ t)
            t = minres(lambda v, theta=theta, away=away: away(product(away(v)) - away(v) * theta), -away(residual), inner, 0.5 ** (step + 2))
            t = _against(t, held)
            if not t.shape[1]:
                t = _against(rng.standard_normal((dim, min(active, dim - held.shape[1]))), held)
            t = t[:, : dim - held.shape[1]]
            basis, image = np.concatenate([basis, t], axis=1), np.concatenate([image, product(t)], axis=1)
        else:
            image = product(basis)  # the whole space is held: only rounding is left
    raise ArithmeticError(f"residual {best / max(top, 1e-300):.1e} of the largest eigenvalue after {outer} outer steps")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // dim)
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def _added(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int], whole: bool = False) -> np.ndarray:
    """The sum over all partitions of a matrix of bounded shape that each makes from its rows."""
    kind = "bigint" if whole else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = part(batches)
        at = np.flatnonzero(made)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(made.reshape(-1)[at])], ["at", "v"])

    total = np.zeros(shape[0] * shape[1], np.int64 if whole else np.float64)
    for r in rows.mapInArrow(run, f"at bigint, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row per cell
        total[r["at"]] = r["v"]
    return total.reshape(shape)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact; x - S/n is this over n, without the rounding of a mean that is large against the spread."""
    return x * n - sums


def integer_vectors(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id and x: entries as whole numbers, for vectors without null or non-finite entries, of the commonest length."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vec}`").cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint") + F.lit(SHIFT).cast("bigint"))
    rows = written(rows.select("vec_id", x.alias("x")), "whitening-x")
    common = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return rows.where(F.size("x") == (common["dim"] if common else 0))


def whiten(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and component.

    The data are passed over once for the sums, once per product (some ten to a few dozen, each
    for a block of vectors), once for the covariance of the result and once for the result; what comes
    back to the driver is dimension x vectors, whatever the number of rows. Components are
    numbered by falling eigenvalue; those whose eigenvalue is zero to rounding have no rows.

    Vectors that are null, empty, or hold null or non-finite entries have no rows, nor have vectors
    of another length than the commonest (of equally common ones the longest). Repeated rows
    count each and null ids stay null. An empty table, or one whose vectors are all equal, gives no
    rows. A deviation or sum beyond 64 bits stops the job. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors, vec, id_col)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = int(size["n"]), int(size["dim"] or 0)
    if not n:
        return spark.createDataFrame([], schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(dim, np.int64)
        for some in _slices(batches, dim):
            total += _matrix(some["x"]).sum(axis=0)
        return total

    xs = rows.select("x")
    total = _added(xs, sums, (1, dim), whole=True)[0]
    traces: list[float] = []

    def product(block: np.ndarray) -> np.ndarray:
        """The covariance times some vectors; the sum of squares comes along."""
        held = spark.sparkContext.broadcast(block)

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            block, squares = held.value, 0.0
            made = np.zeros(block.shape)
            for some in _slices(batches, dim):
                y = centred(_matrix(some["x"]), n, total) / n
                made += y.T @ (y @ block)
                squares += float((y * y).sum())
            return np.append(made.reshape(-1), squares)

        found = _added(xs, part, (1, block.size + 1))[0] / n
        held.unpersist()
        traces.append(float(found[-1]))
        return found[:-1].reshape(block.shape)

    values, axes = jacobi_davidson(product, dim, components)
    trace = traces[0]
    real = values > max(dim, 64) * 4 * EPS * max(float(values.max(initial=0.0)), 0.0)
    values, axes = values[real], axes[:, real]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    to_white = axes / np.sqrt(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        made = np.zeros((k + 1, k))
        for some in _slices(batches, dim):
            w = (centred(_matrix(some["x"]), n, total) / n) @ to_white
            made[:k] += w.T @ w
            made[k] += w.sum(axis=0)
        return made

    found = _added(xs, moments, (k + 1, k)) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = values / trace

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches, max(dim, k)):
            y, rows_ = centred(_matrix(some["x"]), n, total), some.num_rows
            if float(np.abs(y).max()) ** 2 * dim < 2**62:
                deviation = (y * y).sum(axis=1)
            else:  # too large for a sum of machine integers; beyond 64 bits the cast fails
                deviation = [int(v) for v in (y.astype(object) ** 2).sum(axis=1)]
            index = pa.array(np.repeat(np.arange(rows_), k))
            cells = rows_ * k
            yield pa.RecordBatch.from_arrays(
                [
                    some["vec_id"].take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(cells, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(index), pa.array(((y / n) @ to_white).reshape(-1)), pa.array(np.tile(explained, rows_)), pa.array(np.full(cells, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(result, schema)
