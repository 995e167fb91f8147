"""Whitening of embeddings: leading eigenvectors of their covariance by matrix-free block subspace iteration.

The covariance is never formed from the rows. A pass over the distinct vectors multiplies it with a block of directions, X'(XQ) on centred
rows, summed in each task and then over the tasks. The driver orthonormalises the block (QR) and solves the small projected problem
(Rayleigh-Ritz). A residual |Vq - eq| for each wanted component says when all of them are found. Where residuals fall slowly, because the
eigenvalues behind the block are close to those in it, the block is widened by random directions, at most to the whole space, in which the
projected problem is the problem itself.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components, and directions that the block has besides them at first.
COMPONENTS, GUARD = 16, 8
#: A component is found when its residual is under this part of the greatest eigenvalue.
TOLERANCE = 1e-13
#: If more passes than these would be needed at the rate of the last one, the block is doubled.
PATIENCE = 4
#: Passes after which the fit gives up; a block of the whole space needs two.
MOST_PASSES = 200
#: Eigenvalues under this part of the greatest are rounding: no variance to scale.
NO_VARIANCE = 1e-13
#: Entries of vectors that a task works on at once.
CELLS = 1 << 20


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What is fitted: number of distinct vectors, sums of each dimension less SHIFT a vector, eigenvalues and unit eigenvectors (columns), trace, and the largest entry by which the whitened covariance differs from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def numbers(vector: str) -> Column:
    """The vector as whole numbers, less SHIFT; null for a vector that is null or has null or non-finite entries."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from exact differences n * x - sums: far from zero, a rounded mean would cost digits."""
    if n * float(np.abs(x).max(initial=0)) < 2**61:
        return (x * n - sums) / n
    return x - sums / n


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(dim, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield _matrix(batch.column(0).slice(at, step), dim)


def _summed(fit: DataFrame, dim: int, width: int, add) -> np.ndarray:
    """The sum over all vectors of add(matrix of vectors), a matrix of `width` columns: a matrix leaves each task, rows of equal numbers are added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for x in _slices(batches, dim):
            total = total + add(x)
        if isinstance(total, np.ndarray):
            rows = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), rows], ["i", "row"])

    parts = fit.select("x").mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = cells.toArrow()  # as many cells as the block has, however many rows there are
    out = np.zeros((int(max(found["i"].to_numpy(), default=-1)) + 1, width))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return out


def _orthonormal(block: np.ndarray) -> np.ndarray:
    q, _ = np.linalg.qr(block)
    return np.linalg.qr(q)[0]  # twice: the second pass mends what the first lost to nearly parallel columns


def leading(multiply, dim: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The k greatest eigenvalues and eigenvectors of a symmetric matrix that is known by its products with a block, and the passes it took.

    Eigenvalues are falling. Raises where MOST_PASSES do not certify all k residuals.
    """
    random = np.random.default_rng(seed)
    k = min(k, dim)
    block = _orthonormal(random.standard_normal((dim, min(dim, k + GUARD))))
    before = None
    for passes in range(1, MOST_PASSES + 1):
        product = multiply(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = block @ turn, product @ turn
        scale = max(abs(values[0]), np.finfo(float).tiny)
        worst = float(np.linalg.norm(image[:, :k] - ritz[:, :k] * values[:k], axis=0).max()) / scale
        if worst <= TOLERANCE or (block.shape[1] == dim and before is not None and worst >= before / 2 and worst < 100 * TOLERANCE):
            return values[:k], ritz[:, :k], passes
        rate = worst / before if before else 0.5
        slow = rate >= 1 or np.log(TOLERANCE / worst) / np.log(rate) > PATIENCE
        width = block.shape[1]
        block = ritz if width == dim else image  # in the whole space there is nothing to filter: turn, and look again
        if before is not None and slow and width < dim:
            block = np.hstack([block / np.linalg.norm(block, axis=0).clip(np.finfo(float).tiny), random.standard_normal((dim, min(width, dim - width)))])
            before = None
        else:
            before = worst
        block = _orthonormal(block)
    raise RuntimeError(f"{k} components are not certain after {MOST_PASSES} passes: residual {worst:.1e}")


def fit_whitening(embeddings: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of a table; None if no vector remains.

    Null vectors and those with null or non-finite entries are left out, and so are vectors of another length than the most frequent one (of
    distinct vectors; of several, the longest), as they lack entries. There are fewer than k components where fewer have any variance. Copies
    count once. What reaches the driver is a matrix of dimensions by block a pass, whatever the number of rows.
    """
    own = embeddings.select(numbers(vector).alias("x")).where("x is not null and size(x) > 0")
    distinct = stored(own.distinct())
    sizes = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    if not sizes:
        return None
    dim, n = sizes[0]["d"], sizes[0]["count"]
    fit = distinct.where(F.size("x") == dim)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)  # whole numbers of any size
        for x in _slices(batches, dim):
            total = total + (x.sum(0) if len(x) * float(np.abs(x).max(initial=0)) < 2**62 else x.astype(object).sum(0)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["i", "s"])

    rows = fit.select("x").mapInArrow(totals, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
    exact = [0] * dim
    for row in rows:
        exact[row["i"]] = int(row["s"])
    sums = np.array(exact, np.int64) if max(map(abs, exact)) < 2**62 else np.array(exact, float)

    def multiply(block: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            y = _centred(x, n, sums)
            return y.T @ (y @ block)

        return _summed(fit, dim, block.shape[1], add) / n

    def squares(x: np.ndarray) -> np.ndarray:
        return np.array([[(_centred(x, n, sums) ** 2).sum()]])

    trace = float(_summed(fit, dim, 1, squares)[0, 0]) / n
    if not trace:
        return Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0, 0)
    values, vectors, passes = leading(multiply, dim, k)
    real = values > NO_VARIANCE * values[0]
    values, vectors = values[real], vectors[:, real]

    def products(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ vectors / np.sqrt(values)
        return np.vstack([w.T @ w, w.sum(0)])

    both = _summed(fit, dim, len(values), products) / n
    error = np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(len(values))).max()
    return Whitening(n, sums, values, vectors, trace, float(error), passes)


def whiten(embeddings: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows that the fit could use, with deviation and whitened (an array, one entry for each component).

    Rows are kept as they are, copies and rows of any id among them; columns named deviation or whitened are replaced. deviation is the sum of
    (n * x - S)^2, in whole numbers, null where it does not fit a long. An empty table, or a model of none, gives no rows.
    """
    kept = [c for c in embeddings.columns if c not in ("deviation", "whitened")]
    if model is None:
        return embeddings.select(*kept, F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).where(F.lit(False))
    n, sums, dim = model.n, model.sums, len(model.sums)
    turn = model.vectors / np.sqrt(model.values)

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def turned(column: pa.Array) -> pa.Array:
        squares, rows = [], []
        for at in range(0, len(column), max(1, CELLS // dim)):
            x = _matrix(column.slice(at, max(1, CELLS // dim)), dim)
            squares.append(_deviation(x, n, sums))
            rows.append(_centred(x, n, sums) @ turn)
        w = np.concatenate(rows) if rows else np.zeros((0, turn.shape[1]))
        ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * turn.shape[1])
        lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
        return pa.StructArray.from_arrays([pa.concat_arrays(squares) if squares else pa.array([], pa.int64()), lists], ["deviation", "whitened"])

    row, x, out = "row", "x", "out"  # the caller's columns travel in one struct, so that no name can clash
    valid = embeddings.select(F.struct(*embeddings.columns).alias(row)).select(row, numbers(f"{row}.`{vector}`").alias(x)).where((F.size(x) == dim) & F.col(x).isNotNull())
    done = valid.withColumn(out, turned(x))
    return done.select(*(F.col(row).getField(c).alias(c) for c in kept), F.col(out).getField("deviation").alias("deviation"), F.col(out).getField("whitened").alias("whitened"))


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum of (n * x - sums)^2 of each row: in 64 bits where it must fit, else in Python's whole numbers."""
    most = n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    if x.shape[1] * most**2 < 2**62:
        return pa.array(((x * n - sums) ** 2).sum(1))
    whole = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([v if v < 2**63 else None for v in whole], pa.int64())
