"""Whitening of embeddings with cyclic Jacobi eigenvectors.

Entries become whole numbers x = floor(scale * c) + shift, so that sums are exact. The scatter matrix is summed from
vectors that are centred before they are multiplied, one matrix for each task. The driver, which holds no more than this
matrix, turns it by symmetric Jacobi rotations in cyclic order until every off-diagonal entry vanishes against its own two
diagonal entries; that keeps small eigenvalues accurate that a criterion relative to the largest would blur. Components are
sorted by falling eigenvalue, each eigenvector's largest entry being positive, and the whitening matrix goes with the tasks
that project the vectors.

Edge cases: vectors that are null, empty, or hold null or non-finite entries take no part; neither do vectors of another length
than the most frequent (the longer if tied). Repeated rows and repeated or null keys are rows like any other. Components
whose eigenvalue is not above rounding have no whitened values and are left out, so constant dimensions and tables of fewer
vectors than dimensions give fewer components, and an empty table, one vector or equal vectors none and no rows. Further columns, whatever
their names, are ignored. Entries beyond 2**52 / scale and vectors of more than LONGEST entries raise errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries of a vector: the driver and each task hold a square matrix of this size at most.
LONGEST = 4096
#: Vectors that a task multiplies at once.
ROWS = 4096
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Fit:
    """n vectors with exact sums per dimension; eigenvalues of the covariance, falling, and eigenvectors as columns; trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and the rest."""
        near = (2 * self.sums + self.n) // (2 * self.n)
        return near, (self.sums - self.n * near) / self.n


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns of a symmetric matrix without large negative eigenvalues.

    A sweep meets every pair of rows once, in rounds of disjoint pairs, as in a tournament; a round's rotations are done at once.
    """
    a = np.array(matrix, float)
    n = len(a)
    turn = np.eye(n)
    seats = np.arange(n + n % 2)
    for _ in range(sweeps):
        still = True
        for _ in range(max(len(seats) - 1, 0)):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < n], q[q < n]
            off = np.abs(a[p, q]) > EPS * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q = p[off], q[off]
            if len(p):
                still = False
                x, y, z = a[p, p], a[q, q], a[p, q]
                with np.errstate(over="ignore"):  # a very small angle has a very large cotangent
                    theta = (y - x) / (2 * z)
                    t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
                a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
                a[p, p], a[q, q], a[p, q], a[q, p] = x - t * z, y + t * z, 0.0, 0.0
                turn[:, p], turn[:, q] = turn[:, p] * c - turn[:, q] * s, turn[:, p] * s + turn[:, q] * c
            seats[1:] = np.roll(seats[1:], 1)
        if still:
            break
    else:
        raise ArithmeticError(f"off-diagonal entries left after {sweeps} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    turn = turn[:, order]
    turn *= np.where(turn[np.abs(turn).argmax(0), np.arange(n)] < 0, -1.0, 1.0)
    return np.diag(a)[order], turn


def whole(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, x array<long>) of the vectors that take part, whatever their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            used = np.asarray(lists.is_valid())
            lists = lists.fill_null([])
            size = lists.value_lengths().to_numpy().astype(np.int64)
            values = np.asarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # null entries become NaN
            row = np.repeat(np.arange(len(size)), size)
            used &= size > 0
            used[row[~np.isfinite(values)]] = False
            values = np.floor(scale * values[used[row]])
            if (np.abs(values) > 2.0**52).any():
                raise ArithmeticError("an entry is too large for exact sums")
            offsets = np.concatenate(([0], np.cumsum(size[used]))).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64) + shift))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(used)), x], [key, "x"])

    kind = dict(vectors.dtypes)[key]
    return vectors.select(key, column).mapInArrow(run, f"`{key}` {kind}, x array<long>")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _scatter(rows: DataFrame, dims: int, centred) -> np.ndarray:
    """The sum of the outer products of centred(batch), a matrix of `dims` columns; each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                z = centred(batch.slice(i, ROWS))
                total += z.T @ z
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((dims, dims))
    # a row for each pair of dimensions
    for i, j, s in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        out[i, j] = out[j, i] = s
    return out


def fit(rows: DataFrame) -> Fit | None:
    """The fit over all rows of whole(), which have one length; None without rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), len(batch.column("x")[0]))
                n, sums = n + len(x), x.sum(0) + (sums if len(sums) else 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums), dtype=np.int32)), pa.array(np.concatenate(([n], sums)))], ["i", "s"])

    # a row for each dimension
    total = dict(rows.select("x").mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect())
    n, dims = total.pop(-1, 0), len(total)
    if not n:
        return None
    if dims > LONGEST:
        raise ValueError(f"vectors of {dims} entries, more than {LONGEST}")
    sums = np.array([total[i] for i in range(dims)], np.int64)
    near, rest = Fit(n, sums, sums, sums, 0.0).centre
    covariance = _scatter(rows.select("x"), dims, lambda batch: (_matrix(batch.column("x"), dims) - near) - rest) / n
    values, vectors = jacobi(covariance)
    return Fit(n, sums, values, vectors, float(np.trace(covariance)))


def _squares(y: np.ndarray) -> pa.Array:
    """Exact sums of the squares of each row, as decimals."""
    if not len(y) or (y.astype(float) ** 2).sum(1).max() < 2.0**62:
        return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([sum(v * v for v in r) for r in y.tolist()], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error), one row for each vector that takes part.

    deviation: the sum of (n * x - S)**2 over the dimensions, S being the dimensions' sums, exact; whitened: x - S / n on up to
    `components` eigenvectors, over the root of the eigenvalue; explained: the eigenvalues' shares of the trace;
    identity_error: how far the covariance of `whitened` is from the identity, over all rows.
    """
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    rows = tables.keep(whole(vectors, key, column, scale, shift))
    usual = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    fitted = fit(rows.where(F.size("x") == usual["dims"])) if usual else None
    most = 0 if fitted is None else int((fitted.values[:components] > 8 * len(fitted.values) * EPS * max(fitted.values[0], 0)).sum())
    if not most:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, n, sums = len(fitted.values), fitted.n, fitted.sums
    near, rest = fitted.centre
    away = sums - n * near
    project = fitted.vectors[:, :most] / np.sqrt(fitted.values[:most])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                whole_part = _matrix(part.column("x"), dims) - near
                white = (whole_part - rest) @ project
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, most, dtype=np.int32)), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), _squares(n * whole_part - away), lists], [key, "deviation", "whitened"])

    white = tables.keep(rows.where(F.size("x") == dims).mapInArrow(run, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>"))
    # x - S / n is centred, so its projections are
    again = _scatter(white.select("whitened"), most, lambda batch: _matrix(batch.column("whitened"), most)) / n
    error = float(np.abs(again - np.eye(most)).max())
    shares = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.values[:most]))
    return white.select(key, F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
