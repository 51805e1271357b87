"""Whitening against NumPy and exact arithmetic."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from helicase.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, whitened double"


def _table(spark, vectors, first=0):
    rows = [(i + first, None if v is None else [None if c is None else float(c) for c in v], 7, "own", 1.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [1, 2, 5, 32, 33])
def test_jacobi_finds_what_the_library_finds(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    a = a @ a.T
    values, vectors = whitening.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10, atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_jacobi_keeps_small_eigenvalues():
    """A matrix whose diagonal spans thirty powers of ten, near a diagonal one once scaled; the small values by exact elimination."""
    rng = np.random.default_rng(3)
    n = 6
    scale = 10.0 ** -np.arange(0, 15, 2.5)
    core = np.eye(n) + 0.05 * (lambda m: m + m.T)(rng.normal(size=(n, n)))
    a = scale[:, None] * core * scale
    a = np.triu(a) + np.triu(a, 1).T
    values, _ = whitening.jacobi(a)
    exact = [[Fraction(float(x)) for x in row] for row in a]
    determinant = Fraction(1)
    for i in range(n):
        determinant *= exact[i][i]
        for j in range(i + 1, n):
            f = exact[j][i] / exact[i][i]
            exact[j] = [x - f * y for x, y in zip(exact[j], exact[i])]
    product = math.prod(Fraction(float(v)) for v in values)
    assert abs(float(product / determinant) - 1) < 1e-12


def test_jacobi_of_degenerate_matrices():
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    values, _ = whitening.jacobi(np.ones((4, 4)))
    assert np.allclose(values, [4, 0, 0, 0], atol=1e-15)
    assert whitening.jacobi(np.diag([1.0, 3.0, 2.0]))[0].tolist() == [3, 2, 1]
    values, vectors = whitening.jacobi(np.eye(5))  # all eigenvalues tied
    assert values.tolist() == [1] * 5 and (vectors == np.eye(5)).all()


def test_whitened_against_exact_sums(spark):
    rng = np.random.default_rng(5)
    raw = (rng.normal(size=(200, 8)) @ np.diag([9, 5, 3, 1, 0.5, 0.2, 0.1, 0.05])).astype(np.float32)
    vectors = [v.tolist() for v in raw] + [None, [None] * 8, [math.nan] + [0] * 7, [math.inf] * 8, [], raw[0].tolist(), [1.0, 2.0]]
    got = whitening.whiten(_table(spark, vectors), components=5).collect()
    used = [*range(200), 205]
    assert sorted(r["vec_id"] for r in got) == used
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in vectors[i]] for i in used], object)
    n, sums = len(used), x.sum(0)
    centred = (x * n - sums) / n
    covariance = (centred.T @ centred / n).astype(float)
    want = np.linalg.eigvalsh(covariance)[::-1]
    by = {r["vec_id"]: r for r in got}
    white = np.array([by[i]["whitened"] for i in used])
    assert white.shape == (n, 5)
    assert [int(by[i]["deviation"]) for i in used] == [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    assert all(r["n"] == n for r in got)
    assert np.allclose(got[0]["explained"], want[:5] / covariance.trace(), rtol=1e-9)
    error = np.abs(np.cov(white.T, bias=True) - np.eye(5)).max()
    assert error < 1e-10 and got[0]["identity_error"] < 1e-10
    _, vectors_ = np.linalg.eigh(covariance)
    ref = centred.astype(float) @ vectors_[:, ::-1][:, :5] / np.sqrt(want[:5])
    assert np.allclose(np.abs(white), np.abs(ref), atol=1e-7)
    assert np.array_equal(by[0]["whitened"], by[205]["whitened"])  # equal rows, one sign for all


def test_tables_without_components(spark):
    none = spark.createDataFrame([], SCHEMA)
    for table in (none, _table(spark, [[1.0, 2.0]]), _table(spark, [[1.0, 2.0]] * 9), _table(spark, [None, [math.nan]])):
        got = whitening.whiten(table)
        assert got.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_fewer_vectors_than_dimensions_and_constant_ones(spark):
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1) if d % 3 else 2.0 for d in range(40)] for _ in range(12)]
    got = whitening.whiten(_table(spark, vectors)).collect()
    assert {len(r["whitened"]) for r in got} == {11} and got[0]["identity_error"] < 1e-8


def test_repeated_and_null_keys_are_rows_of_their_own(spark):
    rng = random.Random(4)
    rows = [(None if i % 5 == 0 else i % 3, [rng.gauss(0, 1) for _ in range(4)], 0, "", 0.0) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 50 and sum(r["vec_id"] is None for r in got) == 10


def test_large_numbers_of_rows_keep_deviations_exact():
    y = np.array([[3_000_000_000, -4_000_000_001], [1, 2]], np.int64)
    assert [int(v) for v in whitening._squares(y).to_pylist()] == [3_000_000_000**2 + 4_000_000_001**2, 5]
