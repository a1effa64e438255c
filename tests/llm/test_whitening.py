"""Whitening against an eigendecomposition of exact integers, the qd solver against other solvers, and edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import queries as Q, qd, whitening

SF = "/root/testdata/sf0.001"


def matrices():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    hadamard = np.ones((1, 1))
    for _ in range(4):
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    return {
        "random": rng.standard_normal((24, 24)),
        "low rank": np.hstack([rng.standard_normal((24, 12))] * 2),
        "graded": rng.standard_normal((24, 24)) * 10.0 ** (-np.arange(24) / 4),
        "identity": np.eye(24),
        "one value": q * 7,
        "clusters": q @ np.diag([5.0] * 8 + [3.0] * 8 + [1.0] * 8) @ q.T,
        "near": q @ np.diag(5 + 1e-9 * rng.standard_normal(24)) @ q.T,
        "hadamard": hadamard,
        "zero columns": np.triu(rng.standard_normal((24, 24))) * (np.arange(24) % 3 > 0),
        "single": np.array([[-2.0]]),
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_right_singular(name):
    m = matrices()[name]
    squares, v = qd.right_singular(m, 1e-11)
    s = np.linalg.svd(m, compute_uv=False)
    s = s[s > 1e-11 * s[0]]
    assert np.allclose(np.sqrt(squares), s, rtol=1e-9)
    assert np.abs(v.T @ v - np.eye(len(s))).max() < 1e-12
    assert np.abs(m.T @ (m @ v) - v * squares).max() < 1e-13 * squares[0]


def test_no_singular_values():
    squares, v = qd.right_singular(np.zeros((5, 5)), 1e-11)
    assert len(squares) == 0 and v.shape == (5, 0)


def test_bidiagonal_form():
    m = np.random.default_rng(3).standard_normal((9, 9))
    a, b, p = qd.bidiagonal(m)
    form = np.diag(a) + np.diag(b, 1)
    assert np.allclose(p.T @ p, np.eye(9)) and np.allclose(form.T @ form, p.T @ m.T @ m @ p)


def test_query_equals_brute_force(spark):
    data = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in data.items()}
    n, sums = len(x), [sum(c) for c in zip(*x.values())]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x.values()])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = dict(zip(x, centred @ vectors / np.sqrt(values)))
    rows = Q.op12_whitening(spark, SF).collect()
    assert len(rows) == 32 * n
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
        assert r.n == n and r.identity_error < 1e-10
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(centred.T @ centred / n), rel_tol=1e-10)
    ids = list(want)
    a, b = np.array([want[i] for i in ids]), np.array([[got[i][c] for c in range(1, 33)] for i in ids])
    signs = np.sign((a * b).sum(axis=0))
    assert np.abs(a * signs - b).max() < 1e-8


BAD = [
    (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [1.0]), (7, []),
    (None, [3.0, 4.0]), (9, [0.5, 1.0]),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("n", "vector", "key", "part")})


def fitted(table, **k):
    model = whitening.fit(table, **k)
    return model, whitening.whiten(table, model).collect()


def test_rows_that_dont_count(spark):
    model, rows = fitted(frame(spark, BAD).repartition(4))
    assert sorted((r.vec_id for r in rows), key=repr) == [1, 1, 9, None]
    assert model.n == 4 and all(len(r.whitened) == 2 for r in rows) and model.identity_error < 1e-12
    first, second = [r for r in rows if r.vec_id == 1]
    assert first == second


def test_nothing_to_fit(spark):
    for rows, count in (([], 0), ([(2, None)], 0), ([(1, [1.0, 2.0])] * 3, 3)):
        table = frame(spark, rows)
        model, found = fitted(table)
        assert len(found) == count and len(model.eigenvalues) == 0
        assert whitening.by_component(whitening.whiten(table, model), model).collect() == []


def test_huge_entries_stay_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [1e300, 0.0])]
    _, found = fitted(frame(spark, rows[:2]))
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows[:2]]
    sums = [a + b for a, b in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in found} == {i + 1: sum((2 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    _, found = fitted(frame(spark, rows))
    assert len(found) == 3


def test_long_vectors_and_many_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(300).tolist()) for i in range(120)]
    model, found = fitted(frame(spark, rows).repartition(40), components=500)
    assert len(model.eigenvalues) == 119 and model.identity_error < 1e-9 and len(found) == 120
