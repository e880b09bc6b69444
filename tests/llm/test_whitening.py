import numpy as np
import pytest
from pyspark.sql import functions as F

from locusgrid.llm import whitening as W


def fit(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("x", "dim", "n", "ids", "component", "c")})
    return W.whitened(df, **options).collect()


def expected(x, k=8):
    """By an eigensolver on the covariance."""
    x = np.floor(1024 * np.array(x)).astype(np.int64) + 100_000
    n = len(x)
    centred = x - x.sum(axis=0) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    away = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, x.sum(axis=0))) for row in x]
    return n, away, centred @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("seed, dim", [(1, 5), (2, 12), (3, 30)])
def test_equals_an_eigensolver(spark, monkeypatch, seed, dim):
    monkeypatch.setattr(W, "BLOCK_ROWS", 37)
    r = np.random.default_rng(seed)
    x = r.normal(size=(400, dim)) @ r.normal(size=(dim, dim)) * 0.3 + r.normal(size=dim) * 5
    got = fit(spark, [(i, row.tolist()) for i, row in enumerate(x)])
    n, away, white, share = expected(x)
    k = min(8, dim)
    assert len(got) == n * k
    table = np.zeros((n, k))
    for row in got:
        table[row.vec_id, row.component - 1] = row.whitened
        assert row.n == n and row.deviation == away[row.vec_id]
        assert abs(row.explained / share[row.component - 1] - 1) < 1e-9 and row.identity_error < 1e-9
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table * sign - white).max() < 1e-7


def test_left_vectors_stay_orthogonal(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(300, 10)) * 10.0 ** -np.arange(10)[None, :] * 50
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = W.Bidiagonal(W.Rows(W.stored(W.to_blocks(W.scaled(df)), "b"), 10), 8)
    whole = np.floor(1024 * x) + 100_000
    u = (whole - whole.mean(axis=0)) @ np.stack(found.p, axis=1)
    assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-9
    v = np.stack(found.v, axis=1)
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12


def test_lower_rank_and_equal_deviations(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(200, 2))
    flat = np.concatenate([base, base[:, :1], np.zeros((200, 3))], axis=1)  # three columns, rank two
    got = fit(spark, [(i, row.tolist()) for i, row in enumerate(flat)])
    assert {x.component for x in got} == {1, 2} and got[0].identity_error < 1e-9
    cross = [(i, [float(s * (k == d)) for d in range(4)]) for i, (k, s) in enumerate((k, s) for k in range(4) for s in (-1, 1))]
    got = fit(spark, cross)  # all four deviations are equal
    assert len(got) == 8 * 4 and got[0].identity_error < 1e-9
    assert all(abs(x.explained - 0.25) < 1e-9 for x in got)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 0.0]), (9, [1e300, 0.0]), (10, [2.0, 5.0]), (11, [7.0]), (12, [9.0])]
    got = fit(spark, rows)
    ids = sorted((x.vec_id is None, x.vec_id or 0, x.component) for x in got if x.n == 4)
    assert ids == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 10, 1), (False, 10, 2), (True, 0, 1), (True, 0, 2)]
    assert {(x.vec_id, x.component) for x in got if x.n == 2} == {(11, 1), (12, 1)}


def test_no_variance(spark):
    assert fit(spark, []) == [] and fit(spark, [(1, [1.0, 2.0])]) == []
    assert fit(spark, [(i, [0.5, 0.25]) for i in range(9)]) == []


def test_large_numbers_stay_exact(spark):
    x = [[2.0 ** 40, 1.0], [2.0 ** 40 + 3, 2.0], [2.0 ** 40 - 5, -4.0]]
    got = fit(spark, list(enumerate(x)))
    away = expected(x)[1]
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d if d < 2 ** 63 else None) for i, d in enumerate(away)}
