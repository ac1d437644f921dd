"""The solver against numpy's, whitening against plain definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableloom.llm import whitening
from tableloom.llm.queries import op13_whitening

MATRICES = {
    "random": np.random.default_rng(1).standard_normal((40, 40)),
    "graded": np.random.default_rng(2).standard_normal((30, 30)) * 10.0 ** -np.arange(30)[None, :] / 2,
    "equal values": np.diag([3.0] * 6 + [1.0] * 6),
    "rotated equal values": np.linalg.qr(np.random.default_rng(3).standard_normal((12, 12)))[0] * 2.0,
    "rank two": np.outer(np.arange(8.0), np.ones(8)) + np.outer(np.ones(8), np.arange(8.0)),
    "zero": np.zeros((5, 5)),
    "one": np.array([[2.0]]),
    "zero columns": np.diag([0.0, 3.0, 0.0, 2.0, 0.0]),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver(name):
    a = MATRICES[name]
    values, vectors = whitening.directions(a, 16)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(np.sqrt(values), want, rtol=1e-12, atol=1e-13 * max(want[0], 1e-300))
    k = vectors.shape[1]
    assert k == min(16, int((want > len(want) * whitening.EPS * max(want[0], 1e-300)).sum()))
    assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-8
    assert np.abs(a.T @ (a @ vectors) - vectors * values[:k]).max(initial=0) <= 1e-12 * max(values[0], 1e-300)


def test_small_values_to_high_relative_accuracy():
    diagonal = 10.0 ** -np.arange(12)
    values = whitening.dqds(diagonal, np.zeros(11))
    assert np.allclose(values, diagonal**2, rtol=1e-14, atol=0)
    # a product form with a known determinant: the product of all squared values is that of the diagonal
    upper = np.full(11, 0.5)
    assert np.isclose(np.log(whitening.dqds(diagonal, upper)).sum(), 2 * np.log(diagonal).sum(), rtol=1e-12)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10_000))
def test_small_integer_matrices(d, seed):
    a = np.random.default_rng(seed).integers(-2, 3, (d, d)).astype(float)
    values, vectors = whitening.directions(a, d)
    assert np.allclose(np.sqrt(values), np.linalg.svd(a, compute_uv=False), atol=1e-7)
    k = vectors.shape[1]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-7
    assert np.abs(a.T @ (a @ vectors) - vectors * values[:k]).max(initial=0) < 1e-9


def plain(rows, limit=16):
    """By the definitions, with numpy's eigenvectors."""
    xs = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for _, v in rows]
    distinct = sorted(set(map(tuple, xs)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    y = np.array([[n * c - s for c, s in zip(v, sums)] for v in distinct], dtype=float) / n
    e, vectors = np.linalg.eigh(y.T @ y / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = {}
    for (key, _), v in zip(rows, xs):
        gap = [n * c - s for c, s in zip(v, sums)]
        out[key] = (sum(g * g for g in gap), np.array(gap, dtype=float) / n @ vectors[:, :limit] / np.sqrt(e[:limit]))
    return n, out, e / e.sum()


def test_query_by_definition(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, want, explained = plain([tuple(r) for r in table])
    rows = op13_whitening(spark, sf).collect()
    assert len(rows) == 16 * len(table)
    got = {}
    for r in rows:
        assert r.n == n and r.deviation == want[r.vec_id][0]
        assert r.identity_error < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    a = np.array([[got[k][c] for c in range(1, 17)] for k in want])
    b = np.array([want[k][1] for k in want])
    signs = np.sign((a * b).sum(axis=0))
    assert np.abs(a * signs - b).max() < 1e-8


def made(spark, rows, schema="vec_id bigint, embedding array<double>"):
    x = whitening.quantised(spark.createDataFrame(rows, schema), "vec_id", "embedding")
    return whitening.whiten(x, whitening.fit(x)).collect()


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 1.0]), (103, [float("inf"), 0.0, 1.0]),
           (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0]), (None, good[0][1]), (0, good[0][1])]
    rows = made(spark, good + odd)
    n, want, _ = plain(good)
    assert n == 40 and all(r.n == 40 for r in rows) and len(rows) == 3 * 42
    assert {r.key for r in rows} == {None, *range(40)}
    assert all(r.deviation == want[r.key or 0][0] for r in rows)
    assert made(spark, []) == []
    assert made(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # nothing varies
    line = made(spark, [(i, [float(i), float(2 * i), 5.0]) for i in range(9)])
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**45 * (i % 3)), float(i)]) for i in range(12)]
    n, want, _ = plain(rows)
    for r in made(spark, rows):
        exact = want[r.key][0]
        assert r.deviation == (exact if exact < 2**63 else None)


def test_many_partitions_meet_in_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    x = whitening.quantised(frame, "vec_id", "embedding")
    model = whitening.fit(x.repartition(70))
    y = np.array([v for _, v in rows])
    y = np.floor(y * 64)
    assert np.allclose(model.values, np.linalg.eigvalsh(np.cov(y.T, bias=True))[::-1], rtol=1e-10)
    assert model.error < 1e-10
