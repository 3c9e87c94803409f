"""Row-wise randomised SVD against numpy, and the exact linear SVM against a linear program solved by its vertices."""

import itertools

import numpy as np
import pytest

from millrace.operators import hinge as H
from millrace.operators import linalg as L


def vectors(spark, x, parts=5):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [1.0]), (-3, [None] * x.shape[1])]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(parts)


@pytest.mark.parametrize("parts,k", [(1, 12), (40, 12), (5, 4)])
def test_ill_conditioned_rows(spark, parts, k):
    """Singular values from 1 to 1e-6: the sketch of the rows finds the least of them, the Gram matrix does not."""
    rng = np.random.default_rng(6)
    u, _ = np.linalg.qr(rng.normal(size=(300, 12)))
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    sizes = np.logspace(0, -6, 12)
    x = u * sizes @ q.T
    truth = np.linalg.svd(x, compute_uv=False)[:k]
    values, axes = L.randomised_svd(vectors(spark, x, parts), "v", k)
    assert np.abs(values / truth - 1).max() < 1e-6
    assert np.allclose(axes.T @ axes, np.eye(k)) and np.allclose(np.linalg.norm(x @ axes, axis=0), values, rtol=1e-6)
    if k == 12:
        gram, _ = L.svd(vectors(spark, x, parts), "v", k)
        assert np.abs(gram / truth - 1).max() > 1e-6


def test_leading_values_of_a_wide_table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 40)) * 10 + rng.normal(size=(200, 40)) * 0.01
    values, axes = L.randomised_svd(vectors(spark, x), "v", 5, power=2, over=4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:5], rtol=1e-8) and np.allclose(np.abs((axes * vt[:5].T).sum(0)), 1, atol=1e-8)


def test_rank_and_emptiness(spark):
    x = np.outer(np.arange(1.0, 21), [1.0, 2.0, 2.0])
    values, _ = L.randomised_svd(vectors(spark, x), "v", 3)
    assert values[0] == pytest.approx(np.linalg.norm(x)) and (values[1:] < 1e-9 * values[0]).all()
    assert L.randomised_svd(vectors(spark, x).where("id = -1"), "v", 2)[0].size == 0


def objective(w, x, y, reg):
    return np.maximum(1 - y * (x @ w), 0).mean() + reg / 2 * w @ w


def test_linear_program(spark):
    """Without a penalty the optimum is a vertex: two rows exactly at the margin. All vertices are tried."""
    rng = np.random.default_rng(11)
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    x = rng.normal(size=(40, 2)) + 0.7 * y[:, None]
    best = min(objective(np.linalg.solve(x[list(p)], y[list(p)]), x, y, 0.0) for p in itertools.combinations(range(40), 2))
    rows = [(float(b), a.tolist()) for a, b in zip(x, y)] + [(None, [1.0, 1.0]), (1.0, None), (1.0, [None, 1.0])]
    found = H.hinge_optimum(spark.createDataFrame(rows, "y double, x array<double>"), "y", "x", reg=1e-4, tolerance=2e-5, blocks=1)
    assert abs(objective(np.array(found.weights), x, y, 0.0) - best) < 1e-4
    assert found.bound <= found.objective <= found.bound + 1e-4


def test_bounds_hold(spark):
    """In six dimensions: no step from the weights found, and no long run of small sub-gradient steps, gets below the bound."""
    rng = np.random.default_rng(12)
    y = np.where(rng.random(300) < 0.5, 1.0, -1.0)
    x = rng.normal(size=(300, 6)) + 0.4 * y[:, None] * np.arange(6) / 6
    t = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "y double, x array<double>")
    found = H.hinge_optimum(t, "y", "x", reg=1e-2, tolerance=1e-5)
    w = np.array(found.weights)
    assert objective(w, x, y, 1e-2) == pytest.approx(found.objective) and found.objective - found.bound <= 1e-5
    least = min(objective(w + d, x, y, 1e-2) for d in rng.normal(size=(2000, 6)) * rng.choice([1e-4, 1e-2, 1.0], (2000, 1)))
    v = np.zeros(6)
    for i in range(1, 4000):
        v = v - (1e-2 * v - (y * (y * (x @ v) < 1)) @ x / len(x)) / (1e-2 * (i + 100))
        least = min(least, objective(v, x, y, 1e-2))
    assert least >= found.bound - 1e-12 and least >= found.objective - 1e-5
    assert H.hinge_optimum(t.limit(0), "y", "x").weights == []
    with pytest.raises(ValueError):
        H.hinge_optimum(t, "y", "x", reg=1e-2, tolerance=1e-9, rounds=2)
