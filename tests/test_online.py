"""Ordered folds against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import online as O

rng = np.random.default_rng(2)
X = rng.normal(size=(30, 2))
Y = np.where(X[:, 0] + 0.1 * rng.normal(size=30) > 0, 1.0, -1.0)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, i, float(y), x.tolist()) for i, (x, y) in enumerate(zip(X, Y))], "k int, at int, y double, x array<double>")


def test_map_fold(rows):
    start = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    w, grid = np.array(start), [(0, 0), (0, 1), (1, 0), (1, 1)]
    for t, x in enumerate(X):
        left = 1 - t / len(X)
        winner = min(range(4), key=lambda i: (((w[i] - x) ** 2).sum(), i))
        for i in range(4):
            g = (grid[i][0] - grid[winner][0]) ** 2 + (grid[i][1] - grid[winner][1]) ** 2
            w[i] += 0.3 * left * np.exp(-g / (1.0 * left) ** 2) * (x - w[i])
    (found,) = O.map_fold(rows, "k", "at", "x", start, 2).collect()
    assert np.allclose(found["weights"], w)


def test_hinge_fit_separates(rows):
    w = np.array(O.hinge_fit(rows, "y", "x", 2, 25))
    assert (np.sign(X @ w) == Y).mean() > 0.9
    assert O.hinge_fit(rows.where("false"), "y", "x", 2) == [0.0, 0.0]


def test_plain_kernel_learner_and_its_surface(rows):
    """The learner without ambiguity and with radius 0: every sample is a centre."""
    alpha, grad = np.zeros(0), np.zeros(0)
    for t, (x, y) in enumerate(zip(X, Y)):
        alpha, grad, l = np.append(alpha, 0.0), np.append(grad, 0.0), Y[: t + 1]
        k = np.exp(-((X[: t + 1] - x) ** 2).sum(1) / (2 * 0.5**2))
        if y * (alpha * l * k).sum() < 1:
            grad = grad - y * l * k
            alpha = np.minimum(np.exp(-0.1 * grad - 1), 1.0)
            total = alpha.sum()
            for label in (1.0, -1.0):
                if (l == label).any():
                    alpha[l == label] *= total / 2 / alpha[l == label].sum()
    states = O.fit(rows, "k", "at", "y", "x", "svm", O.Params(sigma=0.5))
    assert np.allclose(states.first()["alpha"], alpha)
    grid = O.surface(states, 0.5, 3).collect()
    assert len(grid) == 9
    for r in grid:
        k = np.exp(-((X - [r["x"], r["y"]]) ** 2).sum(1) / (2 * 0.5**2))
        assert r["margin"] == pytest.approx((alpha * Y * k).sum(), abs=1e-9)


# --- the seven learners against plain loops ---

def _plain_learner(name, rows, p):
    """Each rule sample by sample, with loops over centres."""
    c, l, w, u, alpha, grad, seen = [], [], [], [], [], [], []
    gauss = lambda a, b: np.exp(-((a - b) ** 2).sum() / (2 * p.sigma**2))
    for x, y in rows:
        near = [i for i in range(len(c)) if l[i] == y and np.sqrt(((c[i] - x) ** 2).sum()) < p.radius]
        for i in near:
            w[i] += 1 / len(near)
        if not near:
            c.append(x), l.append(y), w.append(1.0), u.append(np.zeros_like(x)), alpha.append(0.0), grad.append(0.0)
        seen = [*seen, (x, y)][-20:]
        n = len(c)
        at = [c[i] - u[i] / w[i] for i in range(n)]
        k = [gauss(at[i], x) for i in range(n)]
        if name == "dro":
            u = [u[i] - p.eta / p.sigma**2 * y * alpha[i] * l[i] * k[i] * (at[i] - x) for i in range(n)]
            u = [v * p.eps / np.linalg.norm(v) if np.linalg.norm(v) > p.eps else v for v in u]
        elif name != "svm" and name != "svm_weighted":
            k = [0.0 if l[i] == y and name != "robust_smooth" else k[i] for i in range(n)]
            if name == "robust_smooth":
                step = [p.eta * alpha[i] * sum(((gauss(at[i], z) if l[i] * t == -1 else 0.0) * (z - at[i]) for z, t in seen), np.zeros_like(x)) for i in range(n)]
            else:
                step = [alpha[i] * k[i] / p.sigma**2 * (x - at[i]) for i in range(n)]
            moves = True
            if name in ("robust_norm", "robust_combined"):
                size = np.linalg.svd(np.array(step), compute_uv=False)[0]
                moves = size > 0.01
                step = [p.eta * s / size if moves else s for s in step]
            if moves:
                u = [a - b for a, b in zip(u, step)]
                mean = sum(np.linalg.norm(v) for v in u) / n
                u = [v * p.eps / mean if mean > p.eps else v for v in u]
        if name not in ("robust_norm", "robust_smooth"):
            k = [gauss(c[i] - u[i] / w[i], x) for i in range(n)]
        plain = name == "svm"
        if y * sum((1 if plain else w[i]) * k[i] * alpha[i] * l[i] for i in range(n)) < 1:
            grad = [grad[i] - y * w[i] * l[i] * k[i] for i in range(n)]
            alpha = [min(np.exp(-p.eta * g - 1), p.C) for g in grad]
            weigh = name not in ("svm", "dro")
            signed = name in ("svm_weighted", "robust_combined")
            total = sum(alpha[i] * (w[i] if weigh else 1) * (l[i] if signed else 1) for i in range(n))
            for label in (1.0, -1.0):
                mass = sum(alpha[i] * (w[i] if weigh else 1) for i in range(n) if l[i] == label)
                if mass > 0:
                    alpha = [alpha[i] * (w[i] if weigh and not signed else 1) * total / 2 / mass if l[i] == label else alpha[i] for i in range(n)]
    return {"c": c, "l": l, "w": w, "alpha": alpha, "grad": grad, "u": u}


@pytest.mark.parametrize("name", sorted(O.LEARNERS))
def test_learner_against_loops(rows, name):
    p = O.Params(radius=0.4, eps=0.3, eta=0.2, sigma=0.7)
    want = _plain_learner(name, list(zip(X, Y)), p)
    (found,) = O.fit(rows, "k", "at", "y", "x", name, p).collect()
    assert 5 < len(want["l"]) < len(X)
    if "svm" not in name:
        assert np.abs(np.array(want["u"])).max() > 1e-3
    for n, value in want.items():
        assert np.allclose(np.array(found[n]), np.array(value), atol=1e-9), n


@pytest.mark.parametrize("name", ["dro", "robust", "robust_norm", "robust_smooth", "robust_combined"])
def test_ambiguity_moves_towards_the_other_label(name):
    """A +1 centre that meets a -1 sample is expected nearer to it."""
    s = O.State(2)
    s.c, s.u, s.l, s.w, s.alpha, s.grad = np.zeros((1, 2)), np.zeros((1, 2)), np.ones(1), np.ones(1), np.ones(1), np.zeros(1)
    O.update(s, np.array([1.0, 0.0]), -1.0, O.Params(eps=0.5, eta=0.5), name)
    assert O.moved(s)[0, 0] > 0.01 and abs(O.moved(s)[0, 1]) < 1e-12


def test_fit_goes_on_from_a_state_and_leaves_nulls_out(spark, rows):
    for name in ("robust_smooth", "robust"):
        p = O.Params(radius=0.4, eps=0.3)
        (whole,) = O.fit(rows, "k", "at", "y", "x", name, p).collect()
        half = O.fit(rows.where("at < 13"), "k", "at", "y", "x", name, p)
        (both,) = O.fit(rows.where("at >= 13"), "k", "at", "y", "x", name, p, start=half).collect()
        assert all(np.allclose(np.array(whole[n]), np.array(both[n])) for n in O.STATE_COLUMNS)
    holes = rows.union(spark.createDataFrame([(0, 100, None, [1.0, 2.0]), (0, 101, 1.0, None), (None, 102, 1.0, [1.0, 1.0])], rows.schema))
    assert O.fit(holes, "k", "at", "y", "x", "robust").collect() == O.fit(rows, "k", "at", "y", "x", "robust").collect()
    assert O.linear_fold(holes, "k", "at", "y", "x", 2, 0.1).collect() == O.linear_fold(rows, "k", "at", "y", "x", 2, 0.1).collect()


def test_a_key_of_many_rows_at_radius_zero(spark):
    n = 5000
    x = np.random.default_rng(7).normal(size=(n, 3))
    t = spark.createDataFrame([(0, i, 1.0 if a[0] > 0 else -1.0, a.tolist()) for i, a in enumerate(x)], "k int, at int, y double, x array<double>")
    (found,) = O.fit(t, "k", "at", "y", "x", "svm").collect()
    assert len(found["l"]) == n


def test_margins_and_scaling(spark, rows):
    p = O.Params(radius=0.4, eps=0.3, sigma=0.7)
    states = O.fit(rows, "k", "at", "y", "x", "robust", p)
    s = O.State.load(states.first().asDict())
    got = {r["at"]: r["margin"] for r in O.margins(rows.union(spark.createDataFrame([(0, 99, 1.0, None), (1, 98, 1.0, [0.0, 0.0])], rows.schema)), states, "k", "x", p.sigma).collect()}
    assert got[99] is None and got[98] is None
    for i, x in enumerate(X):
        assert got[i] == pytest.approx((s.alpha * s.w * s.l * O.kernel(O.moved(s), x, p.sigma)).sum(), abs=1e-9)
    mean, variance = O.fit_scaling(rows, "x")
    assert np.allclose(mean, X.mean(0)) and np.allclose(variance, X.var(0))
    scaled = np.array([r[0] for r in rows.orderBy("at").select(O.scaled(F.col("x"), (mean, variance))).collect()])
    assert np.allclose(scaled, (X - X.mean(0)) / X.std(0))
