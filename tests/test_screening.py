"""The search by bounds: bounds hold against the best cutting and the exact scores, and what it accepts is what scoring all candidates accepts."""

import numpy as np
import pytest

from millrace.operators import features as X
from millrace.operators import screening as S
from millrace.operators import trees as T

FEATURES = ["a", "b", "c", "d"]
OPS = ("x", "d")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    values = rng.normal(size=(3000, 5)).round(2)
    values[:, 3] = rng.integers(0, 3, 3000)  # ties, and zeros to divide by
    made = [(*map(float, v), float(v[0] * v[1] > 0.1), float(v[0] * v[1] + 0.3 * v[2])) for v in values]
    return spark.createDataFrame(made, "a double, b double, c double, d double, e double, y double, z double").repartition(5)


def all_scored(rows, target, classes, most):
    specs = X.candidates(FEATURES, OPS)
    long = X.melt(X.apply_specs(rows.withColumn("_t", rows[target]), specs), [*FEATURES, *[s.name for s in specs]], ["_t"]).withColumnRenamed("_t", "y")
    scores = {r["feature"]: r["score"] for r in (T.regression_scores(long) if classes is None else T.binary_scores(long)).collect()}
    base = max(scores[f] for f in FEATURES)
    better = sorted(((s.name, scores[s.name]) for s in specs if scores[s.name] > base), key=lambda r: (-r[1], r[0]))
    return scores, better[:most]


@pytest.mark.parametrize("target, classes, most", [("y", 2, 1), ("z", None, 1), ("y", 2, 50)])
def test_search_accepts_what_all_scores_accept(rows, target, classes, most):
    found = S.search(rows, FEATURES, X.candidates(FEATURES, OPS), target, classes, most=most, batch=6)
    scores, expected = all_scored(rows, target, classes, most)
    assert [f for f, _ in found.accepted] == [f for f, _ in expected]
    assert [s for _, s in found.accepted] == pytest.approx([s for _, s in expected], abs=1e-9)
    assert expected[0][0] == "a__x__b"
    assert all(bound >= scores[f] - 1e-9 for f, bound in found.bounds.items())
    assert len(found.bounds) == len(X.candidates(FEATURES, OPS)) and len(found.scored) <= len(found.bounds)
    if most == 1:
        assert len(found.scored) < len(found.bounds) / 2


def best_cutting(x, y, cuts, regression):
    """The best value of any cutting of the line into ``cuts + 1`` intervals, by distinct values: the definition."""
    values = np.unique(x)
    ends = [0, *np.cumsum([np.sum(x == v) for v in values])]
    own = y[np.argsort(x, kind="stable")]
    cost = lambda i, j: ((own[i:j] - own[i:j].mean()) ** 2).sum() if regression else min(own[i:j].sum(), (1 - own[i:j]).sum())
    best = {e: cost(0, e) for e in ends[1:]}
    for _ in range(cuts):
        best = {e: min([best[e], *[best[b] + cost(b, e) for b in ends[1:] if b < e]]) for e in ends[1:]}
    return best[len(x)]


@pytest.mark.parametrize("regression", [False, True])
@pytest.mark.parametrize("bins", [2, 5, 30])
def test_bound_holds_for_every_cutting(regression, bins):
    rng = np.random.default_rng(bins)
    for _ in range(20):
        x = rng.integers(0, 25, 60).astype(float)
        y = rng.normal(size=60) if regression else rng.integers(0, 2, 60).astype(float)
        values, times = np.unique(np.quantile(x, np.arange(1, bins) / bins, method="inverted_cdf"), return_counts=True)
        edges = np.unique(np.concatenate([values, np.nextafter(values[times > 1], -np.inf)]))
        at = np.searchsorted(edges, x, side="left")
        n, s, q = (np.bincount(at, w, len(edges) + 1) for w in (None, y, y * y))
        for cuts in (1, 3):
            cost = best_cutting(x, y, cuts, regression)
            if regression:
                assert S.least_error(n, s, q, S.single_valued(edges), cuts) <= cost + 1e-9
            else:
                assert S.most_right(n, s, S.single_valued(edges), cuts) >= len(x) - cost


def test_a_bin_for_each_value_makes_the_bound_exact():
    x, y = np.repeat(np.arange(6.0), 5), np.repeat([0.0, 1.0, 1.0, 0.0, 1.0, 0.0], 5)
    y[0] = 1.0
    edges = np.unique(np.concatenate([np.arange(6.0), np.nextafter(np.arange(6.0), -np.inf)]))
    at = np.searchsorted(edges, x, side="left")
    n, s, q = (np.bincount(at, w, len(edges) + 1) for w in (None, y, y * y))
    single = S.single_valued(edges) | (n == 0)
    for cuts in (0, 1, 3):
        assert len(x) - S.most_right(n, s, single, cuts) == best_cutting(x, y, cuts, False)
        assert S.least_error(n, s, q, single, cuts) == pytest.approx(best_cutting(x, y, cuts, True), abs=1e-9)


def test_edge_cases(spark, rows):
    specs = X.candidates(["a", "b"])
    empty = S.search(rows.limit(0), ["a", "b"], specs, "y", 2)
    assert empty.accepted == [] and empty.scored == []
    assert S.search(rows, ["a", "b"], [], "y", 2).accepted == []
    constant = S.search(rows.selectExpr("a", "b", "1.5 AS z"), ["a", "b"], specs, "z", None)
    assert constant.accepted == []
    holes = spark.createDataFrame([(1.0, 2.0, 1.0), (None, 3.0, 0.0), (2.0, None, None), (-1.0, 2.0, 0.0), (-3.0, -2.0, 1.0)] * 4, "a double, b double, y double")
    found = S.search(holes, ["a", "b"], specs, "y", 2)
    assert set(found.bounds) == {s.name for s in specs}
    with pytest.raises(ValueError):
        S.search(rows, ["a"], [X.FeatureSpec("lag", ("a",), 1)], "y", 2)
    with pytest.raises(ValueError):
        S.search(rows, ["a", "b"], specs, "y", 3)
