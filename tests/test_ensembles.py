"""Exported ensembles: Shapley values against all subsets, prefixes against separate fits, halving by the number of trees."""

import itertools
import json
import math

import numpy as np
import pytest

from millrace.operators import ensembles as E
from millrace.operators import models as M

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = [(i, float(a), float(b), float(c), float(a * b + 0.5 * c > 0), float(a * b + c)) for i, (a, b, c) in enumerate(rng.normal(size=(400, 3)))]
    t = spark.createDataFrame(made, "id long, a double, b double, c double, y double, z double").withColumnRenamed("id", "key")
    return t.selectExpr("*", "cast(key % 2 as int) AS fold")


def expected(tree, x, known, label, node=0):
    """What a tree expects of a row of which only ``known`` features are known: the definition."""
    if tree.left[node] < 0:
        return tree.value[node, label]
    f, left, right = tree.feature[node], tree.left[node], tree.right[node]
    if f in known:
        return expected(tree, x, known, label, left if x[f] <= tree.threshold[node] else right)
    return sum(tree.cover[c] * expected(tree, x, known, label, c) for c in (left, right)) / tree.cover[node]


def by_subsets(ensemble, x, label):
    m, out = len(x), np.zeros(len(x))
    scale = 1 / len(ensemble.trees) if ensemble.mean else 1
    say = lambda known: sum(w * scale * expected(t, x, known, label) for t, w in zip(ensemble.trees, ensemble.weights))
    for j in range(m):
        others = [k for k in range(m) if k != j]
        for size in range(m):
            for s in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                out[j] += weight * (say({*s, j}) - say(set(s)))
    return say(set()), out


@pytest.mark.parametrize("name,classes,params", [("forest", 2, {"numTrees": 4, "maxDepth": 4}), ("tree", 2, {"maxDepth": 5}), ("boosting", 2, {"maxIter": 4, "maxDepth": 3}), ("forest", None, {"numTrees": 3, "maxDepth": 5}), ("boosting", None, {"maxIter": 3, "maxDepth": 2})])
def test_shapley_values(rows, name, classes, params):
    data = M.prepare(rows, FEATURES, "y" if classes else "z")
    model = M.registry(classes)[name](**params).fit(data)
    ensemble = E.export(model)
    found = E.shap_values(data, ensemble).collect()
    said = {r.key: r for r in model.transform(data).collect()}
    for r in found[:40]:
        label = 1 if ensemble.kind == "classes" else 0
        base, values = by_subsets(ensemble, [r.a, r.b, r.c], label)
        assert r.base == pytest.approx(base) and np.allclose(r.shap, values)
    for r in found:
        assert r.base + sum(r.shap) == pytest.approx(r.explained)
        own = said[r.key]
        truth = own.probability[1] if ensemble.kind == "classes" else own.rawPrediction[1] if ensemble.kind == "margin" else own.prediction
        assert r.explained == pytest.approx(truth)
    ranking = E.shap_ranking(E.shap_values(data, ensemble), FEATURES, 2).collect()
    means = np.mean(np.abs([r.shap for r in found]), axis=0)
    assert [r.mean_abs for r in ranking] == pytest.approx(sorted(means, reverse=True)[:2])


def test_a_path_that_asks_a_feature_twice():
    tree = E.Tree(np.array([0, 0, -1, -1, -1]), np.array([0.0, -1.0, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), np.array([[0.0], [0.0], [5.0], [1.0], [2.0]]), np.array([10.0, 6.0, 4.0, 2.0, 4.0]))
    ensemble = E.Ensemble([tree], [1.0], True, "number")
    x = np.array([[-2.0, 0.0], [-0.5, 0.0], [3.0, 0.0]])
    for row, got in zip(x, E.Explainer(ensemble).values(x)):
        assert np.allclose(got, by_subsets(ensemble, row, 0)[1])


@pytest.mark.parametrize("classes", [2, None])
def test_prefixes_are_separate_fits(rows, classes):
    data = M.prepare(rows, FEATURES, "y" if classes else "z")
    make = M.registry(classes)["boosting"]
    found = {r.key: r.predictions for r in E.prefix_predictions(data, E.export(make(maxIter=6, maxDepth=3).fit(data)), [1, 3, 6]).collect()}
    for i, size in enumerate([1, 3, 6]):
        alone = {r.key: r.prediction for r in make(maxIter=size, maxDepth=3).fit(data).transform(data).collect()}
        assert all(found[k][i] == pytest.approx(v) for k, v in alone.items())


def test_prefixes_of_a_forest(rows):
    data = M.prepare(rows, FEATURES, "z")
    model = M.registry(None)["forest"](numTrees=5, maxDepth=4).fit(data)
    found = {r.key: r.predictions for r in E.prefix_predictions(data, E.export(model), [1, 2, 5]).collect()}
    for r in model.transform(data).where("key < 30").collect():
        each = [t.predict(r._features) for t in model.trees]
        assert found[r.key] == pytest.approx([np.mean(each[:1]), np.mean(each[:2]), r.prediction])


def test_size_curve_and_halving(rows):
    data = M.prepare(rows, FEATURES, "y")
    make = M.registry(2)["boosting"]
    curve = M.size_curve(data, make, {"maxDepth": 2}, [2, 6], 2, "accuracy")
    for size in (2, 6):
        alone = M.cross_validate(data, make(maxDepth=2, maxIter=size), 2, "accuracy")
        assert float(np.mean(curve[size][0])) == pytest.approx(alone["mean_objective"])
    found = M.halving_by_size(data, "d", "boosting", make, [{"maxDepth": d} for d in (1, 2, 3, 4)], 2, "accuracy", least=2, most=8, factor=2)
    assert [r["resource"] for r in found].count(0.25) == 4 and [r["resource"] for r in found].count(0.5) == 2
    last = [r for r in found if r["resource"] == 1.0]
    assert sorted(json.loads(r["params"])["maxIter"] for r in last) == [2, 4, 8]
    best = M.best_of(found)
    assert best in last and best is found[0]
    alone = M.cross_validate(data, make(**json.loads(best["params"])), 2, "accuracy")
    assert alone["mean_objective"] == pytest.approx(best["mean_objective"])
