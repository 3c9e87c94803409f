"""The entry point from a raw table to its best model, and its parts."""

import json

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from millrace.operators import automl, cleaning, features, metrics, models
from millrace.operators.series import hash_folds


def table(spark, n=300):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), 1.0, int(a + 0.1 * b > 0)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    rows[5] = (5, None, float("inf"), 1.0, 0)
    return spark.createDataFrame(rows, "id long, a double, b double, same double, y int")


def test_target_mode(spark):
    two = spark.createDataFrame([(0, 1), (1, 2), (2, None), (3, 2)], "id long, y int")
    assert cleaning.target_mode(two, "y") == "classification"
    assert [r.y for r in cleaning.binary_target(two, "y").orderBy("id").collect()] == [1, 0, None, 0]
    words = spark.createDataFrame([("yes",), ("no",), ("1",)], "y string").where("y != 'yes'")
    assert sorted(r.y for r in cleaning.binary_target(words.selectExpr("y"), "y").where("y is not null").collect()) in ([0, 1],)
    for other in ("id = 0", "id < 0"):
        assert cleaning.target_mode(two.where(other), "y") == "regression"


def test_best_model(spark):
    df = table(spark)
    found = automl.best_model(df, "id", ["a", "b", "same"], "y", models=["ridge", "tree"], candidates=2)
    assert found.mode == "classification" and found.best["mean_objective"] > 0.85
    assert all("same" not in s for s in found.sets.values()) and all("a" in s for s in found.sets.values())
    whole = [r for r in found.ledger if r["resource"] == 1.0]
    assert found.best in whole and len(whole) < len(found.ledger) and automl.worst_case(found.best) == max(map(automl.worst_case, whole))
    assert automl.production_score(found.published, df) > 0.85
    with pytest.raises(ValueError):
        automl.best_model(df.withColumn("y", df.y * None), "id", ["a"], "y")
    with pytest.raises(ValueError):
        automl.optimise({}, [], 2, "id", 3, model="tree")
    with pytest.raises(ValueError):
        automl.validate(df, "no such model", {}, 2, 3)


def test_top_settings():
    rows = [{"model": m, "dataset": d, "mean_objective": a, "std_objective": s} for m, d, a, s in (("x", "1", 0.9, 0.3), ("y", "1", 0.8, 0.1), ("z", "2", 0.75, 0.0))]
    assert [r["model"] for r in automl.top_settings(rows, 2)] == ["z", "y"]
    assert [r["model"] for r in automl.top_settings(rows, 2, {("z", "2")})] == ["y"]


def test_roc_band(spark):
    """Against numpy's interpolation where no two scores of a fold share a rate."""
    rng = np.random.default_rng(2)
    rows = [(f, int(y), float(s)) for f in range(3) for y, s in zip(rng.integers(0, 2, 150), rng.normal(size=150))] + [(3, 1, 0.5), (0, None, 1.0)]
    got = {r.i: r for r in metrics.roc_band(spark.createDataFrame(rows, "fold int, y int, s double"), "y", "s", "fold").collect()}
    grid, curves = np.linspace(0, 1, 100), []
    for f in range(3):
        y = np.array([r[1] for r in sorted((r for r in rows if r[0] == f and r[1] is not None), key=lambda r: -r[2])])
        fpr, tpr = np.r_[0, np.cumsum(1 - y) / (1 - y).sum()], np.r_[0, np.cumsum(y) / y.sum()]
        top = {x: max(tpr[fpr == x]) for x in fpr}
        low = {x: min(tpr[fpr == x]) for x in fpr}
        own = []
        for g in grid:
            before, after = fpr[fpr <= g + 1e-12].max(), fpr[fpr >= g - 1e-12].min()
            own.append(top[before] if before == after else top[before] + (low[after] - top[before]) * (g - before) / (after - before))
        curves.append([0.0, *own[1:]])
    assert sorted(got) == list(range(100))
    assert np.allclose([got[i].mean_tpr for i in range(100)], np.mean(curves, 0))
    assert np.allclose([got[i].high for i in range(100)], np.minimum(np.mean(curves, 0) + np.std(curves, 0), 1))
    assert metrics.roc_band(spark.createDataFrame([], "fold int, y int, s double"), "y", "s", "fold").count() == 0


def row(model, mean, std=0.0, resource=1.0, params="{}"):
    return {"model": model, "dataset": "d", "params": params, "mean_objective": mean, "std_objective": std, "resource": resource}


def test_shares_and_nan_do_not_win():
    nan = float("nan")
    ledger = [row("lucky share", 0.99, resource=0.2), row("failed", nan), row("whole", 0.9, 0.1), row("steady", 0.85, 0.01), row("no deviation", 0.95, nan)]
    assert models.best_of(ledger)["model"] == models.best_of(ledger[::-1])["model"] == "steady"
    assert [r["model"] for r in automl.top_settings(ledger, 2)] == ["steady", "whole"]
    with pytest.raises(ValueError):
        models.best_of([row("failed", nan), row("share", 0.5, resource=0.6)])


def test_a_planted_lucky_share_does_not_win(spark):
    """The first fifth of the hash order is easy for any tree, the rest is noise: a share's score is far above every full one."""
    rng = np.random.default_rng(1)
    t = spark.createDataFrame([(i, float(a), float(n)) for i, (a, n) in enumerate(rng.normal(size=(600, 2)))], "id long, a double, n double")
    place = F.pmod(F.xxhash64(F.lit("halving"), "id"), F.lit(1 << 20)) / float(1 << 20)
    t = hash_folds(t.withColumn("y", F.when(place < 0.2, F.col("a") > 0).otherwise(F.col("n") > 0).cast("double")), 3, "id")
    found = models.halving(models.prepare(t, ["a"], "y"), "d", "tree", models.registry(2)["tree"], [{"maxDepth": 1}, {"maxDepth": 2}], 3, "accuracy", "id")
    assert {r["resource"] for r in found} == {0.2, 1.0}
    best, lucky = models.best_of(found), max(found, key=models.worst_case)
    assert best["resource"] == 1.0 and lucky["resource"] == 0.2 and models.worst_case(lucky) > models.worst_case(best) + 0.2


def test_compare_against_fits_by_hand(spark):
    t = hash_folds(table(spark).na.fill(0.0).where("b < 1e9"), 3, "id")
    data = models.prepare(t, ["a", "b"], "y")
    found = models.compare(data, "d", {"tree": models.registry(2)["tree"]}, 3, "accuracy", {"tree": [{"maxDepth": 1}, {"maxDepth": 3}]})
    for r in found:
        scores = []
        for fold in range(3):
            model = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", seed=42, **json.loads(r["params"])).fit(data.where(f"fold <> {fold}"))
            rows = model.transform(data.where(f"fold = {fold}")).select("_label", "prediction").collect()
            scores.append(np.mean([x._label == x.prediction for x in rows]))
        assert r["mean_objective"] == pytest.approx(np.mean(scores)) and r["std_objective"] == pytest.approx(np.std(scores))
    done = {("tree", "d", found[0]["params"])}
    assert [r["params"] for r in models.compare(data, "d", {"tree": models.registry(2)["tree"]}, 3, "accuracy", {"tree": [{"maxDepth": 1}, {"maxDepth": 3}]}, done)] == [found[1]["params"]]


def test_a_failed_model_has_no_score(spark, monkeypatch):
    data = models.prepare(hash_folds(table(spark).where("b < 1e9 and a is not null"), 2, "id"), ["a", "b"], "y")
    monkeypatch.setattr(models, "failed", lambda model: True)
    (got,) = models.compare(data, "d", {"ridge": models.registry(2)["ridge"]}, 2, "accuracy")
    assert np.isnan(got["mean_objective"]) and models.worst_case(got) == float("-inf")


def test_best_model_derives_features(spark):
    """The target is the sign of a product, which no single column tells."""
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), float(a) * 2, float(a * b > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, twice double, y double")
    found = automl.best_model(df, "id", ["a", "b", "twice"], "y", models=["tree"], candidates=2)
    names = [s.name for s in found.published.specs]
    assert "a__x__b" in names and "a__x__b" in found.sets[found.best["dataset"]] and all("twice" not in f for s in found.sets.values() for f in s)
    assert found.best["mean_objective"] > 0.95 and automl.production_score(found.published, df) > 0.95


def test_classes_and_modes(spark):
    labels = lambda values, kind: cleaning.class_labels(spark.createDataFrame([(v,) for v in values], f"y {kind}"), "y")
    assert labels([0.0, 1.0, None, float("nan"), 2.0], "double") == [0.0, 1.0, 2.0]
    assert labels([1, 0, None], "int") == [0, 1] and labels(["b", "a"], "string") == ["a", "b"]
    for bad in ([0.2, 1.7], [0.0, 2.0], [1.0, 2.0], [-1.0, 0.0]):
        with pytest.raises(ValueError):
            labels(bad, "double")
    gappy = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "y double")
    assert cleaning.target_mode(gappy, "y") == "classification"
    assert [r.y for r in cleaning.binary_target(gappy, "y").collect()] == [0, 1, None, None]


def test_accept_by_component(spark):
    rows = [("a", 0, 0.5), ("a", 1, 0.9), ("b", 0, 0.7), ("b", 1, 0.1), ("p", 0, 0.71), ("p", 1, 0.0), ("q", 0, 0.7), ("q", 1, 0.9), ("r", 0, 0.1), ("r", 1, 0.95), ("s", 0, float("nan")), ("s", 1, None)]
    scores = spark.createDataFrame(rows, "feature string, component int, score double")
    assert {r.feature for r in features.accept_each(scores, ["a", "b"]).collect()} == {"p", "r"}
    assert {(r.feature, r.component) for r in features.accept_each(scores, ["a", "b"], 1).collect()} == {("p", 0), ("r", 1)}
