"""Feature scores, running values, mixtures, decompositions and stored plans against plain numpy, with nulls, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.ordered import ranked, running
from millrace.operators import cleaning as C
from millrace.operators import features as X
from millrace.operators import mixtures as G
from millrace.operators import models as M
from millrace.operators import series as S
from millrace.operators import trees as T
from millrace.sources import artifacts as A

rng = np.random.default_rng(5)


def test_running_meets_ties_nulls_and_one_large_group(spark):
    rows = [("a" if i % 3 else None, i, int(rng.integers(100))) for i in range(300)]
    t = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    for reverse in (False, True):
        found = {r["o"]: (r["s"], r["m"]) for r in running(t, ["g"], ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, reverse).collect()}
        for g, o, _ in rows:
            near = [v for h, p, v in rows if h == g and (p >= o if reverse else p <= o)]
            assert found[o] == (sum(near), max(near))
    places = {r["o"]: r["place"] for r in ranked(t, [], ["o"], "place").collect()}
    assert places == {o: o + 1 for _, o, _ in rows}
    assert ranked(t.where("false"), ["g"], ["o"], "place").count() == 0


def _tree(x, y, depth):
    """Predictions of a tree by trying every cut."""
    if depth and len(set(x)) > 1:
        cuts = sorted(set(x))[:-1]
        gain = lambda c: y[x <= c].sum() ** 2 / (x <= c).sum() + y[x > c].sum() ** 2 / (x > c).sum()
        cut = max(cuts, key=lambda c: (gain(c), -c))
        out = np.empty(len(x))
        for side in (x <= cut, x > cut):
            out[side] = _tree(x[side], y[side], depth - 1)
        return out
    return np.full(len(x), y.mean())


def test_tree_scores_against_all_cuts(spark):
    x, z = rng.integers(0, 30, 200).astype(float), rng.normal(size=200)
    y = np.sin(x / 4) + 0.1 * z
    rows = [("x", float(a), float(b)) for a, b in zip(x, y)] + [("z", float(a), float(b)) for a, b in zip(z, y)] + [("x", None, 1.0), ("x", 1.0, None)]
    found = {r["feature"]: r["score"] for r in T.regression_scores(spark.createDataFrame(rows, "feature string, x double, y double")).collect()}
    for name, v in (("x", x), ("z", z)):
        expected = 1 - ((y - _tree(v, y, 3)) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        assert found[name] == pytest.approx(expected, abs=1e-9)
    assert T.binary_scores(spark.createDataFrame([], "feature string, x double, y int")).count() == 0


def test_predictive_power_against_nearest_values(spark):
    x, y, fold = rng.integers(0, 12, 80).astype(float), rng.normal(size=80), np.arange(80) % 4
    t = spark.createDataFrame([("f", int(k), float(a), float(b)) for k, a, b in zip(fold, x, y)] + [("f", 0, None, 1.0)], "feature string, fold int, x double, y double")
    (row,) = T.predictive_power(t).collect()
    errors = []
    for a, b, k in zip(x, y, fold):
        others = sorted(set(x[fold != k]), key=lambda v: (abs(v - a), v))[0]
        errors.append(abs(b - y[(fold != k) & (x == others)].mean()))
    assert row["mae"] == pytest.approx(np.mean(errors)) and row["naive"] == pytest.approx(np.abs(y - np.median(y)).mean())


def test_mixture_round_against_numpy(spark):
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(5, 2, (40, 2))])
    t = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "x array<double>")
    mixture = [(0.5, [0.0, 0.0], [1.0, 1.0]), (0.5, [4.0, 4.0], [2.0, 2.0])]
    made = G.em_round(t, "x", mixture, floor=0.0)
    p = np.stack([w * np.prod(np.exp(-((x - m) ** 2) / (2 * np.array(v))) / np.sqrt(2 * np.pi * np.array(v)), 1) for w, m, v in mixture], 1)
    r = p / p.sum(1, keepdims=True)
    for k, (w, m, v) in enumerate(made):
        mean = (r[:, k, None] * x).sum(0) / r[:, k].sum()
        assert w == pytest.approx(r[:, k].mean()) and np.allclose(m, mean)
        assert np.allclose(v, (r[:, k, None] * (x - mean) ** 2).sum(0) / r[:, k].sum())


def test_stl_finds_trend_and_season(spark):
    n = 84
    season = np.tile([3.0, 1.0, 0.0, -1.0, -3.0, -1.0, 1.0], n // 7)
    y = 0.1 * np.arange(n) + season
    t = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)] + [("short", 0, 4.0), ("a", 500, None)], "who string, at int, v double")
    rows = sorted(S.stl(t, "v", 7, "at", "who").where("who = 'a'").collect(), key=lambda r: r["at"])
    assert len(rows) == n
    assert all(r["trend"] + r["season"] + r["remainder"] == pytest.approx(r["value"]) for r in rows)
    assert max(abs(r["season"] - s) for r, s in zip(rows, season)) < 0.2
    assert max(abs(r["remainder"]) for r in rows) < 0.2
    (short,) = S.stl(t, "v", 7, "at", "who").where("who = 'short'").collect()
    assert (short["trend"], short["season"]) == (4.0, 0.0)


def test_selection_rules():
    ranked_features = [("a", 0.6), ("b", 0.36), ("c", 0.035), ("d", 0.005)]
    assert M.keep_thresholded(ranked_features) == ["a", "b"]
    assert M.keep_increment(ranked_features) == ["a", "b", "c"]
    with pytest.raises(NotImplementedError):
        M.draw("unknown", 1)
    assert M.draw("forest", 3) == M.draw("forest", 3)
    assert len(M.grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    assert "svc" not in M.probabilistic(M.registry(2))


def test_published_model_gives_its_predictions_after_loading(spark, tmp_path):
    rows = [(i, float(i % 10), float(3 * (i % 10) + 2)) for i in range(200)]
    t = spark.createDataFrame(rows, "id int, a double, y double")
    plan = C.fit(t, ["a", "y"], outliers="none", missing="mean", target="y")
    A.publish(t, plan, [X.FeatureSpec("sin", ("a",))], ["a", "sin__a"], "y", None, "ridge").save(spark, str(tmp_path / "p"))
    new = spark.createDataFrame([(1, 4.0), (2, None)], "id int, a double")
    found = {r["id"]: r["predicted"] for r in A.load(spark, str(tmp_path / "p")).predict(new).collect()}
    assert found[1] == pytest.approx(14.0, abs=0.1) and found[2] == pytest.approx(15.5, abs=0.6)


def test_stacked_columns_are_out_of_fold(spark):
    t = spark.createDataFrame([(i, i % 2, float(i % 5), float(2 * (i % 5))) for i in range(40)], "id int, fold int, a double, y double")
    made = M.stack(M.prepare(t, ["a"], "y"), "id", {"ridge": M.registry(None)["ridge"]()}, 2)
    assert made.count() == 40
    assert all(abs(r["stack__ridge"] - r["y"]) < 0.1 for r in made.collect())
    scores = {r["fold"]: r["score"] for r in M.fold_scores(M.out_of_fold(M.prepare(t, ["a"], "y"), M.registry(None)["ridge"](), 2), "r2").collect()}
    assert min(scores.values()) > 0.99


def test_shadows_leave_noise_out(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(a > 0)) for i, (a, b) in enumerate(r.normal(size=(300, 2)))]
    t = spark.createDataFrame(rows, "id int, a double, noise double, y double")
    assert M.beats_shadows(t, ["a", "noise"], "y", 2, "id", rounds=5, trees=10) == ["a"]
