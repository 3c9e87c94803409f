"""Stored centres and last-fold models: what is loaded again is what was fitted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import models as M
from millrace.sources.centres import ScaledCentres, fit_centres, load_centres
from millrace.sources.store import Store


def test_centres_come_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (40, 2)), rng.normal(30, 1, (40, 2))] * [1, 100]
    rows = [(i, float(a), float(b), 5.0) for i, (a, b) in enumerate(x)]
    t = spark.createDataFrame(rows, "id long, a double, `b c` double, flat double")
    made, store = fit_centres(t, ["a", "b c", "flat"], "id", 2), Store(spark, str(tmp_path / "store"))
    made.save(store, 1)
    held = load_centres(store, 1)
    assert held == made and held.scales["flat"] == (5.0, 1.0)
    whole = np.c_[x, np.full(80, 5.0)]
    spread = np.where(whole.std(0) > 0, whole.std(0), 1)
    scaled = (whole - whole.mean(0)) / spread
    assert sorted(c[0] for c in held.centres) == pytest.approx(sorted([scaled[:40, 0].mean(), scaled[40:, 0].mean()]))
    got = np.array([r[4:] for r in sorted(held.distances(t).collect())])
    want = np.sqrt(((scaled[:, None] - np.array(held.centres)[None]) ** 2).sum(2))
    assert np.allclose(got, want)
    # a null and a missing column count as 0 before scaling
    odd = held.distances(spark.createDataFrame([(1, None)], "id long, a double"), only=[1])
    at = (np.zeros(3) - whole.mean(0)) / spread
    assert odd.columns == ["id", "a", "dist__1_2"] and odd.first()[2] == pytest.approx(np.sqrt(((at - held.centres[1]) ** 2).sum()))


def test_no_rows_have_no_centres(spark, tmp_path):
    none = fit_centres(spark.createDataFrame([], "id long, a double"), ["a"], "id")
    assert none == ScaledCentres(["a"], {"a": (0.0, 1.0)}, [])
    store = Store(spark, str(tmp_path / "store"))
    none.save(store, 1)
    assert load_centres(store, 1) == none


def test_last_fold_model(spark, tmp_path):
    t = spark.range(120).select("id", (F.col("id") % 7).cast("double").alias("a"), ((F.col("id") % 7) > 2).cast("double").alias("y"), (F.col("id") % 4).cast("int").alias("fold"))
    rows = M.prepare(t, ["a"], "y")
    tree, keep = M.registry(2)["tree"], str(tmp_path / "folds")
    settings = {"tree": [{"maxDepth": 1}, {"maxDepth": 3}]}
    made = M.compare(rows, "d", {"tree": tree}, 4, "accuracy", settings, keep=keep)
    assert len(made) == 2
    for row, setting in zip(made, settings["tree"]):
        by_hand = tree(**setting).fit(rows.where("fold != 3")).transform(rows.where("fold = 3"))
        loaded = M.last_fold(keep, row).transform(rows.where("fold = 3"))
        assert sorted((r.id, r.prediction) for r in loaded.collect()) == sorted((r.id, r.prediction) for r in by_hand.collect())
