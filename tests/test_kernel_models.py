"""Kernel machines over random Fourier features, and principal axes, against numpy."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from millrace.operators import models as M
from millrace.operators import neighbours as N
from millrace.operators.fourier import FourierFeatures

rng = np.random.default_rng(3)


def _ring(spark, classes):
    """Classes by distance from the middle: no line separates them."""
    points = rng.uniform(-2, 2, (600, 2))
    label = np.digitize((points**2).sum(1), [1.6, 3.2][: classes - 1])
    rows = [(i, float(x), float(y), float(c)) for i, ((x, y), c) in enumerate(zip(points, label))]
    t = spark.createDataFrame(rows, "id long, a double, b double, y double").withColumn("fold", (F.col("id") % 3).cast("int"))
    return M.prepare(t, ["a", "b"], "y")


def test_fourier_features_approach_the_kernel(spark):
    x = rng.normal(size=(20, 3))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>").withColumn("v", array_to_vector("x"))
    made = FourierFeatures(inputCol="v", outputCol="w", number=20000, gamma=0.5).transform(t)
    z = np.array([r["w"] for r in made.orderBy("i").select(vector_to_array("w").alias("w")).collect()])
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).max() < 0.05
    assert FourierFeatures(inputCol="v", outputCol="w").transform(t.where("false")).count() == 0


def _held_out(data, name, classes, **params):
    """Accuracy on a third of the rows of a model of the others."""
    model = M.registry(classes)[name](**params).fit(data.where("fold > 0"))
    return model.transform(data.where("fold = 0")).agg(F.avg((F.col("prediction") == F.col("_label")).cast("int"))).first()[0]


def test_kernel_machine_separates_rings(spark):
    two, three = _ring(spark, 2).coalesce(2).cache(), _ring(spark, 3).coalesce(2).cache()
    assert _held_out(two, "kernel", 2) > 0.92 > 0.8 > _held_out(two, "svc", 2, maxIter=10)
    assert _held_out(three, "kernel", 3, number=64) > 0.85


def test_kernel_ridge_and_its_stored_model(spark, tmp_path):
    data = _ring(spark, 2).withColumn("_label", F.sin(F.col("a") * 2) + F.col("b") * F.col("b")).coalesce(2).cache()
    score = lambda name: M.cross_validate(data, M.registry(None)[name](), 3, "r2")["mean_objective"]
    assert score("kernel") > 0.95 > 0.5 > score("ridge")
    fitted = M.registry(None)["kernel"](gamma=0.7, number=50).fit(data)
    fitted.write().overwrite().save(f"file://{tmp_path}/model")
    again = PipelineModel.load(f"file://{tmp_path}/model")
    own, other = (m.transform(data).orderBy("id").select("prediction").toPandas()["prediction"].to_numpy() for m in (fitted, again))
    assert np.array_equal(own, other)
    assert "kernel" not in M.probabilistic(M.registry(2)) and len(M.draw("kernel", 4)) == 4


def test_principal_points(spark):
    x = rng.normal(size=(300, 3)) @ np.array([[3, 1, 0], [0, 1, 0.2], [0, 0, 0.3]])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    t = spark.createDataFrame([*rows, (900, None, 1.0, 1.0)], "id long, p double, q double, r double")
    turned = np.array([tuple(r)[1:] for r in N.principal_points(t, "id", ["p", "q", "r"]).orderBy("id").collect()])
    spread = np.cov(turned.T, bias=True)
    assert len(turned) == 300 and np.allclose(np.diag(spread), np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
    assert np.allclose(spread, np.diag(np.diag(spread)), atol=1e-9)
    assert np.allclose(((turned[0] - turned[1:]) ** 2).sum(1), ((x[0] - x[1:]) ** 2).sum(1))
    assert N.principal_points(t.where("false"), "id", ["p", "q", "r"]).count() == 0
    assert N.kd_leaves(N.principal_points(t, "id", ["p", "q", "r"]), "id", ["p", "q", "r"], 2).groupBy("node").count().count() == 4
