"""Stored plans: cleaning, features, scales and model of a published predictor, replayed on new data.

A published folder holds ``manifest`` (one row of JSON) and ``model`` (the writer of ``pyspark.ml``); nothing is pickled.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators.cleaning import CleanPlan
from ..operators.features import FeatureSpec, apply_specs
from ..operators.series import fit_standard, restore, standardise


@dataclass
class Published:
    """``scales`` are those of the features; ``target_scale`` is (0, 1) for classes."""

    plan: CleanPlan
    specs: list[FeatureSpec]
    features: list[str]
    target: str
    scales: dict[str, tuple[float, float]]
    target_scale: tuple[float, float]
    classes: int | None
    model: PipelineModel | None = None

    def convert(self, df: DataFrame) -> DataFrame:
        """New data as the model sees it: cleaned, with features, scaled."""
        made = apply_specs(self.plan.apply(df), self.specs, self.plan.order, self.plan.by)
        return standardise(made.na.fill(0.0, subset=self.features), self.scales)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` converted, with ``predicted``: the restored target, the probability of class 1 where the model has one, else the class."""
        # the target may be missing in new data; the plan then reads it as null
        given = df if self.target in df.columns else df.withColumn(self.target, F.lit(None).cast("double"))
        rows = M.VectorAssembler(inputCols=self.features, outputCol="_features").transform(self.convert(given))
        scored = self.model.transform(rows)
        if self.classes is None:
            predicted = restore(F.col("prediction"), self.target_scale)
        elif self.classes == 2 and "probability" in scored.columns:
            predicted = vector_to_array("probability")[1]
        else:
            predicted = F.col("prediction")
        return scored.withColumn("predicted", predicted).drop("_features", "_scaled", "_waves", "rawPrediction", "probability", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"plan": asdict(self.plan), "specs": [s.name for s in self.specs], "features": self.features, "target": self.target, "scales": self.scales, "target_scale": self.target_scale, "classes": self.classes})
        self.model.write().overwrite().save(f"{path.rstrip('/')}/model")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/manifest")


def load(spark: SparkSession, path: str) -> Published:
    held = json.loads(spark.read.text(f"{path.rstrip('/')}/manifest", wholetext=True).first()[0])
    plan = CleanPlan(**{**held["plan"], "limits": {c: tuple(v) for c, v in held["plan"]["limits"].items()}})
    scales = {c: tuple(v) for c, v in held["scales"].items()}
    model = PipelineModel.load(f"{path.rstrip('/')}/model")
    return Published(plan, [FeatureSpec.parse(s) for s in held["specs"]], held["features"], held["target"], scales, tuple(held["target_scale"]), held["classes"], model)


def publish(df: DataFrame, plan: CleanPlan, specs: list[FeatureSpec], features: list[str], target: str, classes: int | None, model: str, params: dict | None = None) -> Published:
    """Fit ``model`` of the registry on all rows of ``df`` with a target."""
    made = apply_specs(plan.apply(df), specs, plan.order, plan.by).na.fill(0.0, subset=features)
    scales = fit_standard(made, features)
    target_scale = (0.0, 1.0) if classes else fit_standard(made, [target])[target]
    rows = standardise(made, scales).withColumn(target, (F.col(target) - target_scale[0]) / target_scale[1])
    estimator = M.registry(classes)[model](**(params or {}))
    fitted = estimator.fit(M.prepare(rows, features, target))
    return Published(plan, specs, features, target, scales, target_scale, classes, PipelineModel([fitted]))
