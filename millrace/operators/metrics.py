"""Validation metrics from prediction rows, a row for each group: one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running


def regression(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    """Mean absolute and squared errors and R squared."""
    error = F.col(y) - F.col(yhat)
    sums = df.groupBy(*by).agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("_v"))
    return sums.withColumn("r2", 1 - F.try_divide("mse", F.nullif("_v", F.lit(0.0)))).drop("_v")


def binary(df: DataFrame, y: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, specificity and F1; a ratio by zero is null."""
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(predicted) == b))
    c = df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    share = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tn, tn + fp).alias("specificity"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def multiclass(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """``(label, support, f1)``: every row counts once as truth and once as prediction, so classes need no list."""
    sides = F.array(F.struct(F.col(y).alias("label"), F.lit(1).alias("truth"), (F.col(y) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("truth"), F.lit(0).alias("hit")))
    counts = df.select(F.explode(sides).alias("s")).groupBy("s.label").agg(F.sum("s.truth").alias("support"), F.sum("s.hit").alias("hits"), F.count(F.lit(1)).alias("both"))
    return counts.select("label", "support", (2.0 * F.col("hits") / F.col("both")).alias("f1"))


def log_loss(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Of the probability of class 1, kept 1e-15 away from 0 and 1."""
    kept = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    return df.groupBy(*by).agg(F.avg(-F.when(F.col(y) == 1, F.ln(kept)).otherwise(F.ln(1 - kept))).alias("log_loss"))


def log_loss_classes(df: DataFrame, y: str, probabilities: str, by: list[str] = ()) -> DataFrame:
    """Of an array with the probability of each class 0, 1, ...; that of the true class counts, kept 1e-15 away from 0 and 1.

    Rows with a null label or array are left out; a label outside the array has probability 0.
    """
    known = df.where(F.col(y).isNotNull() & F.col(probabilities).isNotNull())
    p = F.coalesce(F.get(probabilities, F.col(y).cast("int")), F.lit(0.0))
    return known.groupBy(*by).agg(F.avg(-F.ln(F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15)))).alias("log_loss"))


def _steps(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """``(*by, score, p, n, fp, tp, all_n, all_p)``: positives, negatives, both summed down to the score, and in all; equal scores are one row."""
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    points = known.groupBy(*by, score).agg(F.sum(F.col(y).cast("double")).alias("p"), F.sum(1.0 - F.col(y)).alias("n"))
    total = points.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    summed = running(points, by, [score], {"tp": ("sum", F.col("p")), "fp": ("sum", F.col("n"))}, reverse=True)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return summed.join(F.broadcast(total) if not by else total, same).drop(*[f"_t_{c}" for c in by])


def roc(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """``(*by, score, fpr, tpr)`` by falling score; rows with null score or label are left out, rates of a group of one label are null."""
    return _steps(df, y, score, by).select(*by, score, F.try_divide("fp", "all_n").alias("fpr"), F.try_divide("tp", "all_p").alias("tpr"))


def roc_band(df: DataFrame, y: str, score: str, fold: str, points: int = 100) -> DataFrame:
    """``(i, fpr, mean_tpr, low, high)``: the mean curve of the folds at evenly spaced rates, a standard deviation below and above, within 0 and 1.

    Each fold's curve is drawn straight between its scores; of several heights at one rate the highest counts, but at rate 0 every curve starts at 0.
    A fold of one label has no curve. Each segment of a curve gives the grid points that it covers, so no fold is gathered anywhere.
    """
    curve = _steps(df, y, score, [fold]).where("all_p > 0 and all_n > 0")
    x1, x0 = F.col("fp") / F.col("all_n"), (F.col("fp") - F.col("n")) / F.col("all_n")
    y1, y0 = F.col("tp") / F.col("all_p"), (F.col("tp") - F.col("p")) / F.col("all_p")
    ends = curve.select(fold, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    step = 1.0 / (points - 1)
    first, last = F.floor(F.col("x0") / step).cast("long"), F.ceil(F.col("x1") / step).cast("long")
    over = ends.withColumn("i", F.explode(F.sequence(first, last))).withColumn("fpr", F.col("i") / (points - 1))
    over = over.where((F.col("fpr") >= F.col("x0")) & (F.col("fpr") <= F.col("x1")) & (F.col("i") < points))
    height = F.when(F.col("i") == 0, 0.0).when(F.col("x1") == F.col("x0"), F.col("y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("fpr") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    each = over.groupBy(fold, "i").agg(F.max("fpr").alias("fpr"), F.max(height).alias("tpr"))
    both = each.groupBy("i").agg(F.max("fpr").alias("fpr"), F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("_sd"))
    return both.select("i", "fpr", "mean_tpr", F.greatest(F.col("mean_tpr") - F.col("_sd"), F.lit(0.0)).alias("low"), F.least(F.col("mean_tpr") + F.col("_sd"), F.lit(1.0)).alias("high"))


def auc(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """Area under the curve, by trapezoids; null for a group of one label."""
    area = F.col("n") * (2 * F.col("tp") - F.col("p")) / 2
    sums = _steps(df, y, score, by).groupBy(*by).agg(F.sum(area).alias("_a"), F.max(F.col("all_n") * F.col("all_p")).alias("_w"))
    return sums.select(*by, F.try_divide("_a", "_w").alias("auc"))


def worst_case(ledger: DataFrame) -> DataFrame:
    """The ledger with ``worst_case`` = mean - standard deviation of the objective."""
    return ledger.withColumn("worst_case", F.col("mean_objective") - F.col("std_objective"))


def best_params(ledger: DataFrame, by: list[str]) -> DataFrame:
    """The parameters with the best worst case, by group."""
    return worst_case(ledger).groupBy(*by).agg(F.max_by("params", F.struct("worst_case", "params")).alias("params"), F.max("worst_case").alias("worst_case"))
