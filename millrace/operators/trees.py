"""Trees on single features, many features in one job: the scores that select features.

Rows come in long form ``(feature, x, y...)``. Rows of equal x are summed first; all further work is on distinct values,
by running totals that spread one feature over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running
from ..functions.storage import checkpointed


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _leaves(long: DataFrame, ys: list[str], depth: int) -> DataFrame:
    """``(feature, node, n, *ys, square)``: sums of rows in the leaves of each feature's tree.

    A node splits at the value with the largest summed (sum of y)^2 / n of both sides, over all ``ys``: the Gini rule for class
    indicators, the variance rule for one number. Rows up to the value go left; the smallest value wins ties; null x are left out.
    """
    known = long.where(F.col("x").isNotNull() & F.col(ys[0]).isNotNull())
    square = F.sum(_sum([F.col(y) * F.col(y) for y in ys])).cast("double").alias("square")
    rows = checkpointed(known.groupBy("feature", "x").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(y).cast("double").alias(y) for y in ys], square).withColumn("node", F.lit(1)))
    for _ in range(depth):
        left = running(rows, ["feature", "node"], ["x"], {f"l_{c}": ("sum", F.col(c)) for c in ("n", *ys)})
        total = rows.groupBy("feature", "node").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", *ys)])
        both = left.join(total, ["feature", "node"]).where(F.col("l_n") < F.col("t_n"))
        gain = _sum([F.col(f"l_{y}") * F.col(f"l_{y}") / F.col("l_n") + (F.col(f"t_{y}") - F.col(f"l_{y}")) * (F.col(f"t_{y}") - F.col(f"l_{y}")) / (F.col("t_n") - F.col("l_n")) for y in ys])
        best = both.groupBy("feature", "node").agg(F.min(F.struct((-gain).alias("loss"), "x"))["x"].alias("cut"))
        went = F.coalesce((F.col("x") > F.col("cut")).cast("int"), F.lit(0))
        rows = checkpointed(rows.join(best, ["feature", "node"], "left").withColumn("node", F.col("node") * 2 + went).drop("cut"))
    return rows.groupBy("feature", "node").agg(*[F.sum(c).alias(c) for c in ("n", *ys, "square")])


def binary_scores(long: DataFrame, y: str = "y", depth: int = 3) -> DataFrame:
    """``(feature, score)``: the share of rows that a tree of this depth labels right, y 0 or 1."""
    good = F.greatest(F.col(y), F.col("n") - F.col(y))
    return _leaves(long, [y], depth).groupBy("feature").agg((F.sum(good) / F.sum("n")).alias("score"))


def regression_scores(long: DataFrame, y: str = "y", depth: int = 3) -> DataFrame:
    """``(feature, score)``: R2 of a tree of this depth; null for a constant y."""
    inner = F.sum(F.col("square") - F.col(y) * F.col(y) / F.col("n"))
    whole = F.sum("square") - F.sum(y) * F.sum(y) / F.sum("n")
    return _leaves(long, [y], depth).groupBy("feature").agg((1 - F.try_divide(inner, whole)).alias("score"))


def class_scores(long: DataFrame, classes: list, label: str = "y", depth: int = 3) -> DataFrame:
    """``(feature, class, score)``: for each class the share of its rows that get it; a leaf takes its commonest class, the first of equals."""
    ys = [f"y_{i}" for i in range(len(classes))]
    marked = long.select("feature", "x", *[(F.col(label) == c).cast("int").alias(y) for y, c in zip(ys, classes)])
    leaves = _leaves(marked, ys, depth).withColumn("_top", F.greatest(*ys) if len(ys) > 1 else F.col(ys[0]))
    chosen = F.array_position(F.array(*ys), F.col("_top")) - 1
    rows = leaves.select("feature", F.posexplode(F.array(*ys)).alias("i", "own"), chosen.alias("chosen"))
    scores = rows.groupBy("feature", "i").agg(F.try_divide(F.sum(F.when(F.col("i") == F.col("chosen"), F.col("own")).otherwise(0.0)), F.sum("own")).alias("score"))
    return scores.select("feature", F.element_at(F.array(*map(F.lit, classes)), F.col("i") + 1).alias("class"), "score")


def _medians(known: DataFrame) -> DataFrame:
    """``(feature, _median)`` of y, from running counts of distinct values."""
    counts = known.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("_c"))
    total = counts.groupBy("feature").agg(F.sum("_c").alias("_t"))
    up = running(counts, ["feature"], ["y"], {"_u": ("sum", F.col("_c"))}).join(total, "feature")
    middle = [F.min(F.when(F.col("_u") * 2 >= F.col("_t") + i, F.col("y"))) for i in (0, 1)]
    return up.groupBy("feature").agg(((middle[0] + middle[1]) / 2).alias("_median"))


def predictive_power(long: DataFrame, folds: int = 4) -> DataFrame:
    """``(feature, mae, naive, score)``: 1 - MAE / MAE of the median, at least 0, of rows ``(feature, fold, x, y)``.

    The model is a fully grown tree on one feature. Such a tree gives a held-out row the mean y of the nearest value among rows of
    the other folds, the smaller of two equally near ones, so it needs no tree: for each fold the nearest values on both sides
    are running extremes. All rows count, none are sampled.
    """
    known = long.where("x is not null and y is not null")
    each = [F.when(F.col("fold") != f, F.col("y")) for f in range(folds)]
    rows = known.groupBy("feature", "x").agg(*[F.avg(c).alias(f"m{f}") for f, c in enumerate(each)])
    at = {f: F.when(F.col(f"m{f}").isNotNull(), F.struct("x", F.col(f"m{f}").alias("m"))) for f in range(folds)}
    both = running(rows, ["feature"], ["x"], {f"low{f}": ("max", at[f]) for f in range(folds)})
    both = running(both, ["feature"], ["x"], {f"high{f}": ("min", at[f]) for f in range(folds)}, reverse=True)
    nearer = [F.when(F.col(f"high{f}").isNull() | (F.col("x") - F.col(f"low{f}.x") <= F.col(f"high{f}.x") - F.col("x")), F.col(f"low{f}.m")).otherwise(F.col(f"high{f}.m")) for f in range(folds)]
    model = both.select("feature", "x", F.array(*nearer).alias("_p"))
    median = _medians(known)
    judged = known.join(model, ["feature", "x"]).join(median, "feature")
    error = judged.groupBy("feature").agg(F.avg(F.abs(F.col("y") - F.get("_p", F.col("fold")))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("_median"))).alias("naive"))
    return error.withColumn("score", F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("mae"), F.col("naive"))))


def select_by_power(power: DataFrame, least: float) -> DataFrame:
    """``(feature, score)`` of the features whose predictive power exceeds ``least``."""
    return power.where(F.col("score") > least).select("feature", "score")
