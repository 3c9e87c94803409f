"""Derived features: recipes as values, their expressions, and the scores that accept or reject them."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ordered import along, running
from ..functions.storage import checkpointed
from .cleaning import BOUND, clip


@dataclass(frozen=True)
class FeatureSpec:
    """A recipe: ``op`` on ``inputs`` with parameter ``k``. The name follows from it and gives it back."""

    op: str
    inputs: tuple[str, ...]
    k: int = 0

    @property
    def name(self) -> str:
        if self.op in ("sin", "cos"):
            return f"{self.op}__{self.inputs[0]}"
        if self.op in ("diff", "lag"):
            return f"{self.inputs[0]}__{self.op}__{self.k}"
        return f"__{self.op}__".join(self.inputs)

    @classmethod
    def parse(cls, name: str) -> "FeatureSpec":
        parts = name.split("__")
        if parts[0] in ("sin", "cos") and len(parts) == 2:
            return cls(parts[0], (parts[1],))
        if len(parts) == 3 and parts[1] in ("diff", "lag"):
            return cls(parts[1], (parts[0],), int(parts[2]))
        if len(parts) == 3 and parts[1] in ("x", "d", "add", "sub"):
            return cls(parts[1], (parts[0], parts[2]))
        raise ValueError(f"{name} is no derived feature")

    def expr(self, order: list[str] = (), by: list[str] = (), look_ahead: bool = False, window: WindowSpec | None = None) -> Column:
        a, b = F.col(self.inputs[0]), F.col(self.inputs[-1])
        if self.op == "x":
            return bounded(a * b)
        if self.op == "d":
            return ratio(a, b)
        if self.op == "add":
            return bounded(a + b)
        if self.op == "sub":
            return bounded(a - b)
        if self.op in ("sin", "cos"):
            return bounded(getattr(F, self.op)(a))
        w = window if window is not None else Window.partitionBy(*by).orderBy(*order)
        if self.op == "lag":
            return F.coalesce((F.lead if look_ahead else F.lag)(a, self.k).over(w), F.lit(0.0))
        return bounded(difference(a, self.k, w))


def bounded(c: Column) -> Column:
    return F.coalesce(clip(c), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b within ±1e12; by zero: the bound of the sign of a, and 0 for 0 / 0."""
    by_zero = F.when(a > 0, BOUND).when(a < 0, -BOUND).otherwise(0.0)
    return F.when(b == 0, by_zero).otherwise(bounded(F.try_divide(a, b)))


def difference(a: Column, k: int, w: Window) -> Column:
    """The k-th difference along ``w``, 0 where a row has fewer than k before it: binomial sum of lags, so one window pass."""
    total, coefficient = None, 1
    for i in range(k + 1):
        term = F.lit(float(coefficient)) * (F.lag(a, i).over(w) if i else a)
        total = term if total is None else total + term
        coefficient = -coefficient * (k - i) // (i + 1)
    return F.when(F.lag(F.lit(1), k).over(w).isNotNull(), total).otherwise(0.0) if k else total


def candidates(columns: list[str], ops: Iterable[str] = ("x", "d")) -> list[FeatureSpec]:
    """Products and sums of unordered, ratios and differences of ordered pairs; sines and cosines."""
    out = []
    for op in ops:
        if op in ("sin", "cos"):
            out += [FeatureSpec(op, (c,)) for c in columns]
        else:
            pairs = combinations if op in ("x", "add") else permutations
            out += [FeatureSpec(op, p) for p in pairs(columns, 2)]
    return out


def apply_specs(df: DataFrame, specs: list[FeatureSpec], order: list[str] = (), by: list[str] = (), look_ahead: bool = False, spread: bool | None = None) -> DataFrame:
    """All recipes in one projection; inputs that are missing count as 0. Lags and differences of one long series (no ``by``) run over stretches with halos."""
    missing = {c for s in specs for c in s.inputs if c not in df.columns}
    df = df.withColumns({c: F.lit(0.0) for c in sorted(missing)}) if missing else df
    reach = max([s.k for s in specs if s.op in ("diff", "lag")], default=0)
    if not reach:
        return df.select("*", *[s.expr(order, by).alias(s.name) for s in specs])
    ahead = reach if look_ahead else 0
    return along(df, list(order), list(by), reach, ahead, lambda rows, w: rows.select("*", *[s.expr(order, by, look_ahead, w).alias(s.name) for s in specs]), spread)


def melt(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``(*keep, feature, x)``, a row for each column: many features scored in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("f")).select(*keep, "f.feature", "f.x")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, r)`` of all pairs of columns, from one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def colinear(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """The later column of each pair whose correlation exceeds the threshold; undefined ones are not colinear."""
    found = {r["b"] for r in correlations(df, columns).collect() if r["r"] is not None and abs(r["r"]) > threshold}
    return [c for c in columns if c in found]


def stump_scores(long: DataFrame) -> DataFrame:
    """``(feature, threshold, accuracy)``: the best one-split classifier of rows ``(feature, x, y)``, y 0 or 1.

    Rows with equal x are counted first, so running totals are over distinct values only. A split is the midpoint of two
    neighbouring values; both sides predict their majority; the lowest threshold wins ties; rows with null x are left out.
    """
    counts = checkpointed(long.where("x is not null").groupBy("feature", "x").agg(F.sum("y").cast("double").alias("ones"), F.count(F.lit(1)).cast("double").alias("n")))
    total = counts.groupBy("feature").agg(F.sum("ones").alias("t1"), F.sum("n").alias("t"))
    cut = running(counts, ["feature"], ["x"], {"l1": ("sum", F.col("ones")), "l": ("sum", F.col("n"))}).join(total, "feature").where("l < t")
    right_ones, right = F.col("t1") - F.col("l1"), F.col("t") - F.col("l")
    good = F.greatest(F.col("l1"), F.col("l") - F.col("l1")) + F.greatest(right_ones, right - right_ones)
    best = cut.groupBy("feature").agg(F.min(F.struct((-(good / F.col("t"))).alias("loss"), "x")).alias("b"))
    beyond = counts.join(best, "feature").where(F.col("x") > F.col("b.x")).groupBy("feature", "b").agg(F.min("x").alias("next"))
    return beyond.select("feature", ((F.col("b.x") + F.col("next")) / 2).alias("threshold"), (-F.col("b.loss")).alias("accuracy"))


def accept(scores: DataFrame, originals: list[str], most: int = 50) -> DataFrame:
    """Derived features that score above every original one, at most ``most``, best first."""
    base = scores.where(F.col("feature").isin(originals)).agg(F.max("accuracy").alias("base"))
    better = scores.where(~F.col("feature").isin(originals)).join(F.broadcast(base), F.col("accuracy") > F.col("base"))
    return better.select("feature", "accuracy").orderBy(F.desc("accuracy"), "feature").limit(most)


def accept_each(scores: DataFrame, originals: list[str], most: int = 50) -> DataFrame:
    """``(feature, component, score, rank)`` of derived features that beat the baseline, from ``(feature, component, score)``.

    The baseline of a component (a class, or one component for all) is the best score that any original feature has in it. A derived feature is accepted if it
    scores strictly above the baseline in any component; of the accepted ones the ``most`` best of each component stay, names break ties, and a feature that is among
    them in several components has a row for each. Null and NaN scores beat nothing.
    """
    known = scores.where("score is not null and not isnan(score)")
    original = F.col("feature").isin(originals)
    base = known.where(original).groupBy("component").agg(F.max("score").alias("_base"))
    derived = known.where(~original).join(base.withColumnRenamed("component", "_c"), F.col("component").eqNullSafe(F.col("_c")), "left")
    passed = derived.where("_base is null or score > _base").select("feature").distinct()
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("score"), "feature"))
    kept = derived.join(passed, "feature").select("feature", "component", "score", place.alias("rank"))
    return kept.where(F.col("rank") <= most)


def centre_distances(vector: Column, centres: list[list[float]]) -> list[Column]:
    """Euclidean distance to each centre, ``dist__i_K``; centres are constants of the plan."""
    out = []
    for i, centre in enumerate(centres):
        square = F.aggregate(F.zip_with(vector, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        out.append(F.sqrt(square).alias(f"dist__{i}_{len(centres)}"))
    return out


def centre_count(rows: int, features: int) -> int:
    """How many k-means centres serve as features: eight for each power of ten of rows, eight at least, no more than there are features."""
    return min(max(int(8 * math.log10(max(rows, 1))), 8), features)
