"""Cleaning: names, duplicates, types, outliers, missing values, constants.

Statistics are learned once (``fit_*``: one aggregate each, whose few numbers come to the driver) and replayed as
column expressions, so scoring data never changes them. Every ``apply`` is a narrow projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import quantiles, ranked, running

BOUND = 1e12
OUTLIERS, MISSING = ("boxplot", "zscore", "clip", "none"), ("remove_rows", "remove_cols", "interpolate", "mean", "zero", "none")


def clean_name(name: str) -> str:
    """Lower case; anything but letters and digits becomes one underscore."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]", "_", name.lower()))


def clean_names(df: DataFrame) -> DataFrame:
    """Columns renamed by :func:`clean_name`; of columns that then share a name the first stays."""
    first = {}
    for i, c in enumerate(df.columns):
        first.setdefault(clean_name(c), i)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for n, i in first.items()])


def drop_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Distinct rows; with ``row_id`` the smallest id of each group of equal rows stays."""
    if row_id is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != row_id]
    return df.groupBy(*rest).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def to_number(c: Column) -> Column:
    """Double; null where the value is no number, NaN or infinite."""
    return finite(c.try_cast("double"))


def to_time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def levels(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The values of a category at fit; more than ``most`` are an error, as each becomes a column."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return [r[0] for r in rows]


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """``column_level`` of 0 and 1 for each level instead of the column; null and unknown levels are 0 everywhere."""
    flags = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(clean_name(f"{column}_{v}")) for v in values]
    return df.select("*", *flags).drop(column)


# --- outliers ---

def fit_boxplot(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, tuple[float, float]]:
    """Limits 1.5 interquartile ranges outside the quartiles; ``exact=False`` takes approximate quartiles in a single pass.

    Exact quartiles are order statistics of ranges of values (:func:`millrace.functions.ordered.quantiles`), so no task holds a column.
    """
    if exact:
        found = quantiles(df, columns, [0.25, 0.75])
    else:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75], 100_000).alias(c) for c in columns]).first()
        found = {c: row[c] for c in columns}
    out = {}
    for c in columns:
        low, high = found[c] or (float("-inf"), float("inf"))
        out[c] = (low - 1.5 * (high - low), high + 1.5 * (high - low))
    return out


def fit_zscore(df: DataFrame, columns: list[str], threshold: float = 4.0, two_sided: bool = False) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    out = {}
    for c in columns:
        mean, std = row[f"m_{c}"], row[f"s_{c}"]
        known = mean is not None and std
        out[c] = (mean - threshold * std if known and two_sided else float("-inf"), mean + threshold * std if known else float("inf"))
    return out


def null_outside(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).between(low, high), F.col(c)) for c, (low, high) in limits.items()})


def clip(c: Column, low: float = -BOUND, high: float = BOUND) -> Column:
    """Nulls stay null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


# --- missing values ---

def drop_incomplete_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` without a null."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] == 0]


def interpolate(df: DataFrame, columns: list[str], order: list[str], by: list[str] = ()) -> DataFrame:
    """Linear by position among the rows of each ``by``; ends take the nearest value, and 0 where there is none.

    With ``by``, windows over each group. Without, the table is cut into ranges of ``order`` and known values are carried from range to
    range, so no task sees the whole of it; ``order`` then has to be total.
    """
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).cast("double").alias("v")))
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        # falling order: frames that reach to the end are computed anew for every row
        back, ahead = (v.rowsBetween(Window.unboundedPreceding, 0) for v in (w, Window.partitionBy(*by).orderBy(*[F.col(o).desc() for o in order])))
        out = df.withColumn("_at", F.row_number().over(w).cast("long"))
        for c in columns:
            out = out.withColumn(f"_p_{c}", F.last(known(c), ignorenulls=True).over(back)).withColumn(f"_n_{c}", F.last(known(c), ignorenulls=True).over(ahead))
    else:
        out = ranked(df, [], list(order), "_at")
        # places differ, so the largest (place, value) so far is the last one known
        out = running(out, [], ["_at"], {f"_p_{c}": ("max", known(c)) for c in columns})
        out = running(out, [], ["_at"], {f"_n_{c}": ("min", known(c)) for c in columns}, reverse=True)
    filled = {}
    for c in columns:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        slope = (n["v"] - p["v"]) * (F.col("_at") - p["_at"]) / F.greatest(n["_at"] - p["_at"], F.lit(1))
        filled[c] = F.coalesce(F.col(c), p["v"] + slope, p["v"], n["v"], F.lit(0.0))
    return out.withColumns(filled).drop("_at", *[f"_{k}_{c}" for c in columns for k in "pn"])


def fit_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def constants(df: DataFrame, columns: list[str], target: str | None = None) -> list[str]:
    """Columns with at most one value; the target never counts."""
    row = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if c != target and row[c]]


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the number of values that are null, NaN or infinite."""
    return df.agg(*[F.count_if(finite(F.col(c).cast("double")).isNull()).alias(c) for c in columns])


def _known(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is neither null nor NaN."""
    fractional = dict(df.dtypes)[target] in ("float", "double")
    return df.where(F.col(target).isNotNull() & ~F.isnan(target) if fractional else F.col(target).isNotNull())


def class_labels(df: DataFrame, target: str, most: int = 1000) -> list:
    """The classes of ``target`` in order. Numeric classes have to be 0, 1, 2, ... without a gap, else this is an error; nulls and NaN do not count."""
    rows = _known(df, target).groupBy(target).count().orderBy(target).limit(most + 1).collect()
    found = [r[0] for r in rows]
    if len(found) > most:
        raise ValueError(f"{target} has more than {most} classes")
    if found and not isinstance(found[0], str) and [float(v) for v in found] != [float(i) for i in range(len(found))]:
        raise ValueError(f"the classes of {target} are not 0 to {len(found) - 1}")
    return found


def target_mode(df: DataFrame, target: str) -> str:
    """``classification`` for a target of exactly two distinct known values, else ``regression``; NaN is not known."""
    distinct = _known(df, target).select(target).distinct().limit(3).count()
    return "classification" if distinct == 2 else "regression"


def binary_target(df: DataFrame, target: str) -> DataFrame:
    """``df`` with the target as 0 or 1 where it has exactly two known values: 1 stays, any other value is 0, a missing one stays missing."""
    if target_mode(df, target) == "regression":
        return df
    fractional = dict(df.dtypes)[target] in ("float", "double")
    value = F.nanvl(F.col(target), F.lit(None)) if fractional else F.col(target)
    return df.withColumn(target, F.when(value.isNotNull(), F.coalesce((value.try_cast("double") == 1).cast("int"), F.lit(0))))


# --- all steps ---

@dataclass
class CleanPlan:
    """What :func:`fit` learned; :meth:`apply` replays it."""

    numbers: list[str]
    dates: list[str]
    categories: dict[str, list[str]]
    limits: dict[str, tuple[float, float]]
    missing: str
    means: dict[str, float] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    by: list[str] = field(default_factory=list)
    clipped: list[float] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        df = _typed(df, self.numbers, self.dates, self.categories)
        if self.clipped:
            df = df.withColumns({c: clip(F.col(c), *self.clipped) for c in self.numbers})
        df = null_outside(df, self.limits)
        if self.missing == "interpolate":
            df = interpolate(df, self.numbers, self.order, self.by)
        elif self.missing == "mean":
            df = df.na.fill(self.means)
        elif self.missing == "zero":
            df = df.na.fill(0.0, subset=self.numbers)
        elif self.missing == "remove_rows":
            df = df.na.drop("any", subset=self.numbers)
        return df.drop(*self.dropped)


def _typed(df: DataFrame, numbers: list[str], dates: list[str], categories: dict[str, list[str]]) -> DataFrame:
    df = df.withColumns({**{c: to_number(F.col(c)) for c in numbers}, **{c: to_time(F.col(c).cast("string")) for c in dates}})
    for c, values in categories.items():
        df = one_hot(df, c, values)
    return df


def fit(df: DataFrame, numbers: list[str], dates: list[str] = (), categories: list[str] = (), outliers: str = "clip", missing: str = "interpolate", order: list[str] = (), by: list[str] = (), target: str | None = None, threshold: float = 4.0, bounds: tuple[float, float] = (-BOUND, BOUND), keep_constants: bool = False) -> CleanPlan:
    """Learn what cleaning needs. ``bounds`` are those of the outlier rule ``clip``; infinite values count as missing before it.

    Numbers that are constant (but for the target) are dropped unless ``keep_constants``.
    """
    if outliers not in OUTLIERS or missing not in MISSING:
        raise ValueError(f"outliers is one of {OUTLIERS}, missing one of {MISSING}")
    numbers, dates = list(numbers), list(dates)
    known = {c: levels(df, c) for c in categories}
    typed = _typed(df, numbers, dates, known)
    limits = {"boxplot": lambda: fit_boxplot(typed, numbers), "zscore": lambda: fit_zscore(typed, numbers, threshold), "clip": dict, "none": dict}[outliers]()
    clipped = list(bounds) if outliers == "clip" else []
    kept = null_outside(typed.withColumns({c: clip(F.col(c), *bounds) for c in numbers}) if clipped and numbers else typed, limits)
    plan = CleanPlan(numbers, dates, known, limits, missing, order=list(order), by=list(by), clipped=clipped)
    if missing == "mean":
        plan.means = fit_means(kept, numbers)
    if missing == "remove_cols":
        plan.dropped = [c for c in numbers if c not in drop_incomplete_columns(kept, numbers)]
    if not keep_constants:
        plan.dropped += [c for c in constants(kept, numbers, target) if c not in plan.dropped]
    return plan
