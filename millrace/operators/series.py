"""Scaling, sequence windows, folds, and the statistics behind exploratory plots of series.

Order-dependent operators take a total ``order`` and entities ``by``; each entity is one window partition. Without entities, or where ``spread`` says that
one may hold most rows, a series is cut into stretches with halos (``functions/ordered.py``), so no task sees the whole of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ordered import along, ranked, running, stretches
from ..functions.storage import checkpointed


# --- scaling ---

def fit_standard(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation (0 counts as 1)."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardise(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scales.items()})


def restore(c: Column, scale: tuple[float, float]) -> Column:
    return c * scale[1] + scale[0]


# --- sequences ---

def sequences(df: DataFrame, inputs: list[str], target: str, back: int | list[int], forward: int | list[int], shift: int, order: list[str], by: list[str] = (), diff: str = "none", spread: bool | None = None) -> DataFrame:
    """Input rows t-back..t and target rows t+shift+1..t+shift+forward, as arrays; incomplete rows are left out.

    Lists name the rows themselves: ``back`` [0, 2, 5] takes rows t-5, t-2 and t, ``forward`` [1, 7] rows t+shift+1 and t+shift+7.
    ``diff`` takes values, differences (``diff``) or differences of logarithms (``logdiff``). A row is incomplete where a value is missing; the
    logarithm of 0 is minus infinity and that of a negative value NaN, so these are values and their rows stay.
    """
    behind = sorted(range(back + 1) if isinstance(back, int) else back, reverse=True)
    ahead = list(range(1, forward + 1)) if isinstance(forward, int) else list(forward)
    if min([*behind, shift], default=0) < 0:
        raise ValueError("rows behind and the shift are counted from 0")
    value = (lambda c: _ln(F.col(c).cast("double"))) if diff == "logdiff" else F.col

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        step = (lambda c, i: _at(value(c), i, w)) if diff == "none" else (lambda c, i: _at(value(c), i, w) - _at(value(c), i - 1, w))
        x = F.array(*[F.array(*[step(c, -i) for c in inputs]) for i in behind])
        y = F.array(*[step(target, shift + i) for i in ahead])
        return rows.select("*", x.alias("_x"), y.alias("_y"))

    reach = [-b - (diff != "none") for b in behind] + [shift + f for f in ahead] + [shift + f - 1 for f in ahead if diff != "none"]
    made = along(df, list(order), list(by), max(0, -min(reach)), max(0, *reach), build, spread)
    made = made.select(*by, *[o for o in order if o not in by], F.col("_x").alias("x"), F.col("_y").alias("y"))
    whole = F.forall("x", lambda r: F.forall(r, lambda v: v.isNotNull())) & F.forall("y", lambda v: v.isNotNull())
    return made.where(whole)


def _ln(c: Column) -> Column:
    """The logarithm as SQL has it; that of Spark is null for all but positive values."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def _at(c: Column, i: int, w: Window) -> Column:
    return c if i == 0 else F.lead(c, i).over(w) if i > 0 else F.lag(c, -i).over(w)


def revert(df: DataFrame, change: str, level: str, order: list[str], by: list[str] = (), log: bool = False, spread: bool | None = None) -> DataFrame:
    """Levels from predicted changes, a step from the true level: that of the row before, plus the change (times its exponential for ``log``)."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        before = F.lag(level).over(w)
        return rows.withColumn("reverted", before * F.exp(change) if log else before + F.col(change))

    return along(df, list(order), list(by), 1, 0, build, spread)


def integrate(df: DataFrame, change: str, level: str, order: list[str], by: list[str] = (), times: int = 1, log: bool = False) -> DataFrame:
    """``reverted``: levels from ``times``-th differences over any number of steps, started anew at every known ``level``.

    Running sums are carried over ranges of rows, one pass for each order, so a series of any length is spread over tasks. ``level`` is null where it is not known:
    rows after a known level add up the changes since; a difference of order j starts anew where j + 1 levels in a row are known, so ``times`` known
    levels in a row start everything. Rows before that have null; a missing change counts as 0. ``log`` takes differences of logarithms, and levels that are not positive as unknown.
    """
    if times < 1:
        raise ValueError("integrate at least once")
    known = F.when(F.col(level) > 0, F.ln(level)) if log else F.col(level).cast("double")

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        found = rows.withColumn("_known", known)
        return found.withColumns({f"_d{j}": _difference(F.col("_known"), j, w) for j in range(times)}).drop("_known")

    rows, value = along(df, list(order), list(by), times, 0, build, True), F.col(change).cast("double")
    for j in range(times - 1, -1, -1):
        rows = rows.withColumn("_change", F.coalesce(value, F.lit(0.0)))
        summed = running(rows, list(by), list(order), {"_place": ("sum", F.lit(1)), "_sum": ("sum", F.col("_change"))})
        start = F.when(F.col(f"_d{j}").isNotNull(), F.struct("_place", F.col(f"_d{j}").alias("known"), "_sum"))
        rows = running(summed, list(by), list(order), {"_start": ("max", start)})
        rows = rows.withColumn("_value", F.col("_start.known") + (F.col("_sum") - F.col("_start._sum"))).drop("_start", "_sum", "_place", "_change", f"_d{j}")
        value = F.col("_value")
    return rows.withColumn("reverted", F.exp("_value") if log else F.col("_value")).drop("_value")


def _difference(c: Column, k: int, w: WindowSpec) -> Column:
    """The k-th difference along ``w``, null unless all its rows are known."""
    total, coefficient = None, 1
    for i in range(k + 1):
        term = F.lit(float(coefficient)) * (F.lag(c, i).over(w) if i else c)
        total = term if total is None else total + term
        coefficient = -coefficient * (k - i) // (i + 1)
    return total


def lagged(df: DataFrame, columns: list[str], back: list[int], order: list[str], by: list[str] = (), diff: bool = False, spread: bool | None = None) -> DataFrame:
    """Columns ``name_b``: the value b rows before; with ``diff`` ``name_d_b``: that value less the present one. Rows without all of them are left out."""
    names = [f"{c}_d_{b}" if diff else f"{c}_{b}" for c in columns for b in back]

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns({n: _at(F.col(c), -b, w) - F.col(c) if diff else _at(F.col(c), -b, w) for n, (c, b) in zip(names, [(c, b) for c in columns for b in back])})

    return along(df, list(order), list(by), max(0, *back), max(0, *[-b for b in back]), build, spread).na.drop("any", subset=names)


def output_windows(df: DataFrame, column: str, size: int, order: list[str], by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """``window``: the values of this row and the ``size`` - 1 after it; the last rows, which have fewer, are left out."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        made = rows.withColumn("window", F.array(*[_at(F.col(column), i, w) for i in range(size)]))
        return made.withColumn("_last", F.lead(F.lit(1), size - 1).over(w) if size > 1 else F.lit(1))

    return along(df, list(order), list(by), 0, size - 1, build, spread).where("_last is not null").drop("_last")


def plot_rows(df: DataFrame, key: str, target: str, most: int = 10_000) -> DataFrame:
    """At most ``most`` evenly spaced rows by ``key``, with ``colour``: the target scaled to 0..1 over all rows (0 for a constant)."""
    limits = df.agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("low"), F.max(target).alias("high")).first()
    placed = ranked(df, [], [key], "_at")
    step = max(limits["n"] / most, 1.0)
    chosen = F.floor((F.col("_at") - 1) / step) != F.floor((F.col("_at") - 2) / step)
    spread = (limits["high"] - limits["low"]) if limits["low"] is not None else 0
    colour = (F.col(target) - F.lit(limits["low"])) / F.lit(spread) if spread else F.lit(0.0)
    return placed.where(chosen).withColumn("colour", colour).drop("_at")


# --- folds ---

def k_folds(df: DataFrame, k: int, order: list[str], by: list[str] = ()) -> DataFrame:
    """``fold`` 0..k-1: contiguous blocks of the rows of each ``by`` (a class, for stratified folds), the first ones a row longer.

    Places come from ranges of rows, so a class or table of any size is spread over many tasks; where equal sizes on average
    will do, :func:`hash_folds` needs no shuffle.
    """
    placed = ranked(df, list(by), list(order), "_place")
    sizes = placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = placed.join(sizes if by else F.broadcast(sizes), same)
    place, short, longer = F.col("_place") - 1, F.floor(F.col("_n") / k), F.col("_n") % k
    in_long = longer * (short + 1)
    fold = F.when(place < in_long, F.floor(place / (short + 1))).otherwise(longer + F.floor((place - in_long) / F.greatest(short, F.lit(1))))
    return joined.select(*df.columns, fold.cast("int").alias("fold"))


def hash_folds(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1 by a hash of the key: no shuffle, sizes equal on average."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))


# --- statistics of series ---

def autocorrelation(df: DataFrame, column: str, lags: list[int], order: list[str], by: list[str]) -> DataFrame:
    """``(*by, lag, acf)``: centred products over the centred sum of squares, one window pass for all lags."""
    mean = F.avg(column).over(Window.partitionBy(*by)) if by else F.lit(df.agg(F.avg(column).alias("m")).first()["m"])
    centred = df.select(*by, *[o for o in order if o not in by], (F.col(column) - mean).alias("_c"))
    products = along(centred, list(order), list(by), max(0, *lags), 0, lambda rows, w: rows.select("*", *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_l{k}") for k in lags]))
    sums = products.groupBy(*by).agg(F.sum(F.col("_c") * F.col("_c")).alias("_s"), *[F.sum(f"_l{k}").alias(f"_l{k}") for k in lags])
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(f"_l{k}", F.lit(0.0)), F.col("_s")).alias("acf")) for k in lags])
    return sums.select(*by, F.explode(entries).alias("e")).select(*by, "e.lag", "e.acf")


def partial_autocorrelation(acf: list[float]) -> list[float]:
    """Levinson-Durbin on autocorrelations of lags 1, 2, ...: a few dozen numbers of one series."""
    out, phi = [], []
    for k in range(1, len(acf) + 1):
        top = acf[k - 1] - sum(p * acf[k - 2 - j] for j, p in enumerate(phi))
        bottom = 1 - sum(p * acf[j] for j, p in enumerate(phi))
        last = top / bottom if bottom else 0.0
        phi = [p - last * q for p, q in zip(phi, reversed(phi))] + [last]
        out.append(last)
    return out


def cross_correlation(df: DataFrame, x: str, y: str, lags: list[int], order: list[str], by: list[str]) -> DataFrame:
    """``(*by, lag, r)``: sum of x(t) y(t+lag) over the root of both sums of squares; means are not removed."""
    pairs = along(df, list(order), list(by), max(0, *[-k for k in lags]), max(0, *lags), lambda rows, w: rows.select("*", *[(F.col(x) * _at(F.col(y), k, w)).alias(f"_l{i}") for i, k in enumerate(lags)]))
    sums = pairs.groupBy(*by).agg(F.sqrt(F.sum(F.col(x) * F.col(x)) * F.sum(F.col(y) * F.col(y))).alias("_s"), *[F.sum(f"_l{i}").alias(f"_l{i}") for i in range(len(lags))])
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(f"_l{i}", F.lit(0.0)), F.col("_s")).alias("r")) for i, k in enumerate(lags)])
    return sums.select(*by, F.explode(entries).alias("e")).select(*by, "e.lag", "e.r")


def difference_variance(df: DataFrame, column: str, most: int, order: list[str], by: list[str]) -> DataFrame:
    """``(*by, differences, variance)`` of unit-variance data after 0..most differences."""
    spread = F.stddev_samp(column).over(Window.partitionBy(*by)) if by else F.lit(df.agg(F.stddev_samp(column).alias("s")).first()["s"]).cast("double")
    scaled = df.withColumn("_0", F.try_divide(F.col(column), F.nullif(spread, F.lit(0.0))))

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        for k in range(1, most + 1):
            rows = rows.withColumn(f"_{k}", F.col(f"_{k - 1}") - F.lag(f"_{k - 1}").over(w))
        return rows

    scaled = along(scaled, list(order), list(by), most, 0, build)
    sums = scaled.groupBy(*by).agg(*[F.var_samp(f"_{k}").alias(f"_{k}") for k in range(most + 1)])
    entries = F.array(*[F.struct(F.lit(k).alias("differences"), F.col(f"_{k}").alias("variance")) for k in range(most + 1)])
    return sums.select(*by, F.explode(entries).alias("e")).select(*by, "e.differences", "e.variance")


def seasonal(df: DataFrame, column: str, period: int, order: list[str], by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Classical additive decomposition: centred moving average, mean of what is left by phase, remainder.

    One long series (no ``by``, or ``spread``) runs over stretches with halos of half a period, and its phases are aggregates, so no task sees the whole of it.
    """
    half = period // 2

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        trend = F.avg(column).over(w.rowsBetween(-half, half)) if period % 2 else (F.avg(column).over(w.rowsBetween(-half, half - 1)) + F.avg(column).over(w.rowsBetween(-half + 1, half))) / 2
        inside = F.lag(F.lit(1), half).over(w).isNotNull() & F.lead(F.lit(1), half).over(w).isNotNull() if half else F.lit(True)
        place = F.col("_place") if "_place" in rows.columns else F.row_number().over(w)
        return rows.withColumn("trend", F.when(inside, trend)).withColumn("phase", ((place - 1) % period).cast("int"))

    out = along(df, list(order), list(by), half, half, build, spread)
    if by and not spread:
        out = out.withColumn("season", F.avg(F.col(column) - F.col("trend")).over(Window.partitionBy(*by, "phase")))
    else:
        out = checkpointed(out)
        means = out.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("phase").alias("_phase")).agg(F.avg(F.col(column) - F.col("trend")).alias("season"))
        same = F.col("phase") == F.col("_phase")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        # without entities the means are one row a phase
        out = out.join(means if by else F.broadcast(means), same).drop("_phase", *[f"_g_{c}" for c in by])
    return out.withColumn("remainder", F.col(column) - F.col("trend") - F.col("season"))


def box_stats(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers (the extreme values within 1.5 interquartile ranges) and the number of outliers, by group."""
    quartiles = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.percentile(column, [0.25, 0.5, 0.75]).alias("q"))
    joined = df.join(quartiles, by)
    low, high = F.col("q")[0] * 2.5 - F.col("q")[2] * 1.5, F.col("q")[2] * 2.5 - F.col("q")[0] * 1.5
    inside = F.col(column).between(low, high)
    stats = joined.groupBy(*by, "q").agg(F.min(F.when(inside, F.col(column))).alias("whisker_low"), F.max(F.when(inside, F.col(column))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    return stats.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "whisker_low", "whisker_high", "outliers")


def partial_autocorrelations(df: DataFrame, column: str, most: int, order: list[str], by: list[str]) -> DataFrame:
    """``(*by, lag, pacf)`` of lags 1..most: autocorrelations, then the recursion on these few numbers of each series."""
    acf = autocorrelation(df, column, list(range(1, most + 1)), order, by)
    lists = acf.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda p: p["acf"]).alias("a"))
    solve = F.pandas_udf(lambda rows: rows.map(lambda a: partial_autocorrelation([0.0 if v is None or v != v else float(v) for v in a])), "array<double>")
    return lists.select(*by, F.posexplode(solve("a")).alias("i", "pacf")).select(*by, (F.col("i") + 1).alias("lag"), "pacf")


# --- seasonal decomposition by local regression ---

def loess(y: np.ndarray, span: int, at: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Local lines over equally spaced values, tricube weights over the ``span`` nearest; ``at`` are places, also outside the series."""
    n, at = len(y), np.arange(len(y), dtype=float) if at is None else at
    weights = np.ones(n) if weights is None else weights
    q, out = min(span, n), np.empty(len(at))
    # all places at once, in blocks of bounded size
    block = max((1 << 20) // q, 1)
    for start in range(0, len(at), block):
        t = at[start : start + block, None]
        near = np.clip(np.ceil(t - q / 2), 0, n - q).astype(int) + np.arange(q)
        d, values = np.abs(near - t), y[near]
        h = np.maximum(d.max(1, keepdims=True), 1.0) * (1 if span <= n else span / n)
        w = np.where(d < h * 0.999, (1 - (d / h) ** 3) ** 3, 0.0) * weights[near]
        total = w.sum(1)
        known = np.where(total > 0, total, 1.0)
        mx, my = (w * near).sum(1) / known, (w * values).sum(1) / known
        gap = near - mx[:, None]
        spread, slope = (w * gap**2).sum(1), (w * gap * (values - my[:, None])).sum(1)
        tilt = np.where(spread > 1e-9 * total, (t[:, 0] - mx) * slope / np.where(spread > 0, spread, 1.0), 0.0)
        out[start : start + block] = np.where(total > 0, my + tilt, values.mean(1))
    return out


def stl_parts(y: np.ndarray, period: int, season_span: int = 7, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season of one series of at least two periods: phases smoothed by themselves, their low frequencies moved to the trend."""
    n, trend, season = len(y), np.zeros(len(y)), np.zeros(len(y))
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / season_span))) | 1
    average = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
    for _ in range(rounds):
        cycle = np.empty(n + 2 * period)
        for phase in range(period):
            own = (y - trend)[phase::period]
            cycle[phase::period][: len(own) + 2] = loess(own, season_span, np.arange(-1.0, len(own) + 1))
        low = loess(average(average(average(cycle, period), period), 3), period | 1)
        season = cycle[period : n + period] - low[:n]
        trend = loess(y - season, trend_span)
    return trend, season


def stl_reach(period: int, season_span: int = 7, rounds: int = 2) -> int:
    """How many rows away a value can still change a row's parts in :func:`stl_parts`, in whole periods: what each of its filters reaches, added up."""
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / season_span))) | 1
    once = (season_span // 2 + 1) * period + (period + 2) + ((period | 1) // 2 + 1) + (trend_span // 2 + 1)
    return -(-rounds * once // period) * period


#: places of a stretch of :func:`stl`
STL_CHUNK = 1 << 14


def stl(df: DataFrame, column: str, period: int, order: str, by: str | None = None, spread: bool | None = None, chunk: int = STL_CHUNK) -> DataFrame:
    """``(by, order, value, trend, season, remainder)``; the series of one entity is smoothed in one task, entities in parallel.

    One long series (no ``by``, or ``spread`` for entities that may hold most rows) is cut into stretches of some ``chunk`` rows. All of the method's filters are local,
    so a stretch with a halo as long as they reach together gives the parts of the whole series; ``order`` must then be total within an entity.
    Nulls are left out and the rest is taken as equally spaced; a series shorter than two periods has its mean as trend and no season.
    """
    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order", kind="stable")
        y = rows["value"].to_numpy(float)
        trend, season = stl_parts(y, period) if len(y) >= 2 * period else (np.full(len(y), y.mean()), np.zeros(len(y)))
        return rows.assign(trend=trend, season=season, remainder=y - trend - season)

    def split_own(rows: pd.DataFrame) -> pd.DataFrame:
        made = split(rows)
        return made[made["_own"] == made["_slot"]].drop(columns=["_own", "_slot", "_place"])

    kinds = dict(df.dtypes)
    entity = [F.col(by).alias("by")] if by else []
    dealt = df.where(F.col(column).isNotNull()).select(*entity, F.col(order).alias("order"), F.col(column).cast("double").alias("value"))
    schema = (f"by {kinds[by]}, " if by else "") + f"`order` {kinds[order]}, value double, trend double, season double, remainder double"
    if by and not spread:
        made = dealt.groupBy("by").applyInPandas(split, schema)
    else:
        halo = stl_reach(period)
        # stretches and halos of whole periods: phases fall alike in all of them
        size = max(-(-chunk // period) * period, 2 * halo)
        keys = ["by"] if by else []
        made = stretches(dealt, ["order"], keys, halo, halo, size).groupBy(*keys, "_slot").applyInPandas(split_own, schema)
    return made.withColumnsRenamed({"by": by, "order": order} if by else {"order": order})


def scatter_rows(df: DataFrame, key: str, features: list[str], target: str, most: int = 10_000) -> DataFrame:
    """``(key, feature, x, target)``: the points of each feature's plot against the target, of at most ``most`` evenly spaced rows."""
    rows = plot_rows(df.select(key, *features, target), key, target, most)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")
    return rows.select(key, pairs, F.col(target).alias("target")).select(key, "f.feature", "f.x", "target")
