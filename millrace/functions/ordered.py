"""Running aggregates and ranks along a global order, without one task that sees the whole of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .storage import checkpointed

#: places of a stretch of one long series
CHUNK = 1 << 16

#: how the running value of a range of rows is joined with that of all ranges before it
_MERGE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda before, own: F.coalesce(before, F.lit(0)) + own,
    "max": lambda before, own: F.greatest(before, own),
    "min": lambda before, own: F.least(before, own),
}


def ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in ranges of ``keys``, numbered in their order by ``_range``; rows with equal keys share a range."""
    return checkpointed(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, groups: list[str], order: list[str], values: dict[str, tuple[str, Column]], reverse: bool = False) -> DataFrame:
    """``df`` with, for each name of ``values``, its aggregate (``sum``, ``max``, ``min``) over the rows of the group up to and with this one.

    ``reverse`` runs from the end instead, over windows in falling order: a frame that reaches to the end of its partition is computed anew for every
    row, which grows with the square of a range. ``order`` must be total within a group. Rows are cut into ranges of (groups, order);
    windows run within a range, and one row for each group of a range carries the values of earlier ranges. So a group of any size
    is spread over many tasks, and the second window sees at most as many rows of a group as there are ranges.
    """
    placed = ranges(df, [*groups, *order])
    way = (lambda c: F.col(c).desc()) if reverse else F.col
    local = Window.partitionBy("_range", *groups).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*groups).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    aggregate = {n: (getattr(F, kind), c) for n, (kind, c) in values.items()}
    whole = placed.groupBy("_range", *groups).agg(*[f(c).alias(f"_w_{n}") for n, (f, c) in aggregate.items()])
    earlier = whole.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in groups], *[getattr(F, values[n][0])(f"_w_{n}").over(across).alias(f"_b_{n}") for n in values])
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    own = placed.select("*", *[f(c).over(local).alias(f"_o_{n}") for n, (f, c) in aggregate.items()])
    merged = own.join(earlier, same, "left")
    return merged.select(*[c for c in df.columns if c not in values], *[_MERGE[values[n][0]](F.col(f"_b_{n}"), F.col(f"_o_{n}")).alias(n) for n in values])


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the row's place, from 1, in its group."""
    return running(df, groups, order, {name: ("sum", F.lit(1).cast("long"))})


def stretches(df: DataFrame, order: list[str], by: list[str], before: int, after: int, size: int) -> DataFrame:
    """Rows of each series in stretches of ``size`` places, numbered from 0 by ``_slot``; a stretch also has the last ``before`` rows of the one before it and the first ``after`` of the next.

    ``_own`` is the stretch that a row belongs to, ``_place`` its place from 1. ``size`` is at least ``before`` and ``after``, so at most three copies of a row are made.
    """
    placed = ranked(df, list(by), list(order), "_place")
    within, slot = (F.col("_place") - 1) % size, F.floor((F.col("_place") - 1) / size)
    slots = F.array_compact(F.array(slot, F.when((within < after) & (slot > 0), slot - 1), F.when(within >= size - before, slot + 1)))
    return placed.withColumn("_own", slot).withColumn("_slot", F.explode(slots))


def along(df: DataFrame, order: list[str], by: list[str], before: int, after: int, build: Callable[[DataFrame, WindowSpec], DataFrame], spread: bool | None = None, chunk: int = CHUNK) -> DataFrame:
    """``build(frame, window)`` over rows in ``order``, for windows that reach ``before`` rows back and ``after`` rows ahead; ``build`` adds columns and keeps rows.

    One long series (no ``by``, or ``spread`` for entities that may hold most rows) is cut into stretches of ``chunk`` places, each with a
    halo: the last ``before`` rows of the stretch before it and the first ``after`` of the next. A row's window lies in its own stretch and halo, so
    any length is spread over tasks and at most three copies of a row are made. Else each entity is one window partition.
    """
    if by and not spread:
        return build(df, Window.partitionBy(*by).orderBy(*order))
    haloed = stretches(df, order, by, before, after, max(chunk, before, after, 1))
    made = build(haloed, Window.partitionBy(*by, "_slot").orderBy("_place"))
    return made.where(F.col("_own") == F.col("_slot")).drop("_own", "_slot", "_place")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of each column (linear between neighbours); None for a column without values.

    Values of each column are counted by distinct value, ranked through :func:`running` by ranges, and only the two order statistics around each
    quantile are read: no buffer holds a column's values.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    counts = df.select(pairs).select("x.c", "x.v").where("v is not null and not isnan(v)").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = checkpointed(running(counts.withColumn("own", F.col("n")), ["c"], ["v"], {"upto": ("sum", F.col("n"))}))
    sizes = {r["c"]: r["n"] for r in placed.groupBy("c").agg(F.max("upto").alias("n")).collect()}
    wanted = [(i, r) for i, n in sizes.items() for q in shares for r in {int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1)}]
    if not wanted:
        return dict.fromkeys(columns)
    hit = F.lit(False)
    for i, r in wanted:
        hit = hit | ((F.col("c") == i) & (F.col("upto") > r) & (F.col("upto") - F.col("own") <= r))
    rows = [(r["c"], r["upto"] - r["own"], r["upto"], r["v"]) for r in placed.where(hit).collect()]
    at = lambda i, r: next(v for c, low, high, v in rows if c == i and low <= r < high)
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(columns):
        if i not in sizes:
            out[c] = None
            continue
        n, found = sizes[i], []
        for q in shares:
            low = int(q * (n - 1))
            a, b = at(i, low), at(i, min(low + 1, n - 1))
            found.append(a + (b - a) * (q * (n - 1) - low))
        out[c] = found
    return out
