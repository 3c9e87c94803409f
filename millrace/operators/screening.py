"""A search of derived features that scores few of its candidates: bounds from histograms first, then exact scores, largest bound first.

A tree of depth 3 on one feature cuts its line into eight intervals at most. From a histogram of a candidate it is known how well any such cutting can do: rows
of bins that no cut runs through keep their bin's sums, and rows of a bin with a cut inside are taken to be predicted without error. No tree does better, so a
candidate whose bound does not exceed the best original feature is left out, and the search gives up when the next bound is below the worst of the ``most`` best found.
What is accepted is exactly what scoring every candidate would accept.

Scale: a histogram costs one narrow pass for each :data:`PASS` candidates, and a task sends ``bins`` rows or fewer a candidate, however many rows it reads. Only candidates
that are scored exactly are melted into rows. Edges of bins are approximate quantiles; bounds hold for any edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees as T
from .features import FeatureSpec, apply_specs, melt

#: Candidates whose histograms are made in one pass, candidates that are scored exactly in one job, and bins of a candidate.
PASS, BATCH, BINS = 128, 32, 512
DEPTH = 3
#: Rounding that a bound is given.
SLACK = 1e-9


@dataclass
class Searched:
    """``accepted`` (name and score, best first), the best score of an original feature, each candidate's bound, and which candidates were scored."""

    accepted: list[tuple[str, float]] = field(default_factory=list)
    base: float = -math.inf
    bounds: dict[str, float] = field(default_factory=dict)
    scored: list[str] = field(default_factory=list)


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, np.ndarray]:
    """Ascending upper edges of each column's bins: approximate quantiles. A value that is several quantiles gets a bin of its own."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, shares, 4 * bins).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        values, times = np.unique(np.array(row[f"e{i}"] or [], float), return_counts=True)
        out[c] = np.unique(np.concatenate([values, np.nextafter(values[times > 1], -np.inf)]))
    return out


def single_valued(edges: np.ndarray) -> np.ndarray:
    """Which bins hold one value only, by their edges."""
    one = np.zeros(len(edges) + 1, bool)
    if len(edges) > 1:
        one[1:-1] = edges[:-1] == np.nextafter(edges[1:], -np.inf)
    return one


def histograms(df: DataFrame, edges: dict[str, np.ndarray], y: str = "y") -> DataFrame:
    """``(feature, bin, n, s, q)``: rows, sum of y and of its square in each bin of each column of ``edges``; rows without x or y are left out."""
    columns = list(edges)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((3, len(edges[c]) + 1)) for c in columns}
        for batch in batches:
            target = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            for i, c in enumerate(columns):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                known = ~(np.isnan(x) | np.isnan(target))
                at, own = np.searchsorted(edges[c], x[known], side="left"), target[known]
                for total, weight in zip(sums[c], (None, own, own * own)):
                    total += np.bincount(at, weight, len(total))
        for c in columns:
            held = np.flatnonzero(sums[c][0])
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(held), pa.string()), pa.array(held, pa.int32()), *map(pa.array, sums[c][:, held])], ["feature", "bin", "n", "s", "q"])

    rows = df.select(*[F.col(c).cast("double") for c in columns], F.col(y).cast("double").alias(y))
    sent = rows.mapInArrow(counted, "feature string, bin int, n double, s double, q double")
    return sent.groupBy("feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def most_right(n: np.ndarray, ones: np.ndarray, single: np.ndarray, cuts: int) -> float:
    """No classifier of ``cuts + 1`` intervals labels more rows right; y is 0 or 1, bins are in order, no cut runs through ``single`` ones."""
    best = np.full((cuts + 1, 2), -np.inf)  # by cuts so far and the label of the open interval
    best[0] = 0.0
    for rows, own, one in zip(n, ones, single):
        best[1:] = np.maximum(best[1:], best[:-1].max(1, keepdims=True))
        inside = best[:-1].max(1, keepdims=True) + rows
        best += (rows - own, own)
        if not one:
            best[1:] = np.maximum(best[1:], inside)
    return float(best.max())


def least_error(n: np.ndarray, s: np.ndarray, q: np.ndarray, single: np.ndarray, cuts: int) -> float:
    """No regression by the means of ``cuts + 1`` intervals has a smaller summed squared error."""
    rows, total, square = (np.concatenate([[0.0], np.cumsum(v)]) for v in (n, s, q))
    count = rows[None, :] - rows[:, None]
    inner = square[None, :] - square[:, None] - np.divide((total[None, :] - total[:, None]) ** 2, count, out=np.zeros_like(count), where=count > 0)
    places = np.arange(len(rows))
    error = np.where(places[None, :] >= places[:, None], np.maximum(inner, 0.0), np.inf)
    best = error[0]  # of the bins before a place, if an interval ends there
    for _ in range(cuts):
        start = best.copy()
        start[1:] = np.minimum(start[1:], np.where(single, np.inf, best[:-1]))
        best = np.minimum(best, (start[:, None] + error).min(0))
    return float(best[-1])


def score_bound(n: np.ndarray, s: np.ndarray, q: np.ndarray, single: np.ndarray, regression: bool, depth: int = DEPTH) -> float:
    """The largest score that a tree of this depth can have: R2, or the share of rows labelled right. NaN for a constant y in a regression."""
    cuts, rows = 2**depth - 1, n.sum()
    if not regression:
        return most_right(n, s, single, cuts) / rows
    mean = s.sum() / rows
    s, q = s - mean * n, q - 2 * mean * s + mean * mean * n
    return 1 - least_error(n, s, q, single, cuts) / q.sum() if q.sum() > 0 else math.nan


def score_bounds(df: DataFrame, columns: list[str], y: str, regression: bool, bins: int = BINS, depth: int = DEPTH) -> dict[str, float]:
    """:func:`score_bound` of each column; columns without rows have none, nor has a constant y in a regression."""
    edges = bin_edges(df, columns, bins)

    def bound(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("bin")
        single = single_valued(edges[key[0]])[table["bin"].to_numpy()]
        return pd.DataFrame({"feature": [key[0]], "bound": [score_bound(*(table[c].to_numpy() for c in "nsq"), single, regression, depth)]})

    found = histograms(df, edges, y).groupBy("feature").applyInPandas(bound, "feature string, bound double").collect()
    return {r["feature"]: r["bound"] for r in found if r["bound"] is not None and not math.isnan(r["bound"])}


def search(df: DataFrame, originals: list[str], specs: list[FeatureSpec], target: str, classes: int | None, most: int = 50, bins: int = BINS, batch: int = BATCH) -> Searched:
    """The ``most`` best recipes that score above every original feature; ``classes`` is 2 for a target of 0 and 1, None for a number.

    Names break ties. Rows without a target do not count; a score that is null or not a number beats nothing. An empty table accepts nothing. Lags and
    differences along an order are no candidates here: put them into ``df`` as columns first.
    """
    if classes not in (None, 2):
        raise ValueError("bounds are known for two classes and for numbers")
    if any(s.op in ("lag", "diff") for s in specs):
        raise ValueError("lags and differences are no candidates of this search")
    inputs = sorted({*originals, *(c for s in specs for c in s.inputs)})
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in inputs if c in df.columns], F.col(target).cast("double").alias("_y")).where("_y is not null")
    exact: Callable[..., DataFrame] = T.regression_scores if classes is None else T.binary_scores

    def scores(made: DataFrame, names: list[str]) -> dict[str, float]:
        long = melt(made, names, ["_y"]).withColumnRenamed("_y", "y")
        found = {r["feature"]: r["score"] for r in exact(long).collect()}
        return {f: s for f, s in found.items() if s is not None and not math.isnan(s)}

    out = Searched()
    if not specs:
        return out
    out.base = max(scores(rows, originals).values(), default=-math.inf) if originals else -math.inf
    for at in range(0, len(specs), PASS):
        some = specs[at : at + PASS]
        out.bounds |= score_bounds(apply_specs(rows, some), [s.name for s in some], "_y", classes is None, bins)
    open_ = [s for s in specs if out.bounds.get(s.name, -math.inf) > out.base - SLACK]
    open_.sort(key=lambda s: (-out.bounds[s.name], s.name))
    for at in range(0, len(open_), batch):
        some = open_[at : at + batch]
        if len(out.accepted) == most and out.bounds[some[0].name] < out.accepted[-1][1] - SLACK:
            break
        found = scores(apply_specs(rows, some), [s.name for s in some])
        out.scored += [s.name for s in some]
        better = [(f, s) for f, s in found.items() if s > out.base]
        out.accepted = sorted([*out.accepted, *better], key=lambda r: (-r[1], r[0]))[:most]
    return out
