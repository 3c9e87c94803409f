"""Diagonal Gaussian mixtures by aggregates, and the one-class learner over their means."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import checkpointed
from .online import fold_ordered, kernel

Mixture = list[tuple[float, list[float], list[float]]]  # (weight, mean, variance) of each component


def responsibilities(x: Column, mixture: Mixture) -> Column:
    """Array of the components' shares of ``x``; components are constants of the plan."""
    logs = []
    for weight, mean, variance in mixture:
        terms = F.zip_with(x, F.arrays_zip(F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, variance)).alias("v")), lambda a, p: (a - p["m"]) * (a - p["m"]) / p["v"])
        constant = math.log(max(weight, 1e-300)) - 0.5 * sum(math.log(2 * math.pi * v) for v in variance)
        logs.append(F.lit(constant) - 0.5 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))
    parts = F.transform(F.array(*logs), lambda p: F.exp(p - (F.greatest(*logs) if len(logs) > 1 else logs[0])))
    return F.transform(parts, lambda p: p / F.aggregate(parts, F.lit(0.0), lambda s, t: s + t))


def log_densities(x: np.ndarray, mixture: Mixture) -> np.ndarray:
    """Logarithms of weight times density, a column for each component."""
    weights, means, variances = (np.array([c[i] for c in mixture], float) for i in range(3))
    # squares by a matrix product, around the mean of the means so that they do not cancel
    centre = means.mean(0)
    y, m = x - centre, means - centre
    squares = (y * y) @ (1 / variances).T - 2 * y @ (m / variances).T + (m * m / variances).sum(1)
    return np.log(np.maximum(weights, 1e-300)) - 0.5 * (np.log(2 * np.pi * variances).sum(1) + squares)


def shares(x: np.ndarray, mixture: Mixture) -> np.ndarray:
    logs = log_densities(x, mixture)
    parts = np.exp(logs - logs.max(1, keepdims=True))
    return parts / parts.sum(1, keepdims=True)


def em_sums(df: DataFrame, x: str, mixture: Mixture) -> tuple[np.ndarray, float, float]:
    """Of each component the mass, the sums and the sums of squares of deviations from its mean; the rows' log-likelihood; the number of rows.

    A pass of matrix products: each task gives one row for each component and number, added up in the shuffle. Rows with null x or another length are left out.
    """
    k, m = len(mixture), len(mixture[0][1])
    means = np.array([c[1] for c in mixture], float)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, likelihood, n = np.zeros((k, 2 * m + 1)), 0.0, 0
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            logs = log_densities(v, mixture)
            top = logs.max(1, keepdims=True)
            parts = np.exp(logs - top)
            whole = parts.sum(1, keepdims=True)
            r = parts / whole
            likelihood, n = likelihood + float((top + np.log(whole)).sum()), n + len(v)
            for c in range(k):
                d = v - means[c]
                total[c] += np.concatenate([[r[:, c].sum()], r[:, c] @ d, r[:, c] @ (d * d)])
        values = np.append(total.ravel(), [likelihood, n])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "a"])

    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x")).where(f"size(x) = {m} and not exists(x, v -> v is null)")
    found = np.zeros(k * (2 * m + 1) + 2)
    for r in rows.mapInArrow(partial, "i long, a double").groupBy("i").agg(F.sum("a").alias("a")).collect():
        found[r["i"]] = r["a"]
    return found[:-2].reshape(k, -1), float(found[-2]), float(found[-1])


def maximised(mixture: Mixture, sums: np.ndarray, floor: float = 1e-6) -> Mixture:
    """The mixture that the sums of :func:`em_sums` make; a component without mass stays, with weight 0."""
    m, total, out = len(mixture[0][1]), max(float(sums[:, 0].sum()), 1e-300), []
    for (_, mean, variance), own in zip(mixture, sums):
        n = float(own[0])
        if n < 1e-12:
            out.append((0.0, mean, variance))
            continue
        step = own[1 : m + 1] / n
        out.append((n / total, (np.array(mean) + step).tolist(), (np.maximum(own[m + 1 :] / n - step**2, 0.0) + floor).tolist()))
    return out


def em_round(df: DataFrame, x: str, mixture: Mixture, floor: float = 1e-6) -> Mixture:
    """One round of expectation and maximisation. Rows with null x are left out; a component without mass stays; ``floor`` is added to variances."""
    sums, _, n = em_sums(df, x, mixture)
    return maximised(mixture, sums, floor) if n else mixture


def fit_mixture(df: DataFrame, x: str, components: int, rounds: int = 100, tolerance: float = 1e-4, floor: float = 1e-6, seed: int = 42, start: Mixture | None = None) -> tuple[Mixture, float]:
    """A mixture fitted to all rows, and its mean log-likelihood: rounds until a row gains less than ``tolerance`` on average.

    It starts from ``start``, or from rows that lie far apart among a documented sample (the 64 rows a component with the smallest hashes), with the table's variance. Without rows: no components.
    """
    known = df.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x")).where("size(x) > 0 and not exists(x, v -> v is null)")
    if start is None:
        some = [np.array(r["x"]) for r in known.distinct().orderBy(F.xxhash64(F.lit(seed), "x")).limit(64 * components).collect()]
        some = np.array([v for v in some if len(v) == len(some[0])])
        if not len(some):
            return [], float("nan")
        chosen = farthest(some, components)
        spread = (some.var(0) + floor).tolist()
        start = [(1 / len(chosen), c.tolist(), spread) for c in chosen]
    mixture, before = start, -np.inf
    rows = checkpointed(known)
    for _ in range(rounds):
        sums, likelihood, n = em_sums(rows, "x", mixture)
        if not n or likelihood / n - before < tolerance:
            break
        mixture, before = maximised(mixture, sums, floor), likelihood / n
    return mixture, float(before)


def farthest(x: np.ndarray, k: int, held: np.ndarray | None = None) -> np.ndarray:
    """Up to ``k`` rows of ``x``, each the farthest from all ``held`` and chosen so far (the first is the first row if nothing is held)."""
    chosen, near = [], np.full(len(x), np.inf)
    for c in [] if held is None else held:
        near = np.minimum(near, ((x - c) ** 2).sum(1))
    while len(chosen) < min(k, len(x)):
        i = 0 if np.isinf(near).all() else int(near.argmax())
        if near[i] <= 0:
            break
        chosen.append(x[i])
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
    return np.array(chosen).reshape(-1, x.shape[1])


# --- the one-class learner whose mixture grows ---

@dataclass
class Growth:
    """Parameters: ``memory`` rows that no mean is near are kept before a refit, which adds up to ``more`` components and lets the memory grow by ``widen``.

    A row is kept if its largest kernel with a mean is below ``near``.
    """

    sigma: float = 1.0
    eta: float = 0.1
    near: float = 0.2
    memory: int = 100
    more: int = 5
    widen: int = 20
    rounds: int = 50
    floor: float = 1e-6


GROWN = "means array<double>, variances array<double>, weights array<double>, alpha array<double>, kept array<double>, memory long, refits long"


class OneClass:
    """Means of a mixture with multipliers; memory of rows far from all means, bounded; refits in place when it is full."""

    def __init__(self, mixture: Mixture, growth: Growth, alpha: np.ndarray | None = None) -> None:
        self.growth, self.mixture = growth, mixture
        self.means = np.array([c[1] for c in mixture], float)
        self.alpha = np.zeros(len(mixture)) if alpha is None else np.asarray(alpha, float)
        self.kept: list[np.ndarray] = []
        self.memory, self.refits = growth.memory, 0

    def score(self, x: np.ndarray) -> float:
        return float(self.alpha @ kernel(self.means, x, self.growth.sigma)) - 1

    def learn(self, x: np.ndarray) -> None:
        k = kernel(self.means, x, self.growth.sigma)
        if self.alpha @ k > 1:
            return
        self.alpha = self.alpha + self.growth.eta * k
        if k.max() < self.growth.near:
            self.kept.append(np.asarray(x, float))
            if len(self.kept) >= self.memory:
                self.refit()

    def refit(self) -> None:
        """New components start at kept rows far from all means and each other; old ones stay in, so that nothing learned is lost."""
        rows = np.array(self.kept)
        seeds = farthest(rows, self.growth.more, self.means)
        spread = (rows.var(0) + self.growth.floor).tolist()
        weight = 1 / (len(self.mixture) + len(seeds))
        grown = [(weight, s.tolist(), spread) for s in seeds]
        before = -np.inf
        for _ in range(self.growth.rounds):
            logs = log_densities(rows, grown)
            likelihood = float(np.logaddexp.reduce(logs, axis=1).mean())
            if likelihood - before < 1e-6:
                break
            before, r = likelihood, shares(rows, grown)
            sums = np.array([np.concatenate([[r[:, c].sum()], r[:, c] @ (rows - g[1]), r[:, c] @ (rows - g[1]) ** 2]) for c, g in enumerate(grown)])
            grown = maximised(grown, sums, self.growth.floor)
        rest = sum(w for w, _, _ in grown)
        share = len(seeds) * weight
        self.mixture = [(w * (1 - share), m, v) for w, m, v in self.mixture] + [(w / max(rest, 1e-300) * share, m, v) for w, m, v in grown]
        self.means = np.array([c[1] for c in self.mixture], float)
        self.alpha = np.append(self.alpha, np.zeros(len(grown)))
        self.kept, self.memory, self.refits = [], self.memory + self.growth.widen, self.refits + 1

    def row(self) -> dict:
        flat = lambda i: [float(v) for c in self.mixture for v in c[i]]
        kept = np.array(self.kept).ravel().tolist()
        return {"means": flat(1), "variances": flat(2), "weights": [float(c[0]) for c in self.mixture], "alpha": self.alpha.tolist(), "kept": kept, "memory": self.memory, "refits": self.refits}

    @classmethod
    def load(cls, row: dict, growth: Growth) -> "OneClass":
        n = len(row["weights"])
        means, variances = np.array(row["means"], float).reshape(n, -1), np.array(row["variances"], float).reshape(n, -1)
        made = cls([(float(w), m.tolist(), v.tolist()) for w, m, v in zip(row["weights"], means, variances)], growth, np.array(row["alpha"], float))
        made.kept = list(np.array(row["kept"], float).reshape(-1, means.shape[1]))
        made.memory, made.refits = int(row["memory"]), int(row["refits"])
        return made


def one_class_grow(df: DataFrame, key: str, order: str, x: str, mixture: Mixture, growth: Growth = Growth()) -> DataFrame:
    """``(key, means, variances, weights, alpha, kept, memory, refits)``: each key's learner after its rows in order, from a mixture fitted to data.

    A key's rows stream through one task; its state is the components and at most ``memory`` kept rows.
    """
    kind = dict(df.dtypes)[key]
    return fold_ordered(df.where(F.col(x).isNotNull()), key, order, {"x": F.col(x).cast("array<double>")}, lambda row: OneClass(mixture, growth), lambda s, row: s.learn(np.asarray(row.x, float)), lambda k, s: {"key": k, **s.row()}, f"key {kind}, {GROWN}")


def one_class_fit(df: DataFrame, key: str, order: str, x: str, mixture: Mixture, sigma: float, eta: float = 0.1, threshold: float = 0.5, start: float = 0.0) -> DataFrame:
    """``(key, alpha, outliers)``: multipliers of the mixture's means after each key's rows in order, and how many rows belonged to no component.

    A row with alpha.k > 1 changes nothing; otherwise alpha grows by eta k, and the row is an outlier if no component's responsibility
    reaches ``threshold``. :func:`outliers` gives the rows, from which a larger mixture can be fitted.
    """
    means = np.array([c[1] for c in mixture], float)

    def step(s: dict, row) -> None:
        k = kernel(means, np.asarray(row.x, float), sigma)
        if s["alpha"] @ k > 1:
            return
        s["alpha"] = s["alpha"] + eta * k
        s["outliers"] += int(row.r < threshold)

    kind = dict(df.dtypes)[key]
    v = F.col(x).cast("array<double>")
    columns = {"x": v, "r": F.array_max(responsibilities(v, mixture))}
    begin = lambda row: {"alpha": np.full(len(means), start), "outliers": 0}
    return fold_ordered(df.where(F.col(x).isNotNull()), key, order, columns, begin, step, lambda k, s: {"key": k, "alpha": s["alpha"].tolist(), "outliers": s["outliers"]}, f"key {kind}, alpha array<double>, outliers long")


def outliers(df: DataFrame, x: str, mixture: Mixture, threshold: float = 0.5) -> DataFrame:
    """Rows that no component claims to at least ``threshold``."""
    return df.where(F.array_max(responsibilities(F.col(x).cast("array<double>"), mixture)) < threshold)
