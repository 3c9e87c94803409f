"""Online learners: formulas as a numpy step, folded over ordered rows of each model key, or over a stream.

Learners are sequential within a key and parallel across keys. ``fit`` deals rows by key and folds them in order;
the state of a key is one row of arrays; ``millrace.streaming.learners`` keeps the same state for a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linalg import moments

STATE = "c array<array<double>>, l array<double>, w array<double>, alpha array<double>, grad array<double>, u array<array<double>>, rx array<array<double>>, ry array<double>"
STATE_COLUMNS = [c.split(" ")[0] for c in STATE.split(", ")]


def fold_ordered(df: DataFrame, key: str, order: str, columns: dict[str, Column], begin: Callable, step: Callable, end: Callable | None, schema: str) -> DataFrame:
    """A fold over each key's rows by ``order``, in bounded memory: keys are dealt to tasks and sorted there by Spark, batches stream past.

    ``begin(row)`` gives the state before a key's first row, ``step(state, row)`` a row to emit or None, ``end(key, state)`` a last row.
    Rows are named tuples with ``k``, ``o`` and ``columns``. One key is one task, since its learner depends on the order of its rows.
    """
    names = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, started = None, None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if not started or row.k != now:
                    if started and end is not None:
                        out.append(end(now, state))
                    now, state, started = row.k, begin(row), True
                made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pd.DataFrame(out)
        if started and end is not None:
            yield pd.DataFrame([end(now, state)])

    dealt = df.select(F.col(key).alias("k"), F.col(order).alias("o"), *[columns[n].alias(n) for n in names]).where("k is not null")
    return dealt.repartition("k").sortWithinPartitions("k", "o").mapInPandas(run, schema)


def linear_fold(df: DataFrame, key: str, order: str, y: str, x: str, size: int, eta: float) -> DataFrame:
    """``(key, w)`` of the linear online SVM: w += eta y x where y w.x < 1. Rows without key, label or vector are left out."""

    def step(w: np.ndarray, row) -> None:
        v = np.asarray(row.x, float)
        if row.y * (w @ v) < 1:
            w += eta * row.y * v

    kind = dict(df.dtypes)[key]
    columns = {"y": F.col(y).cast("double"), "x": F.col(x).cast("array<double>")}
    known = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    return fold_ordered(known, key, order, columns, lambda row: np.zeros(size), step, lambda k, w: {key: k, "w": w.tolist()}, f"{key} {kind}, w array<double>")


def hinge_fit(df: DataFrame, y: str, x: str, size: int, rounds: int = 50, reg: float = 1e-3, eta: float = 1.0) -> list[float]:
    """Weights of the linear SVM on all rows: sub-gradient steps of falling length on mean hinge loss plus reg / 2 |w|^2.

    A round is one aggregate of ``size`` numbers; the weights are those with the smallest loss met.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(x).cast("array<double>").alias("x"))
    w, best = np.zeros(size), (np.inf, np.zeros(size))
    for t in range(rounds):
        margin = F.col("y") * F.aggregate(F.zip_with("x", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        inside = F.when(margin < 1, F.col("y")).otherwise(0.0)
        r = rows.agg(F.avg(F.greatest(1 - margin, F.lit(0.0))).alias("loss"), *[F.avg(inside * F.get("x", F.lit(j))).alias(f"g{j}") for j in range(size)]).first()
        if r["loss"] is None:
            break
        loss = r["loss"] + reg / 2 * float(w @ w)
        best = min(best, (loss, w), key=lambda p: p[0])
        w = w - eta / np.sqrt(t + 1) * (reg * w - np.array([r[f"g{j}"] for j in range(size)]))
    return best[1].tolist()


def map_fold(df: DataFrame, key: str, order: str, x: str, start: list[list[float]], width: int, alpha: float = 0.3, sigma: float | None = None) -> DataFrame:
    """``(key, weights)`` of a self-organising map that learns each key's rows one by one: w += alpha exp(-g^2 / sigma^2) (x - w), g the
    grid distance to the nearest neuron; alpha and sigma fall to 0 along the key's rows."""
    grid = np.array([divmod(i, width) for i in range(len(start))], float)
    wide = sigma or max(width, -(-len(start) // width)) / 2
    counted = df.where(F.col(x).isNotNull()).join(df.where(F.col(x).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)

    def begin(row) -> dict:
        return {"w": np.array(start, float), "t": 0}

    def step(s: dict, row) -> None:
        v, left = np.asarray(row.x, float), 1 - s["t"] / row.n
        winner = ((s["w"] - v) ** 2).sum(1).argmin()
        near = np.exp(-((grid - grid[winner]) ** 2).sum(1) / (wide * left) ** 2)
        s["w"] = s["w"] + alpha * left * near[:, None] * (v - s["w"])
        s["t"] += 1

    kind = dict(df.dtypes)[key]
    columns = {"x": F.col(x).cast("array<double>"), "n": F.col("_n")}
    return fold_ordered(counted, key, order, columns, begin, step, lambda k, s: {"key": k, "weights": s["w"].tolist()}, f"key {kind}, weights array<array<double>>")


@dataclass
class Params:
    """radius of the cover; C bounds multipliers; eps bounds the ambiguity; eta learning rate; sigma kernel width; window of the smooth rule."""

    radius: float = 0.0
    C: float = 1.0
    eps: float = 0.0
    eta: float = 0.1
    sigma: float = 1.0
    window: int = 20


class State:
    """Centres with label, weight, multiplier, gradient and ambiguity, and the last samples that the smooth rule looks back on.

    It grows by a centre for each sample that no centre of its label is near; the radius bounds it, nothing else does.
    """

    def __init__(self, m: int) -> None:
        self.c, self.u = np.empty((0, m)), np.empty((0, m))
        self.l, self.w, self.alpha, self.grad = np.empty(0), np.empty(0), np.empty(0), np.empty(0)
        self.rx, self.ry = np.empty((0, m)), np.empty(0)

    @classmethod
    def load(cls, row) -> "State":
        s = cls(len(row["c"][0]) if len(row["c"]) else 0)
        for k in ("c", "u", "rx"):
            if len(row[k]):
                setattr(s, k, np.array([list(v) for v in row[k]], float))
        for k in ("l", "w", "alpha", "grad", "ry"):
            setattr(s, k, np.array(row[k], float))
        return s

    def row(self) -> dict:
        return {k: getattr(self, k).tolist() for k in STATE_COLUMNS}


def kernel(a: np.ndarray, x: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-((a - x) ** 2).sum(1) / (2 * sigma * sigma))


def cover(s: State, x: np.ndarray, y: float, p: Params) -> None:
    """A sample near centres of its label shares a weight among them, else it becomes a centre."""
    if p.radius > 0:
        near = (s.l == y) & (np.sqrt(((s.c - x) ** 2).sum(1)) < p.radius)
        if near.any():
            s.w[near] += 1 / near.sum()
            return
    s.c, s.u = np.vstack([s.c, x]), np.vstack([s.u, np.zeros_like(x)])
    s.l, s.w, s.alpha, s.grad = np.append(s.l, y), np.append(s.w, 1.0), np.append(s.alpha, 0.0), np.append(s.grad, 0.0)


def moved(s: State) -> np.ndarray:
    """Where centres stand with their ambiguity."""
    return s.c - s.u / s.w[:, None]


def lengths(u: np.ndarray) -> np.ndarray:
    return np.sqrt((u**2).sum(1))


# An ambiguity rule moves the centres and gives the kernel for the hinge, or None where that is taken after the move.
# Moves go towards samples of the other label: a robust learner expects its centres where they hurt it most.

def ambiguity_dro(s: State, x: np.ndarray, y: float, p: Params) -> None:
    """A step for every centre, away from samples of its label; its ambiguity is then clipped to length eps."""
    k = kernel(moved(s), x, p.sigma)
    s.u = s.u - (p.eta / p.sigma**2 * y * s.alpha * s.l * k)[:, None] * (moved(s) - x)
    s.u = s.u * np.minimum(1.0, p.eps / np.maximum(lengths(s.u), 1e-300))[:, None]


def _bounded(s: State, p: Params) -> None:
    """Ambiguity scaled to a mean length of at most eps."""
    mean = lengths(s.u).mean()
    if mean > p.eps:
        s.u = s.u * (p.eps / mean)


def _pull(s: State, x: np.ndarray, y: float, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The kernel with the sample, 0 for centres of its label, and how it draws the others."""
    at = moved(s)
    k = kernel(at, x, p.sigma) * (s.l != y)
    return k, (s.alpha * k / p.sigma**2)[:, None] * (x - at)


def ambiguity_mean(s: State, x: np.ndarray, y: float, p: Params) -> None:
    """A step of the centres of the other label."""
    s.u = s.u - _pull(s, x, y, p)[1]
    _bounded(s, p)


def ambiguity_unit(s: State, x: np.ndarray, y: float, p: Params) -> None:
    """As the mean rule with a step of length eta, where the pull as a matrix has a 2-norm above 0.01."""
    _, pull = _pull(s, x, y, p)
    size = np.linalg.norm(pull, 2)
    if size > 0.01:
        s.u = s.u - p.eta * pull / size
        _bounded(s, p)


def ambiguity_unit_before(s: State, x: np.ndarray, y: float, p: Params) -> np.ndarray:
    """As the unit rule; the hinge sees the kernel of before the move, in which centres of the sample's label have no part."""
    k, _ = _pull(s, x, y, p)
    ambiguity_unit(s, x, y, p)
    return k


def ambiguity_smooth(s: State, x: np.ndarray, y: float, p: Params) -> np.ndarray:
    """A step of each centre over the last samples of the other label; the hinge sees the kernel of before the move."""
    at = moved(s)
    before, total = kernel(at, x, p.sigma), np.zeros_like(s.u)
    for z, label in zip(s.rx, s.ry):
        total += (kernel(at, z, p.sigma) * (s.l * label == -1))[:, None] * (z - at)
    s.u = s.u - p.eta * s.alpha[:, None] * total
    _bounded(s, p)
    return before


def rescale(s: State, weighted: bool, signed: bool) -> None:
    """Each label's multipliers get half of the total."""
    part = s.alpha * s.w if weighted else s.alpha
    total = (part * s.l).sum() if signed else part.sum()
    for label in (1.0, -1.0):
        own = s.l == label
        mass = part[own].sum()
        if own.any() and mass > 0:
            s.alpha[own] = (part[own] if weighted and not signed else s.alpha[own]) * total / 2 / mass


#: learner: (ambiguity step, weights in the hinge, weighted rescale, signed total)
LEARNERS: dict[str, tuple[Callable | None, bool, bool, bool]] = {
    "svm": (None, False, False, False),
    "svm_weighted": (None, True, True, True),
    "dro": (ambiguity_dro, True, False, False),
    "robust": (ambiguity_mean, True, True, False),
    "robust_norm": (ambiguity_unit_before, True, True, False),
    "robust_smooth": (ambiguity_smooth, True, True, False),
    "robust_combined": (ambiguity_unit, True, True, True),
}


def update(s: State, x: np.ndarray, y: float, p: Params, learner: str) -> None:
    """One sample: cover, ambiguity (if eps is positive), hinge, multipliers, rescale.

    The hinge's weights are those of the cover where the learner has them; gradients always have them.
    """
    ambiguity, weights, weighted, signed = LEARNERS[learner]
    cover(s, x, y, p)
    if ambiguity is ambiguity_smooth:
        s.rx, s.ry = np.vstack([s.rx, x])[-p.window :], np.append(s.ry, y)[-p.window :]
    k = ambiguity(s, x, y, p) if ambiguity is not None and p.eps > 0 else None
    if k is None:
        k = kernel(moved(s), x, p.sigma)
    if y * ((s.w if weights else 1.0) * k * s.alpha * s.l).sum() < 1:
        s.grad = s.grad - y * s.w * s.l * k
        s.alpha = np.minimum(np.exp(-p.eta * s.grad - 1), p.C)
        rescale(s, weighted, signed)


def fit(df: DataFrame, key: str, order: str, y: str, x: str, learner: str, params: Params = Params(), start: DataFrame | None = None) -> DataFrame:
    """A row of state for each key; a key's rows stream through one task in order, its memory is the centres.

    ``start`` has rows of state that keys go on from; its keys without rows stay as they are. Rows without key, label or vector are left out.
    Samples are learned a block at a time (:mod:`millrace.operators.online_blocks`). Time grows with samples times centres.
    """
    from .online_blocks import BLOCK, learn

    def flush(s: State) -> None:
        if s.waiting:
            learn(s, np.array([np.asarray(x, float) for x, _ in s.waiting]), np.array([y for _, y in s.waiting], float), params, learner)
            s.waiting = []

    def begin(row) -> State:
        s = State(len(row.x)) if row.s is None else State.load(row.s if isinstance(row.s, dict) else row.s.asDict())
        s.waiting = []
        return s

    def step(s: State, row) -> None:
        if row.s is None:
            s.waiting.append((row.x, row.y))
            if len(s.waiting) == BLOCK:
                flush(s)

    def end(k, s: State) -> dict:
        flush(s)
        return {"key": k, **s.row()}

    kind = dict(df.dtypes)
    state = ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in STATE.split(", ")))
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(y).cast("double").alias("y"), F.col(x).cast("array<double>").alias("x")).where("y is not null and x is not null")
    rows = rows.withColumn("s", F.lit(None).cast(f"struct<{state}>")).withColumn("first", F.lit(1))
    if start is not None:
        held = F.struct(*[F.col(c) for c in STATE_COLUMNS]).alias("s")
        rows = rows.union(start.select(F.col("key").alias("k"), F.lit(None).alias("o"), F.lit(None).alias("y"), F.lit(None).alias("x"), held, F.lit(0)))
    rows = rows.withColumn("o", F.struct("first", "o"))
    columns = {n: F.col(n) for n in ("y", "x", "s")}
    return fold_ordered(rows, "k", "o", columns, begin, step, end, f"key {kind[key]}, {STATE}")


def fit_scaling(df: DataFrame, x: str) -> tuple[list[float], list[float]]:
    """Mean and variance (of the population) of each component, from one aggregate; components without variance count as having 1."""
    found = moments(df, x)
    if not found:
        return [], []
    ((n, total, gram),) = found.values()
    variance = np.maximum(np.diag(gram) / n - (total / n) ** 2, 0.0)
    return (total / n).tolist(), np.where(variance > 1e-12 * np.diag(gram) / n, variance, 1.0).tolist()


def scaled(x: Column, scaling: tuple[list[float], list[float]]) -> Column:
    """A vector less the means, by the roots of the variances: what learners of stored scaling are given."""
    means, variances = (F.array(*map(F.lit, v)) for v in scaling)
    centred = F.zip_with(x, means, lambda a, b: a - b)
    return F.zip_with(centred, variances, lambda a, v: a / F.sqrt(v))


def linear_margins(df: DataFrame, x: str, w: list[float]) -> Column:
    """The linear learner's prediction: w.x."""
    return F.aggregate(F.zip_with(F.col(x), F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _numbers(values: pa.Array) -> np.ndarray:
    """An Arrow array of numbers, or of lists of as many numbers each, without Python objects."""
    if not pa.types.is_list(values.type):
        return values.to_numpy(zero_copy_only=False)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.empty((0, 0))


def margins(df: DataFrame, states: DataFrame, key: str, x: str, sigma: float, spread: int = 8) -> DataFrame:
    """``df`` with ``margin``: the sum over a key's centres of alpha w l k. Null where the key has no state, or the vector is null.

    Rows of a key are dealt to ``spread`` groups, and each meets the key's state there: matrix products in place of a loop over centres.
    """
    kinds = dict(df.dtypes)
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(x)), F.lit(spread)).cast("int"))
    held = states.select("key", "c", "l", "w", "alpha", "u", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_salt"))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.full(left.num_rows, np.nan)
        vectors = left[x].to_pylist()
        if right.num_rows:
            s = {n: _numbers(right[n][0].values) for n in ("c", "l", "w", "alpha", "u")}
            at, weight = s["c"] - s["u"] / s["w"][:, None] if len(s["w"]) else s["c"], s["alpha"] * s["w"] * s["l"]
            known = [i for i, v in enumerate(vectors) if v is not None and None not in v]
            for lo in range(0, len(known), 256):
                some = known[lo : lo + 256]
                v = np.array([vectors[i] for i in some], float)
                gap = (v**2).sum(1)[:, None] + (at**2).sum(1)[None] - 2 * v @ at.T if len(weight) else np.zeros((len(some), 0))
                out[some] = np.exp(-np.maximum(gap, 0) / (2 * sigma * sigma)) @ weight
        return left.drop_columns(["_salt"]).append_column("margin", pa.array(out, from_pandas=True))

    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", margin double"
    return rows.groupBy(key, "_salt").cogroup(held.groupBy("key", "_salt")).applyInArrow(scored, schema)


def surface(states: DataFrame, sigma: float, steps: int = 100, reach: float = 1.5) -> DataFrame:
    """``(key, x, y, margin)`` on a grid over ``reach`` times the range of each key's centres, which have two dimensions."""
    ends = states.where(F.size("c") > 0)
    for name, j in (("x", 0), ("y", 1)):
        side = F.transform("c", lambda v: F.get(v, F.lit(j)))  # noqa: B023
        middle, half = (F.array_max(side) + F.array_min(side)) / 2, (F.array_max(side) - F.array_min(side)) / 2
        ends = ends.withColumn(f"_{name}", F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: middle + reach * half * (2 * i / (steps - 1) - 1)))  # noqa: B023
    points = ends.select("key", F.explode("_x").alias("x"), "_y").select("key", "x", F.explode("_y").alias("y")).withColumn("_p", F.array("x", "y"))
    return margins(points, states, "key", "_p", sigma).drop("_p")


def rbf(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v) / (2 * sigma * sigma))


def kernel_rows(df: DataFrame, key: str, x: str, centres: list[list[float]], sigma: float) -> DataFrame:
    """``(key, i, k)``: the kernel of each row's vector with each of ``centres``; rows of the Gram matrix. Centres are constants of the plan."""
    values = F.array(*[rbf(F.col(x), F.array(*map(F.lit, c)), sigma) for c in centres])
    return df.where(F.col(x).isNotNull()).select(key, F.posexplode(values).alias("i", "k"))


def one_class_scores(df: DataFrame, x: str, centres: list[list[float]], alpha: list[float], sigma: float) -> Column:
    """alpha.k(x) - 1 over constant centres."""
    total = F.lit(-1.0)
    for c, a in zip(centres, alpha):
        total = total + a * rbf(F.col(x), F.array(*map(F.lit, c)), sigma)
    return total


# --- spectral filter for series ---

def spectral_filters(length: int, k: int) -> np.ndarray:
    """The first k eigenvectors of 2 / ((i+j)^3 - (i+j)), each times its eigenvalue to the power 1/4, largest first."""
    s = np.add.outer(np.arange(1, length + 1), np.arange(1, length + 1)).astype(float)
    values, vectors = np.linalg.eigh(2 / (s**3 - s))
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    return vectors * np.maximum(values[order], 0) ** 0.25


def spectral_fit(df: DataFrame, key: str, order: str, inputs: str, output: str, length: int = 20, k: int = 5, eta: float = 0.01, bound: float = 1.0) -> DataFrame:
    """``(key, order, predicted)``: predictions before each update, learning along each key's series."""
    filters = spectral_filters(length, k)

    def begin(row) -> dict:
        return {"past": np.zeros(length), "x": 0.0, "y": 0.0, "w": np.zeros(k + 3)}

    def step(s: dict, row) -> dict:
        f = np.concatenate([filters.T @ s["past"], [s["x"], row.x, s["y"]]])
        predicted = float(s["w"] @ f)
        w = s["w"] - 2 * eta * (predicted - row.y) * f
        size = np.linalg.norm(w)
        s["w"] = w * min(1.0, bound / size) if size > 0 else w
        s["past"] = np.concatenate([[row.x], s["past"][:-1]])
        s["x"], s["y"] = row.x, row.y
        return {"key": row.k, "at": row.o, "predicted": predicted}

    kinds = dict(df.dtypes)
    columns = {"x": F.col(inputs).cast("double"), "y": F.col(output).cast("double")}
    return fold_ordered(df, key, order, columns, begin, step, None, f"key {kinds[key]}, at {kinds[order]}, predicted double")
