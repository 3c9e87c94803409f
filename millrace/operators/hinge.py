"""The linear SVM's exact optimum over all rows, by cutting planes.

The objective is reg / 2 |w|^2 plus the mean hinge loss. Rows are dealt to blocks by a hash; a block's mean loss is convex, so its value and gradient at any w give a
plane that lies below it everywhere. A round is one pass over the rows that returns a plane for each block (one row of ``1 + m`` numbers a block and
task, added up in the shuffle). The planes' own minimum is a small quadratic program on the driver, whose value is a lower bound of the optimum; the best
objective met is an upper bound. Rounds end when the two meet. Driver memory is planes times features: rounds times blocks, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import checkpointed


@dataclass
class Optimum:
    """``bound`` is proven to be no more than the least objective there is, ``objective`` what ``weights`` have."""

    weights: list[float]
    objective: float
    bound: float
    rounds: int


def _model_minimum(planes: list[tuple[np.ndarray, np.ndarray]], shares: list[np.ndarray], reg: float, tolerance: float, steps: int = 30_000) -> tuple[np.ndarray, float]:
    """Minimum of reg / 2 |w|^2 + the sum over blocks of the highest plane, through its dual: shares of each block's planes, which sum to 1.

    Each step moves share from the block's worst held plane to its best; ``shares`` are changed in place, the value is that of the dual, a lower bound at any time.
    """
    w = -sum(s @ a for (a, _), s in zip(planes, shares)) / reg
    for _ in range(steps // max(1, len(planes))):
        gap = 0.0
        for (a, c), s in zip(planes, shares):
            height = a @ w + c
            up = int(height.argmax())
            held = np.flatnonzero(s > 0)
            down = int(held[height[held].argmin()])
            gap += float(s @ (height[up] - height))
            if up == down:
                continue
            d = a[up] - a[down]
            curve = float(d @ d) / reg
            step = s[down] if curve <= 0 else min(s[down], (height[up] - height[down]) / curve)
            s[up] += step
            s[down] = 0.0 if step >= s[down] else s[down] - step
            w = w - step * d / reg
        if gap <= tolerance:
            break
    return w, -reg / 2 * float(w @ w) + sum(float(s @ c) for (_, c), s in zip(planes, shares))


def hinge_optimum(df: DataFrame, y: str, x: str, reg: float = 1e-3, tolerance: float = 1e-4, rounds: int = 300, blocks: int = 8) -> Optimum:
    """Weights whose objective is within ``tolerance`` (times the objective at 0 where that is more than 1) of the optimum.

    Rows without label or vector, or with a null component, are left out; labels are +1 and -1. Without rows the weights are empty. It raises if ``rounds`` do not suffice.
    """
    known = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(x).cast("array<double>").alias("x"))
    known = known.where("size(x) > 0 and not exists(x, v -> v is null)").withColumn("block", F.pmod(F.xxhash64(F.col("y"), F.col("x")), F.lit(blocks)).cast("int"))
    rows = checkpointed(known).cache()
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("m")).head()
    if not sizes["n"]:
        return Optimum([], 0.0, 0.0, 0)
    if sizes["low"] != sizes["m"]:
        raise ValueError(f"vectors of {x} have {sizes['low']} to {sizes['m']} components")
    n, m = sizes["n"], sizes["m"]

    def cut(w: np.ndarray) -> tuple[float, dict[int, np.ndarray]]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((blocks, m + 1))
            for batch in batches:
                label = batch.column(0).to_numpy(zero_copy_only=False)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                margin = 1 - label * (v @ w)
                inside = margin > 0
                # the plane: its value at 0 is the share of rows inside, its slope minus the sum of y x inside
                terms = np.column_stack([inside.astype(float), -(label * inside)[:, None] * v])
                np.add.at(total, batch.column(2).to_numpy(zero_copy_only=False), terms)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(blocks), m + 1)), pa.array(np.tile(np.arange(m + 1), blocks)), pa.array(total.ravel())], ["block", "i", "a"])

        sums = rows.mapInArrow(partial, "block long, i long, a double").groupBy("block", "i").agg(F.sum("a").alias("a")).collect()
        planes: dict[int, np.ndarray] = {}
        for r in sums:
            planes.setdefault(r["block"], np.zeros(m + 1))[r["i"]] = r["a"] / n
        return float(sum(p[0] + p[1:] @ w for p in planes.values())), planes

    w, best, lower = np.zeros(m), (np.inf, np.zeros(m)), -np.inf
    held: list[tuple[list, list]] = [([], []) for _ in range(blocks)]
    shares = [np.zeros(0) for _ in range(blocks)]
    for done in range(1, rounds + 1):
        loss, planes = cut(w)
        objective = loss + reg / 2 * float(w @ w)
        best = min(best, (objective, w), key=lambda p: p[0])
        if best[0] - lower <= tolerance * max(1.0, best[0]):
            break
        for b, plane in planes.items():
            held[b][0].append(plane[1:])
            held[b][1].append(plane[0])
            shares[b] = np.append(shares[b], 0.0 if len(shares[b]) else 1.0)
        w, value = _model_minimum([(np.array(a), np.array(c)) for a, c in held], shares, reg, tolerance / 10)
        lower = max(lower, value)
    else:
        raise ValueError(f"bounds {lower} and {best[0]} have not met in {rounds} rounds")
    rows.unpersist()
    return Optimum(best[1].tolist(), best[0], lower, done)
