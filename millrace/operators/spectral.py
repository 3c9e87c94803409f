"""The spectral filter's learner as a state that can be stored and gone on from: several input and output series, batch and stream."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .online import fold_ordered, spectral_filters


@dataclass(frozen=True)
class FilterParams:
    inputs: int = 1
    outputs: int = 1
    length: int = 20
    filters: int = 5
    eta: float = 0.01
    bound: float = 1.0


#: a filter's state: the inputs of the last rows (latest first), the last outputs, and the weights, row after row
FILTER = "past array<double>, last array<double>, weights array<double>"


class Filter:
    """Predicts outputs from filtered past inputs, the last and present inputs and the last first output, and learns from the truth.

    The weights of each output are kept within ``bound`` in norm. A truth that is not known (NaN) teaches nothing and leaves the last outputs as they were.
    """

    def __init__(self, params: FilterParams, row: dict | None = None) -> None:
        p, self.params = params, params
        self.filters = spectral_filters(p.length, p.filters)
        self.past = np.zeros((p.length, p.inputs)) if row is None else np.array(row["past"], float).reshape(p.length, p.inputs)
        self.last = np.zeros(p.outputs) if row is None else np.array(row["last"], float)
        self.weights = np.zeros((p.outputs, p.inputs * (p.filters + 2) + 1)) if row is None else np.array(row["weights"], float).reshape(p.outputs, -1)

    def step(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = np.concatenate([(self.filters.T @ self.past).ravel(), self.past[0], x, self.last[:1]])
        predicted = self.weights @ f
        if np.isfinite(y).all():
            self.weights = self.weights - 2 * self.params.eta * np.outer(predicted - y, f)
            size = np.linalg.norm(self.weights, axis=1, keepdims=True)
            self.weights = self.weights * np.minimum(1.0, self.params.bound / np.maximum(size, 1e-300))
            self.last = np.array(y, float)
        self.past = np.vstack([x, self.past[:-1]])
        return predicted

    def row(self) -> dict:
        return {"past": self.past.ravel().tolist(), "last": self.last.tolist(), "weights": self.weights.ravel().tolist()}


def _fold(df: DataFrame, key: str, order: str, inputs: list[str], outputs: list[str], params: FilterParams, start: DataFrame | None, keep_predictions: bool) -> DataFrame:
    if (len(inputs), len(outputs)) != (params.inputs, params.outputs):
        raise ValueError("the parameters are for another number of series")
    kinds = dict(df.dtypes)
    list_of = lambda names: F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names])
    state = "struct<past:array<double>,last:array<double>,weights:array<double>>"
    rows = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("at"), list_of(inputs).alias("x"), list_of(outputs).alias("y"), F.lit(None).cast(state).alias("s"))
    if start is not None:  # a stored state goes before the key's first row
        before = start.select(F.col("key").cast(kinds[key]), F.lit(None).cast(kinds[order]).alias("at"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("array<double>").alias("y"), F.struct("past", "last", "weights").alias("s"))
        rows = rows.unionByName(before)

    def begin(row) -> Filter:
        return Filter(params, None if row.s is None else {n: row.s[n] for n in ("past", "last", "weights")})

    def step(s: Filter, row) -> dict | None:
        if row.s is not None:
            return None
        # an input that is missing counts as 0
        made = s.step(np.nan_to_num(np.asarray(row.x, float)), np.asarray(row.y, float))
        return {"key": row.k, "at": row.o, "predicted": made.tolist()} if keep_predictions else None

    schema = f"key {kinds[key]}, at {kinds[order]}, predicted array<double>" if keep_predictions else f"key {kinds[key]}, {FILTER}"
    end = None if keep_predictions else lambda k, s: {"key": k, **s.row()}
    return fold_ordered(rows, "key", "at", {"x": F.col("x"), "y": F.col("y"), "s": F.col("s")}, begin, step, end, schema)


def filter_predictions(df: DataFrame, key: str, order: str, inputs: list[str], outputs: list[str], params: FilterParams, start: DataFrame | None = None) -> DataFrame:
    """``(key, at, predicted)``: what each row's outputs are predicted to be before they teach; ``start`` (of :func:`filter_states`) goes on from stored states."""
    return _fold(df, key, order, inputs, outputs, params, start, True)


def filter_states(df: DataFrame, key: str, order: str, inputs: list[str], outputs: list[str], params: FilterParams, start: DataFrame | None = None) -> DataFrame:
    """``(key, past, last, weights)``: each key's state after its rows, to be stored."""
    return _fold(df, key, order, inputs, outputs, params, start, False)
