"""Online learners on streams: each key's learner is kept as state between micro-batches and scores a row before it learns from it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.online import STATE, STATE_COLUMNS, Params, State, kernel, moved, update


def margin(s: State, x: np.ndarray, sigma: float) -> float:
    return float((s.alpha * s.w * s.l * kernel(moved(s), x, sigma)).sum()) if len(s.c) else 0.0


def learn(stream: DataFrame, key: str, order: str, y: str, x: str, learner: str, params: Params = Params()) -> DataFrame:
    """``(key, at, margin)`` of every row of ``stream``, by the key's learner as it was before this row.

    Rows of a micro-batch are taken by ``order``; rows that arrive in a later micro-batch are learned later, whatever their order.
    Rows without key, label or vector are left out. The last samples of the smooth rule are part of the state.
    """
    kinds = dict(stream.dtypes)

    def run(k: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("o", kind="stable")
        s = State.load(dict(zip(STATE_COLUMNS, state.get))) if state.exists else State(len(rows["x"].iloc[0]))
        margins = []
        for vector, label in zip(rows["x"], rows["y"]):
            v = np.asarray(vector, float)
            margins.append(margin(s, v, params.sigma))
            update(s, v, float(label), params, learner)
        held = s.row()
        state.update(tuple(held[n] for n in STATE_COLUMNS))
        yield pd.DataFrame({"key": k[0], "at": rows["o"].to_numpy(), "margin": margins})

    dealt = stream.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(y).cast("double").alias("y"), F.col(x).cast("array<double>").alias("x")).where("k is not null and y is not null and x is not null")
    return dealt.groupBy("k").applyInPandasWithState(run, f"key {kinds[key]}, at {kinds[order]}, margin double", STATE, "append", "NoTimeout")
