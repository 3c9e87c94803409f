"""Learners over streams in event time: rows wait as state until the watermark has passed them, and are then taken in the order of their time.

So a stream gives what the batch fold over the same rows gives, however rows arrive within the delay. Rows later than the watermark are dropped by Spark before they reach
the learner and counted in the query's progress (``numRowsDroppedByWatermark``). Rows that the watermark has not passed yet wait; a row of a later time lets them go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.mixtures import GROWN, Growth, Mixture, OneClass
from ..operators.spectral import FILTER, Filter, FilterParams

#: the state store that keyed value and list states need
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Waiting rows ``(us, tie, x, y)``, times in microseconds, in a list state, the learner in a value state, and a timer for the earliest waiting row."""

    def __init__(self, schema: str, load, step, row) -> None:
        self.schema, self.load, self.step, self.row = schema, load, step, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.learner = handle.getValueState("learner", self.schema)
        self.waiting = handle.getListState("waiting", "us long, tie long, x array<double>, y array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.appendList([(int(r.us), int(r.tie), list(r.x), list(r.y)) for r in batch.itertuples()])
            least = int(batch["us"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame()

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due = [r for r in held if r[0] <= reached * 1000]
        later = held[len(due) :]
        if not due:
            if later:
                self._wake(later[0][0])
            yield pd.DataFrame()
            return
        state = self.load(dict(zip([c.split()[0] for c in self.schema.split(", ")], self.learner.get())) if self.learner.exists() else None)
        said = [self.step(state, np.array(r[2], float), np.array(r[3], float)) for r in due]
        self.learner.update(tuple(self.row(state).values()))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        yield pd.DataFrame({"key": [key[0]] * len(due), "us": [r[0] for r in due], "tie": [r[1] for r in due], "said": said})

    def close(self) -> None:
        pass


def _run(stream: DataFrame, key: str, time: str, tie: str, x: list[str] | str, y: list[str], delay: str, processor: _InOrder) -> DataFrame:
    kind = dict(stream.dtypes)[key]
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    vector = F.col(x).cast("array<double>") if isinstance(x, str) else F.array(*map(number, x))
    rows = stream.withWatermark(time, delay).select(F.col(key).alias("key"), F.col(time).alias("at"), F.unix_micros(time).alias("us"), F.col(tie).cast("long").alias("tie"), vector.alias("x"), (F.array(*map(number, y)) if y else F.array().cast("array<double>")).alias("y"))
    known = rows.where("key is not null and at is not null and tie is not null and x is not null")
    made = known.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, us long, tie long, said array<double>", "Append", "EventTime")
    return made.select("key", F.timestamp_micros("us").alias("at"), "tie", "said")


def predict_stream(stream: DataFrame, key: str, time: str, tie: str, inputs: list[str], outputs: list[str], params: FilterParams, delay: str = "10 minutes") -> DataFrame:
    """``(key, at, tie, said)``: the spectral filter's predictions of each key's outputs before they teach, in the order of ``(time, tie)``."""
    load = lambda row: Filter(params, row)
    step = lambda s, x, y: s.step(np.nan_to_num(x), y).tolist()
    return _run(stream, key, time, tie, inputs, outputs, delay, _InOrder(FILTER, load, step, lambda s: s.row()))


def one_class_stream(stream: DataFrame, key: str, time: str, tie: str, x: str, mixture: Mixture, growth: Growth = Growth(), delay: str = "10 minutes") -> DataFrame:
    """``(key, at, tie, said)``: each row's one-class score before it is learned, and how many refits there have been; the memory of outliers is part of the state."""
    load = lambda row: OneClass(mixture, growth) if row is None else OneClass.load(row, growth)

    def step(s: OneClass, v: np.ndarray, _: np.ndarray) -> list[float]:
        said = [s.score(v), float(s.refits)]
        s.learn(v)
        return said

    return _run(stream, key, time, tie, x, [], delay, _InOrder(GROWN, load, step, lambda s: s.row()))
