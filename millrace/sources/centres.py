"""Scaled k-means centres as an artifact: fitted once, stored, loaded again and applied to new rows as distance features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import centre_count, centre_distances
from ..operators.neighbours import kmeans
from ..operators.series import fit_standard, standardise
from .store import Store


@dataclass(frozen=True)
class ScaledCentres:
    """Centres of standardised ``columns``, with the mean and deviation that they were standardised by."""

    columns: list[str]
    scales: dict[str, tuple[float, float]]
    centres: list[list[float]]

    def distances(self, df: DataFrame, only: list[int] | None = None) -> DataFrame:
        """``df`` with ``dist__i_K``, the distance of its scaled row to each centre (or to those of ``only``); columns that are null or not there count as 0 before scaling."""
        given = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in self.columns}
        scaled = F.array(*[(given[c] - self.scales[c][0]) / self.scales[c][1] for c in self.columns])
        made = centre_distances(scaled, self.centres)
        return df.select("*", *[made[i] for i in (range(len(made)) if only is None else only)])

    def save(self, store: Store, version: int, kind: str = "centres") -> None:
        """One table: a row for each centre, then one of means and one of deviations."""
        rows = [("centre", i, list(map(float, c))) for i, c in enumerate(self.centres)]
        rows += [(part, None, [float(self.scales[c][i]) for c in self.columns]) for i, part in enumerate(("mean", "deviation"))]
        table = store.spark.createDataFrame(rows, "part string, number int, place array<double>").withColumn("columns", F.array(*map(F.lit, self.columns)).cast("array<string>"))
        store.put_table(kind, version, table.coalesce(1))


def fit_centres(df: DataFrame, columns: list[str], key: str, k: int | None = None) -> ScaledCentres:
    """K-means of the standardised columns, nulls as 0; ``k`` by the rule for rows and columns unless given."""
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    scales = fit_standard(filled, columns)
    points = standardise(filled, scales).select(key, F.array(*columns).alias("_point"))
    return ScaledCentres(list(columns), scales, kmeans(points, "_point", key, k or centre_count(df.count(), len(columns))))


def load_centres(store: Store, version: int, kind: str = "centres") -> ScaledCentres:
    rows = sorted(store.table(kind, version).collect(), key=lambda r: (r["part"], r["number"] or 0))
    one = {r["part"]: r["place"] for r in rows if r["part"] != "centre"}
    columns = list(rows[0]["columns"])
    return ScaledCentres(columns, {c: (m, d) for c, m, d in zip(columns, one["mean"], one["deviation"])}, [list(r["place"]) for r in rows if r["part"] == "centre"])
