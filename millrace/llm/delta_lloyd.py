"""Centroid clustering by delta Lloyd rounds, in exact integer arithmetic.

**Method.** Assignments and global sums are persisted. Each round compares a vector only with the centroids that changed since it was last
compared, unless its own centroid changed: then with all. The stored distance to an unchanged owner stays exact, and every other unchanged centroid lost to it
before. Vectors whose owner moved carry their components along; these signed transfers (added to the new owner, taken from the old one) are
aggregated in integers and added to the global sums, so no round sums all vectors. Rounds stop early once no centroid changes, since the rest would repeat.

**Scale.** Vectors are written once, bucketed by row number; a round's assignments (ids, owner, distance; components only of vectors that moved) are written
with the same buckets by the tasks that made them, so a round joins the two bucket by bucket and shuffles nothing. Sums are partial in each task; ``k * dims`` of them reach
the driver. Rounds read only staged tables: a lost executor costs its tasks. Work is rows times changed centroids.

**Defined cases.** Vectors that are null, of another length, or hold null, NaN or infinite components take no part. Null ids are kept, and start no centroid while
others can. Repeated ids are rows of their own; where hashes tie, the smaller vector starts first. With fewer vectors than ``k`` there are as many
centroids. Ties of distance go to the smaller number; empty centroids stay. An empty table has no rows; other columns are ignored. A component of
2 ** 27 or more after scaling is an error: squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, remove, stage, unstage

SCALE, LARGEST = 1024, 1 << 27
_STATE = "row long, vec_id long, cluster int, distance long, owner int, moved array<int>"


def integer_vectors(embeddings: DataFrame, dims: int, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """``(row, vec_id, x)``: vectors of ``dims`` finite components as floors of 1024 times the component."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(2)), dims), False)
            batch = batch.filter(fits)
            x = pc.list_flatten(batch.column(2)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            whole = np.isfinite(x).all(axis=1)
            x = np.floor(x[whole] * SCALE)
            if x.size and not np.abs(x).max() < LARGEST:
                raise ValueError(f"a component of {vec_col} times {SCALE} is {LARGEST} or more")
            batch = batch.filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(x.astype(np.int32))], ["row", "vec_id", "x"])

    plain = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(scaled, "row long, vec_id long, x array<int>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.int32()))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owner and squared distance of each row of ``x``; ``owner`` is -1 where there is none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    owner[lost], distance[lost] = len(centroids), np.iinfo(np.int64).max
    for c in range(len(centroids)):
        rows = np.arange(len(x)) if changed[c] else np.flatnonzero(lost)
        if len(rows):
            found = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
            # centroids come in ascending order, but an unchanged owner may have a larger number than an equally near one
            better = (found < distance[rows]) | ((found == distance[rows]) & (c < owner[rows]))
            owner[rows[better]], distance[rows[better]] = c, found[better]
    return owner, distance


class Rounds:
    """The persisted state: bucketed vectors, bucketed assignments of the last round, sums and centroids."""

    def __init__(self, vectors: DataFrame, k: int, dims: int, seed: str, buckets: int | None = None) -> None:
        self.spark, self.dims = vectors.sparkSession, dims
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.vectors = self._write(vectors, "vectors", spread=True)
        first = self.spark.table(self.vectors).withColumn("at", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
        seeds = first.orderBy(F.col("at").asc_nulls_last(), "x").limit(k).select("x").collect()
        self.centroids = [[int(v) for v in r["x"]] for r in seeds]
        self.changed = [True] * len(seeds)
        self.sums = self.spark.createDataFrame([], "cluster int, component int, total decimal(38,0), n decimal(38,0)")
        self.assigned: str | None = None

    def _write(self, rows: DataFrame, name: str, spread: bool = False) -> str:
        table = f"{name}_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "row") if spread else rows).write.bucketBy(self.buckets, "row").sortBy("row").option("path", new_path(self.spark, name)).saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        folders = {f.rsplit("/", 1)[0] for f in self.spark.table(table).inputFiles()}
        self.spark.sql(f"DROP TABLE {table}")
        for folder in folders:
            remove(self.spark, folder)

    def assign(self) -> None:
        """Compare vectors with what changed and write the new assignments in place of the last."""
        centroids, changed, dims = np.array(self.centroids, np.int64).reshape(-1, self.dims), np.array(self.changed, bool), self.dims

        def reassigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2), dims)
                old = pc.fill_null(batch.column(3), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner, distance = nearest(x, old, pc.fill_null(batch.column(4), 0).to_numpy(zero_copy_only=False).astype(np.int64), centroids, changed)
                moved = pc.if_else(pa.array(owner != old), batch.column(2), None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(owner, pa.int32()), pa.array(distance), pa.array(old, pa.int32()), moved], ["row", "vec_id", "cluster", "distance", "owner", "moved"])

        vectors = self.spark.table(self.vectors)
        if self.assigned is None:
            known = vectors.select("row", "vec_id", "x", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        else:
            known = vectors.join(self.spark.table(self.assigned).select("row", "cluster", "distance"), "row").select("row", "vec_id", "x", "cluster", "distance")
        before, self.assigned = self.assigned, self._write(known.mapInArrow(reassigned, _STATE), "assigned")
        if before:
            self._drop(before)

    def transfers(self) -> DataFrame:
        """What vectors that moved in the last round add to and take from each cluster, a component a row."""
        dims = self.dims

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                x = _matrix(batch.column(2), dims)
                x = np.column_stack([x, np.ones(len(x), np.int64)])
                for column, sign in ((0, 1), (1, -1)):
                    owners = batch.column(column).to_numpy(zero_copy_only=False)
                    for c in np.unique(owners[owners >= 0]):
                        totals[int(c)] = totals.get(int(c), 0) + sign * x[owners == c].sum(axis=0)
            made = [(c, j, int(v), int(row[-1])) for c, row in totals.items() for j, v in enumerate(row[:-1])]
            columns = list(zip(*made)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["cluster", "component", "total", "n"])

        rows = self.spark.table(self.assigned).where("moved is not null").select("cluster", "owner", "moved")
        return rows.mapInArrow(moved, "cluster int, component int, total long, n long")

    def update(self) -> None:
        """Add the transfers to the sums, and move every centroid that has vectors to the floor of their mean."""
        both = self.sums.unionByName(self.transfers().select("cluster", "component", F.col("total").cast("decimal(38,0)").alias("total"), F.col("n").cast("decimal(38,0)").alias("n")))
        totals = both.groupBy("cluster", "component").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").cast("decimal(38,0)").alias("n"))
        before, self.sums = self.sums, stage(totals, "sums")
        moved = [list(c) for c in self.centroids]
        for r in self.sums.where("n > 0").collect():
            moved[r["cluster"]][r["component"]] = int(r["total"]) // int(r["n"])
        unstage(before)
        self.changed = [a != b for a, b in zip(self.centroids, moved)]
        self.centroids = moved

    def close(self) -> None:
        self._drop(self.vectors)
        unstage(self.sums)


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3:", buckets: int | None = None, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Each vector's ``cluster`` and squared ``distance`` after ``rounds`` rounds, its cluster's inertia, that of all, and its centroid's digest."""
    state = Rounds(integer_vectors(embeddings, dims, id_col, vec_col), k, dims, seed, buckets)
    state.assign()
    for _ in range(rounds):
        state.update()
        if not any(state.changed):
            break
        state.assign()
    state.close()
    assigned = state.spark.table(state.assigned)
    sizes = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"))
    found = {r["cluster"]: int(r["inertia"]) for r in sizes.collect()}
    whole = sum(found.values())
    rows = [(c, inertia, whole, hashlib.sha256(",".join(map(str, state.centroids[c])).encode()).hexdigest()) for c, inertia in found.items()]
    summary = state.spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.select("vec_id", "cluster", "distance").join(F.broadcast(summary), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same clustering in DuckDB SQL: every round compares all vectors with all centroids and sums them anew."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: floor(1024 * e)::BIGINT) AS x, sha256('3:' || vec_id::VARCHAR) AS hashed FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY hashed NULLS LAST, x) - 1)::INTEGER AS cluster, x AS c FROM v ORDER BY hashed NULLS LAST, x LIMIT {k})",
    ]
    for r in range(rounds + 1):
        squares = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := {squares}, c := cluster)) AS best FROM (SELECT row_number() OVER () AS own, * FROM v), c{r} GROUP BY own, vec_id)")
        if r < rounds:
            # floor of the mean: division of whole numbers rounds towards zero
            floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
            steps.append(f"s{r} AS (SELECT best.c AS cluster, j, sum(x[j]) AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {dims + 1}) t(j) GROUP BY best.c, j)")
            steps.append(f"m{r} AS MATERIALIZED (SELECT cluster, list({floor} ORDER BY j) AS c FROM s{r} GROUP BY cluster)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.cluster = o.cluster)")
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,"
        f" sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best.c"
    )
