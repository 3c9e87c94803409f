"""Approximate nearest neighbours by largest inner product: stable projections and kd-trees.

A vector x of length at most M becomes ``(x, sqrt(M^2 - |x|^2))`` and a query q becomes ``(q, 0)``; the
nearest of these in Euclidean distance has the largest inner product. They are projected to ``DIMS`` dimensions by
Gaussian (2-stable) weights. For a vector at distance d, the squared projected distance over d^2 is chi-square
distributed with ``DIMS`` degrees of freedom. So neighbours are taken in order of projected distance and verified by
their true inner product, until the squared projected distance exceeds ``d_k^2`` (of the k-th best so far) times
the ``confidence`` quantile: each true neighbour has been met by then with that probability or more.

Rows are dealt to the cells of a kd-tree over projections. Its split values come from a sample of at most
``SAMPLE`` rows; every row is indexed, and cells' boxes are computed from all rows. Inside a cell's block of rows, a kd-tree of
leaves of ``LEAF`` rows orders the search in every round. Queries search their own cell first; the score of their k-th best so far
then tells, by the same test against cells' boxes, which other cells they visit. These are visited in rounds, each of ``GROWTH`` times
the cells seen so far, nearest first: so the k-th score improves between rounds, and a round returns only what improves it.

Scale: a block is a cell's rows by hash, of about ``BLOCK`` rows; a task holds one block and one chunk of about ``CHUNK``
queries, so a vector that a third of the rows share fills blocks, not one task. The driver holds boxes and counts of the cells, at most ``2 **
DEEPEST``; beyond some 30 million rows cells have several blocks and a visit reads all of its cell's.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part; repeated ids are rows of their own, and a query does not meet any row of its own id; an id that asks with several
vectors asks with the least of them; fewer
candidates than k give all of them; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, unstage

K, DIMS, CONFIDENCE, SEED = 20, 8, 0.96, 42
SAMPLE, BLOCK, CHUNK, LEAF = 200_000, 2048, 512, 64
#: Cells at most, as a power of two, and how many times the cells seen so far a round of visits adds.
DEEPEST, GROWTH = 14, 8
#: Blocks that many queries visit, broadcast up to this number and joined by a shuffle beyond it.
OFTEN_SENT = 100_000


def chi_square_quantile(p: float, dims: int) -> float:
    """The value that a chi-square variable of an even number of degrees of freedom stays below with probability p."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def projection(dims_in: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims_in, dims))


def split_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) of the inner nodes, heap-numbered from 1: each splits its widest dimension at the median."""
    dim, value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    held = {1: points}
    for node in range(1, 1 << depth):
        own = held.pop(node)
        if len(own):
            dim[node] = int(np.argmax(own.max(0) - own.min(0)))
            value[node] = np.median(own[:, dim[node]])
        high = own[:, dim[node]] >= value[node]
        held[2 * node], held[2 * node + 1] = own[~high], own[high]
    return dim, value


def cells_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    node = np.ones(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + (points[np.arange(len(points)), tree[0][node]] >= tree[1][node])
    return node - (1 << depth)


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The rows of the leaves of a kd-tree, each split at the median of its widest dimension."""
    open_, done = [np.arange(len(points))], []
    while open_:
        own = open_.pop()
        if len(own) <= size:
            done.append(own)
            continue
        some = points[own]
        by = int(np.argmax(some.max(0) - some.min(0)))
        half = len(own) // 2
        order = np.argpartition(some[:, by], half)
        open_ += [own[order[:half]], own[order[half:]]]
    return done


def _box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d : d + 1]
        gap = np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0)
        out += gap * gap
    return out


def search_block(rows: tuple[np.ndarray, np.ndarray, np.ndarray], queries: tuple[np.ndarray, ...], k: int, norm2: float, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place of the query, id, score) of what each query finds in a block, and how many rows were verified.

    rows: ids, vectors, projections; queries: ids, vectors, projections, k-th score so far (minus infinity where there is none). Every query takes
    the block's leaves in order of projected distance; in a step, queries that have come to the same leaf are served together. A query ends
    when its next leaf is further than the chi-square test lets a better neighbour be, given its k-th score up to then.
    """
    ids, vectors, points = rows
    q_ids, q_vectors, q_points, kth = queries[0], queries[1], queries[2], queries[3].copy()
    parts = leaves(points)
    low, high = (np.array([f(points[p], axis=0) for p in parts]) for f in (np.min, np.max))
    gaps = _box_distance(q_points, low, high)
    order = np.argsort(gaps, axis=1, kind="stable")
    own = norm2 + (q_vectors * q_vectors).sum(1)
    floor = kth.copy()  # what a query had before this block: only better or equal ones are of use
    found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    active, verified = np.arange(len(q_ids)), 0
    for step in range(len(parts)):
        # squared distance of the augmented vectors: M^2 + |q|^2 - 2 q.x
        limit = np.where(kth[active] == -np.inf, np.inf, np.maximum(own[active] - 2 * kth[active], 0) * quantile)
        near = order[active, step]
        stay = gaps[active, near] <= limit
        active, near, limit = active[stay], near[stay], limit[stay]
        if not len(active):
            break
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_leaf = np.argsort(near, kind="stable")
        for leaf, x, y in zip(*(v.tolist() for v in _runs(near[by_leaf]))):
            some, part = by_leaf[x:y], parts[leaf]
            asks, at = active[some], points[part]
            gap = (at * at).sum(1)[None, :] + (q_points[asks] ** 2).sum(1)[:, None] - 2 * (q_points[asks] @ at.T)
            good = (gap <= limit[some, None] * (1 + 1e-9)) & (ids[part][None, :] != q_ids[asks, None])
            verified += int(good.sum())
            # products sort out what is clearly below the k-th score; scores themselves are always summed in the same way
            good &= q_vectors[asks] @ vectors[part].T >= (kth[asks] - 1e-9 * (1 + np.abs(np.where(kth[asks] == -np.inf, 0, kth[asks]))))[:, None]
            q, r = np.nonzero(good)
            q, r = asks[q], part[r]
            new.append((q, ids[r], (vectors[r] * q_vectors[q]).sum(1)))
        q, i, score = (np.concatenate([f, *c]) for f, c in zip(found, zip(*new)))
        keep = score >= floor[q]
        q, i, score = q[keep], i[keep], score[keep]
        sort = np.lexsort((i, -score, q))
        q, i, score = q[sort], i[sort], score[sort]
        groups, starts, ends = _runs(q)
        rank = np.arange(len(q)) - np.repeat(starts, ends - starts)
        found = [v[rank < k] for v in (q, i, score)]
        full = ends - starts >= k
        kth[groups[full]] = np.maximum(kth[groups[full]], score[starts[full] + k - 1])
    return (*found, verified)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of each run of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    starts, ends = np.concatenate([[0], edges])[: len(values)].astype(np.int64), np.concatenate([edges, [len(values)]]).astype(np.int64)
    return values[starts], starts, ends[: len(starts)]


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(vector: Column, size: int) -> Column:
    """Of the length, without nulls and non-finite components, and not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == size) & good & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, queries: Column, k: int = K, confidence: float = CONFIDENCE, dims: int = DIMS, seed: int = SEED, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows for which ``queries`` holds, against all rows."""
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    plain = plain.where("id is not null and v is not null")
    common = plain.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None or not common["size"]:
        return spark.createDataFrame([], result)
    size = common["size"]
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    usable = plain.where(_usable(F.col("v"), size))
    known = usable.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm2")).first()
    if not known["n"]:
        return spark.createDataFrame([], result)
    n, norm2, quantile = known["n"], known["norm2"] * (1 + 1e-12), chi_square_quantile(confidence, dims)
    weights = projection(size + 1, dims, seed)
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(n / BLOCK)))))

    def projected(vectors: np.ndarray, augmented: bool) -> np.ndarray:
        out = vectors @ weights[:-1]
        if augmented:
            out += np.sqrt(np.maximum(norm2 - (vectors * vectors).sum(1), 0))[:, None] * weights[-1]
        return out

    # sampled by hash: projections of at most about SAMPLE rows (13 MB), whatever the number of rows
    share = min(1.0, SAMPLE / n)
    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(2 * SAMPLE) if depth else usable.select("v").limit(1)

    def shadows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(0))
            if len(vectors):
                yield pa.RecordBatch.from_arrays([pa.array(list(projected(vectors, True)))], ["p"])

    sample = _matrix(drawn.mapInArrow(shadows, "p array<double>").toArrow()["p"].combine_chunks())
    tree = split_tree(sample if len(sample) else np.zeros((1, dims)), depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            if len(vectors):
                p = projected(vectors, True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(p)), pa.array(cells_of(p, tree, depth))], ["id", "v", "p", "cell"])

    located = stage(usable.select("id", "v").mapInArrow(placed, "id long, v array<double>, p array<double>, cell long"), "ann-rows")
    extent = [f(F.col("p")[d]).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d in range(dims)]
    boxes = located.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *extent).orderBy("cell").collect()
    cells = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{x}{d}"] for d in range(dims)] for b in boxes]) for x in ("low", "high"))
    blocks = np.array([-(-b["n"] // BLOCK) for b in boxes])

    asked = stage(usable.where("asks").groupBy("id").agg(F.min("v").alias("v")), "ann-queries")

    def visits(start: int, stop: int):
        """Rows (block, id, v, kth): the query's nearest cells from ``start`` to ``stop``, less those that the test excludes."""

        def to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    vectors = _matrix(some.column(1))
                    if not len(vectors):
                        continue
                    gap = _box_distance(projected(vectors, False), low, high)
                    kth = some.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    limit = np.where(kth == -np.inf, np.inf, np.maximum(norm2 + (vectors * vectors).sum(1) - 2 * kth, 0) * quantile)
                    near = np.argsort(gap, axis=1, kind="stable")[:, start:stop]
                    row, place = np.nonzero(np.take_along_axis(gap, near, 1) <= limit[:, None])
                    cell = near[row, place]
                    many = blocks[cell]
                    row, cell = np.repeat(row, many), np.repeat(cell, many)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    at_row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[cell]), pa.array(block), some.column(0).take(at_row), some.column(1).take(at_row), pa.array(kth[row])], ["cell", "block", "id", "v", "kth"])

        return to

    of_cell = dict(zip(cells.tolist(), blocks.tolist()))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            many = np.array([of_cell[c] for c in batch.column(3).to_pylist()], np.int64)
            # by id and place, so that rows of one id are cut into blocks too; a query that visits a cell visits all its blocks
            ids = batch.column(0).to_numpy().view(np.uint64) + np.arange(seen, seen + batch.num_rows, dtype=np.uint64)
            seen += batch.num_rows
            mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array((mixed % many.astype(np.uint64)).astype(np.int64)), *batch.columns[:3]], ["cell", "block", "id", "v", "p"])

    held = located.mapInArrow(blocked, "cell long, block long, id long, v array<double>, p array<double>")

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if left.num_rows and right.num_rows:
            values = lambda t, c: _matrix(t[c].combine_chunks())
            vectors = values(right, "v")
            mine = left["id"].to_numpy(), values(left, "v"), values(left, "p")
            asks = right["id"].to_numpy(), vectors, projected(vectors, False), right["kth"].fill_null(-np.inf).to_numpy()
            places, *rest, _ = search_block(mine, asks, k, norm2, quantile)
            out = [asks[0][places], *rest]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    def round_(sent: DataFrame) -> DataFrame:
        sent = stage(sent, "ann-visits")
        # a block that many queries visit is searched in several chunks of them
        often = stage(sent.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("many")).where("many > 1"), "ann-often")
        keys = F.broadcast(often) if often.count() <= OFTEN_SENT else often
        many = F.coalesce("many", F.lit(1))
        mine = held.join(keys, ["cell", "block"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), many - 1))).drop("many")
        asks = sent.join(keys, ["cell", "block"], "left").withColumn("chunk", F.pmod(F.xxhash64("id"), many).cast("int")).drop("many")
        columns = ["cell", "block", "chunk"]
        return mine.groupBy(*columns).cogroup(asks.groupBy(*columns)).applyInArrow(searched, "query_id long, vec_id long, score double")

    sends = "cell long, block long, id long, v array<double>, kth double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, start, stop = None, 0, 1
    while start < len(cells):
        kth = F.lit(None).cast("double").alias("kth")
        if best is None:
            asks = asked.select("id", "v", kth)
        else:
            known_kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            asks = asked.join(known_kth, "id", "left").select("id", "v", "kth")
        found = round_(asks.mapInArrow(visits(start, stop), sends))
        found = found if best is None else found.union(best.drop("rank"))
        last, best = best, stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-best")
        if last is not None:
            unstage(last)
        start, stop = stop, stop * (1 + GROWTH)
    return best.select("query_id", "rank", "vec_id", "score")
