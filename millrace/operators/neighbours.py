"""Radius joins, kd partitions, density clustering, nearest centres and self-organising maps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import ranked
from ..functions.storage import checkpointed


def _square(points: list[str], left: str, right: str) -> Column:
    total = F.lit(0.0)
    for p in points:
        gap = F.col(f"{left}.{p}") - F.col(f"{right}.{p}")
        total = total + gap * gap
    return total


#: rows of a cell that meet the rows around them in one task
CROWD = 4096


def _celled(df: DataFrame, points: list[str], eps: float) -> tuple[DataFrame, list[str]]:
    """Rows with the number of their cell of width eps along each dimension, and the names of these columns. Rows with a null are left out."""
    names = [f"_c{i}" for i in range(len(points))]
    known = df.na.drop("any", subset=points)
    return known.withColumns({n: F.floor(F.col(p) / eps).cast("long") for n, p in zip(names, points)}), names


def _widened(df: DataFrame, names: list[str]) -> DataFrame:
    """Each row in its own cell and all cells that touch it."""
    shifts = F.array(*[F.struct(*[F.lit(s).alias(n) for n, s in zip(names, step)]) for step in product((-1, 0, 1), repeat=len(names))])
    return df.withColumn("_s", F.explode(shifts)).withColumns({n: F.col(n) + F.col(f"_s.{n}") for n in names}).drop("_s")


def _meet(left: DataFrame, right: DataFrame, on: list[str], near: Column) -> DataFrame:
    """Pairs of ``l`` and ``r`` rows of one cell that are ``near``, by sorted runs: neither side is sent whole to the driver or to a task.

    Rows ``l`` of a cell with more than ``CROWD`` are dealt to parts that ``r`` rows all go to, so pairs of a crowded cell are spread over tasks. The
    table of these cells has at most a row for each ``CROWD`` rows.
    """
    crowds = left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(F.broadcast(crowds), on, "left").withColumn("_part", F.pmod(F.xxhash64("_key"), parts).cast("int")).drop("_parts")
    copies = right.join(F.broadcast(crowds), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    same = F.lit(True)
    for n in [*on, "_part"]:
        same = same & (F.col(f"l.{n}") == F.col(f"r.{n}"))
    return dealt.alias("l").join(copies.alias("r").hint("merge"), same & near)


def radius_pairs(df: DataFrame, key: str, points: list[str], eps: float) -> DataFrame:
    """``(a, b, distance)`` of rows nearer than eps, each row with itself included.

    Rows meet in cells of width eps: one side goes to its own cell, the other to the neighbouring cells too (:func:`_meet`). It is meant for
    few dimensions (a row goes to 3^d cells), and a radius with few rows in a cell: all pairs are the result.
    """
    placed, cells = _celled(df.select(F.col(key).alias("_key"), *[F.col(p).cast("double").alias(p) for p in points]), points, eps)
    met = _meet(placed, _widened(placed, cells), cells, _square(points, "l", "r") < eps * eps)
    return met.select(F.col("l._key").alias("a"), F.col("r._key").alias("b"), F.sqrt(_square(points, "l", "r")).alias("distance"))


def _placed(df: DataFrame, key: str, points: list[str], eps: float) -> DataFrame:
    """Rows ``(_key, *points, cell)`` in cells with sides just under eps / sqrt(d): rows of one cell are all nearer than eps. Rows with a null are left out."""
    side = eps / len(points) ** 0.5 * (1 - 1e-9)
    known = df.select(F.col(key).alias("_key"), *[F.col(p).cast("double").alias(p) for p in points]).na.drop("any")
    return known.withColumn("cell", F.array(*[F.floor(F.col(p) / side).cast("long") for p in points]))


def _around(points: list[str]) -> Column:
    """The cells that may hold rows nearer than eps to a row of ``cell``."""
    reach = int(len(points) ** 0.5 * (1 + 1e-6)) + 1
    shifts = F.array(*[F.array(*[F.lit(s) for s in step]) for step in product(range(-reach, reach + 1), repeat=len(points))])
    return F.explode(F.transform(shifts, lambda s: F.zip_with("cell", s, lambda c, d: c + d)))


def crowded(df: DataFrame, key: str, points: list[str], eps: float, least: int) -> DataFrame:
    """Rows ``(_key, *points, cell, crowded)``: whether at least ``least`` rows, itself included, are nearer than eps.

    A cell of at least that many rows settles all of its rows. Only rows of smaller cells meet the rows around them, so a row is
    compared with fewer than ``least`` rows of each cell around it: the work is linear in rows, however dense the cells are.
    """
    placed = checkpointed(_placed(df, key, points, eps))
    sized = checkpointed(placed.join(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")), "cell"))
    few = sized.where(F.col("_n") < least).select(F.col("_key").alias("_a"), *points, _around(points).alias("cell")).alias("l")
    met = few.join(placed.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (_square(points, "l", "r") < eps * eps))
    enough = met.groupBy("_a").count().where(F.col("count") >= least).select(F.col("_a").alias("_key"), F.lit(True).alias("_enough"))
    return sized.join(enough, "_key", "left").select("_key", *points, "cell", ((F.col("_n") >= least) | F.coalesce("_enough", F.lit(False))).alias("crowded"))


def _boxes(rows: DataFrame, points: list[str], by: list[str]) -> DataFrame:
    extent = [f(p).alias(f"{p}_{n}") for p in points for n, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.struct(*extent).alias("box"))


def _box_gap(points: list[str], furthest: bool) -> Column:
    """Squared distance of the nearest or furthest places of boxes ``a`` and ``b``."""
    total = F.lit(0.0)
    for p in points:
        one, two = F.col(f"a.{p}_low") - F.col(f"b.{p}_high"), F.col(f"b.{p}_low") - F.col(f"a.{p}_high")
        gap = F.greatest(-one, -two) if furthest else F.greatest(one, two, F.lit(0.0))
        total = total + gap * gap
    return total


def _cell_links(cores: DataFrame, points: list[str], eps: float, direct: int = 1024, levels: int = 40) -> DataFrame:
    """``(x, y)``: cells, named by their smallest row, of which some rows are nearer than eps; both directions.

    Boxes of rows settle most pairs of cells: within eps even where furthest, or not even where nearest. Others are cut in halves along each
    dimension and looked at again, until their rows make few pairs; then these are compared. Cells with many rows thus never give all pairs.
    """
    first = cores.groupBy("cell").agg(F.min("_key").alias("by"))
    cores = checkpointed(cores.join(first, "cell"))
    whole = checkpointed(_boxes(cores, points, ["by", "cell"]))
    side = eps / len(points) ** 0.5 * (1 - 1e-9)
    left = whole.select(F.col("by").alias("x"), F.col("box").alias("a"), F.col("n").alias("n_a"), F.col("cell").alias("cut_a"), _around(points).alias("cell"))
    open_ = left.join(whole.select(F.col("by").alias("y"), F.col("box").alias("b"), F.col("n").alias("n_b"), "cell", F.col("cell").alias("cut_b")), "cell").where("x < y").drop("cell")
    found = None
    for level in range(1, levels + 1):
        met = checkpointed(open_.where(_box_gap(points, False) < eps * eps).withColumn("sure", _box_gap(points, True) < eps * eps))
        sure = met.where("sure").select("x", "y").distinct()
        rest = met.join(sure, ["x", "y"], "left_anti")
        small = (F.col("n_a") * F.col("n_b") <= direct) | F.lit(level == levels)
        # few pairs of rows, or boxes that halves no longer part: compare rows
        cut = lambda k: F.array(*[F.floor(F.col(p) / (side / 2**k)).cast("long") for p in points])
        rows = checkpointed(cores.withColumn("cut", cut(level - 1)))
        near = rest.where(small).select("x", "y", "cut_a", "cut_b").join(rows.select(F.col("by").alias("x"), F.col("cut").alias("cut_a"), F.struct(*points).alias("l")), ["x", "cut_a"])
        near = near.join(rows.select(F.col("by").alias("y"), F.col("cut").alias("cut_b"), F.struct(*points).alias("r")), ["y", "cut_b"]).where(_square(points, "l", "r") < eps * eps)
        made = checkpointed(sure.union(near.select("x", "y")).distinct())
        found = made if found is None else found.union(made)
        rest = checkpointed(rest.where(~small).join(made, ["x", "y"], "left_anti").select("x", "y", "cut_a", "cut_b"))
        if rest.isEmpty():
            break
        finer = checkpointed(_boxes(rows.withColumn("finer", cut(level)), points, ["by", "cut", "finer"]))
        open_ = rest.join(finer.select(F.col("by").alias("x"), F.col("cut").alias("cut_a"), F.col("finer").alias("f_a"), F.col("box").alias("a"), F.col("n").alias("n_a")), ["x", "cut_a"])
        open_ = open_.join(finer.select(F.col("by").alias("y"), F.col("cut").alias("cut_b"), F.col("finer").alias("f_b"), F.col("box").alias("b"), F.col("n").alias("n_b")), ["y", "cut_b"])
        open_ = open_.drop("cut_a", "cut_b").withColumnsRenamed({"f_a": "cut_a", "f_b": "cut_b"})
    return found.select("x", "y").union(found.select(F.col("y").alias("x"), F.col("x").alias("y")))


def density_clusters(df: DataFrame, key: str, points: list[str], eps: float, least: int) -> DataFrame:
    """``(key, cluster)``: cores have ``least`` rows nearer than eps; clusters are numbered from 1 by their smallest core.

    Links between cells are contracted in ranges of cells first, then across them (:func:`min_labels`).
    A row that is no core takes the largest number among the cores near it, or -1; so does a row with a null. No step lists the pairs of a
    dense cell: see :func:`crowded` and :func:`_cell_links`.
    """
    rows = checkpointed(crowded(df, key, points, eps, least))
    cores = rows.where("crowded").drop("crowded")
    stands = checkpointed(cores.groupBy("cell").agg(F.min("_key").alias("by")))
    own = stands.select(F.col("by").alias("a"), F.col("by").alias("b"))
    links = checkpointed(_cell_links(cores, points, eps).select(F.col("x").alias("a"), F.col("y").alias("b")).union(own).distinct())
    # links of neighbouring cells meet in one task, where they are contracted
    roots = min_labels(links.join(stands.select(F.col("by").alias("a"), "cell"), "a").repartitionByRange("cell"))
    numbered = ranked(roots.select("root").distinct(), [], ["root"], "cluster")
    cells = checkpointed(stands.join(roots, F.col("by") == F.col("node")).join(numbered, "root").select("cell", "cluster"))
    inner = rows.where("crowded").join(cells, "cell")
    edge = rows.where("not crowded").select(F.col("_key").alias("_a"), *points, _around(points).alias("cell")).alias("l")
    border = edge.join(inner.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (_square(points, "l", "r") < eps * eps)).groupBy("_a").agg(F.max("cluster").alias("cluster"))
    found = inner.select("_key", "cluster").union(border).withColumnRenamed("_key", "_found")
    return df.select(key).join(found, F.col(key) == F.col("_found"), "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


#: links that a task of :func:`local_stars` contracts at once
HELD = 1 << 20


def _star(links: pd.DataFrame) -> pd.DataFrame:
    """``(a, b)``: each node of the links with the smallest node that it reaches through them; trees are hooked at their roots and flattened."""
    nodes, ends = np.unique(np.concatenate([links["a"].to_numpy(), links["b"].to_numpy()]), return_inverse=True)
    one, two = ends[: len(links)], ends[len(links) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[one], label[two]
        if (x == y).all():
            return pd.DataFrame({"a": nodes, "b": nodes[label]})
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def local_stars(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` contracted within each task: a link from each of its nodes to the smallest that the task's links reach. Components stay the same.

    A task holds at most ``HELD`` links and a batch; it then gives their stars and starts anew.
    """
    def contract(frames):
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= HELD:
                yield _star(pd.concat(held))
                held, n = [], 0
        if held:
            yield _star(pd.concat(held))

    return links.mapInPandas(contract, links.schema)


def min_labels(links: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each node of links ``(a, b)`` reaches, in either direction.

    Links are contracted within tasks first; those that lie near each other in the table merge there, without a shuffle. What joins tasks is settled by rounds of
    contraction: each node points to the least of itself and its neighbours, pointers are followed to their ends by doubling, and links between different ends
    are the links of the next round, which has half as many nodes at most. Every round is written, so a lost executor costs one step.
    """
    stars = checkpointed(local_stars(links.select("a", "b").where("a is not null and b is not null")))
    left, roots = stars.union(stars.select("b", "a")), None
    while True:
        ends = left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        moved = True
        while moved:
            # three steps of doubling a write: chains of eight pointers
            far = _hop(_hop(_hop(checkpointed(ends).withColumn("first", F.col("root")))))
            ends = checkpointed(far.select("node", "root", (F.col("root") != F.col("first")).alias("moved")))
            moved, ends = not ends.where("moved").isEmpty(), ends.select("node", "root")
        roots = ends if roots is None else checkpointed(_hop(roots, ends))
        at = lambda end: ends.select(F.col("node").alias(end), F.col("root").alias(f"at_{end}"))
        met = left.join(at("a"), "a").join(at("b"), "b").where("at_a < at_b").select(F.col("at_a").alias("a"), F.col("at_b").alias("b")).distinct()
        stars = checkpointed(local_stars(met))
        if stars.isEmpty():
            return roots
        left = stars.union(stars.select("b", "a"))


def _hop(pointers: DataFrame, along: DataFrame | None = None) -> DataFrame:
    """Each root of ``pointers`` moved on to its own root in ``along`` (else in ``pointers``), where it has one."""
    on = (pointers if along is None else along).select(F.col("node").alias("root"), F.col("root").alias("_next"))
    return pointers.join(on, "root", "left").withColumn("root", F.coalesce("_next", "root")).drop("_next")


def outlier_test(df: DataFrame, key: str, points: list[str], eps: float, least: int) -> DataFrame:
    """Whether a row has at most ``least`` rows nearer than eps (itself included)."""
    return crowded(df, key, points, eps, least + 1).select(F.col("_key").alias(key), (~F.col("crowded")).alias("outlier"))


def kd_leaves(df: DataFrame, key: str, points: list[str], depth: int, seed: int | None = None) -> DataFrame:
    """``(key, *points, node)``: heap-numbered nodes; level d splits dimension d mod m at half of a node's rows, ties by key.

    With ``seed`` each node splits a dimension drawn by a hash of its number instead.
    """
    out = checkpointed(df.select(key, *points)).withColumn("node", F.lit(0))
    for d in range(depth):
        drawn = F.lit(d % len(points)) if seed is None else F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(len(points))).cast("int")
        out = out.withColumn("_v", F.get(F.array(*points), drawn))
        # only the order of values is written at a level; the last row of a node's lower half says where each row goes
        placed = ranked(out.select("node", "_v", key), ["node"], ["_v", key], "_place")
        sizes = placed.groupBy("node").agg(F.floor(F.max("_place") / 2).alias("_half"))
        cuts = checkpointed(placed.join(F.broadcast(sizes), "node").where(F.col("_place") == F.col("_half")).select("node", F.struct("_v", F.col(key).alias("_key")).alias("_cut")))
        high = F.coalesce((F.struct("_v", F.col(key).alias("_key")) > F.col("_cut")).cast("int"), F.lit(1))
        out = out.join(F.broadcast(cuts), "node", "left").withColumn("node", F.col("node") * 2 + 1 + high).drop("_cut", "_v").select(key, *points, "node")
    return checkpointed(out)


def principal_points(df: DataFrame, key: str, points: list[str]) -> DataFrame:
    """``(key, *points)`` with the points turned to their principal axes, widest first: what :func:`kd_leaves` splits then follows the spread.

    The axes come from one aggregate of the covariances; each is turned so that its largest component is positive. Rows with a null point are
    left out; no rows give no rows. Distances between rows stay as they are.
    """
    known = df.select(key, *[F.col(p).cast("double").alias(p) for p in points]).na.drop(subset=points)
    pairs = [(i, j) for i in range(len(points)) for j in range(i + 1)]
    found = known.agg(*[F.covar_pop(points[i], points[j]).alias(f"c_{i}_{j}") for i, j in pairs]).first()
    if found["c_0_0"] is None:
        return known
    spread = np.zeros((len(points), len(points)))
    for i, j in pairs:
        spread[i, j] = spread[j, i] = found[f"c_{i}_{j}"]
    axes = np.linalg.eigh(spread)[1][:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(points))])
    turned = [sum((F.col(p) * float(w) for p, w in zip(points, axis)), F.lit(0.0)) for axis in axes.T]
    return known.select(key, *[column.alias(p) for column, p in zip(turned, points)])


def leaf_profile(leaves: DataFrame, points: list[str]) -> DataFrame:
    """Rows and mean squared distance of all pairs of a leaf (a row with itself included): twice the summed variances, no pairs are formed."""
    spread = F.lit(0.0)
    for p in points:
        spread = spread + F.var_pop(p)
    return leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"), (2 * spread).alias("mean_square"))


def leaf_boxes(leaves: DataFrame, points: list[str]) -> DataFrame:
    return leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[f(p).alias(f"{p}_{n}") for p in points for n, f in (("low", F.min), ("high", F.max))])


#: Leaves whose boxes :func:`tree_radius` sends to every task.
BOXES_SENT = 4096


def _in_cells(rows: DataFrame, queries: DataFrame, key: str, points: list[str], eps: float, within: list[str]) -> DataFrame:
    """``(query, key, distance)`` of ``rows`` and ``queries`` ``(_q, *points)`` nearer than eps, of equal ``within``: they meet in cells of width eps (:func:`_meet`)."""
    placed, cells = _celled(rows.select(F.col(key).alias("_key"), *[F.col(p).cast("double").alias(p) for p in points], *within), points, eps)
    asked, _ = _celled(queries.select("_q", *[F.col(p).cast("double").alias(p) for p in points], *within), points, eps)
    met = _meet(placed, _widened(asked, cells), [*within, *cells], _square(points, "l", "r") < eps * eps)
    return met.select(F.col("r._q").alias("query"), F.col("l._key").alias(key), F.sqrt(_square(points, "l", "r")).alias("distance"))


def tree_radius(leaves: DataFrame, queries: DataFrame, key: str, query: str, points: list[str], eps: float) -> DataFrame:
    """``(query, key, distance)`` of rows nearer than eps to each query: leaves whose boxes the ball may touch are visited, others are not.

    Up to ``BOXES_SENT`` boxes are broadcast; in a leaf, its rows and visits meet in cells of width eps, so a visit does not see the whole of a leaf. For more boxes than
    that rows and queries meet in such cells alone, which gives the same pairs.
    """
    asked = queries.select(F.col(query).alias("_q"), *[F.col(p).cast("double").alias(p) for p in points])
    boxes = checkpointed(leaf_boxes(leaves, points).drop("n"))
    if boxes.count() > BOXES_SENT:
        return _in_cells(leaves, asked, key, points, eps, [])
    gap = F.lit(0.0)
    for p in points:
        outside = F.greatest(F.col(f"{p}_low") - F.col(p), F.col(p) - F.col(f"{p}_high"), F.lit(0.0))
        gap = gap + outside * outside
    visits = asked.join(F.broadcast(boxes), gap < eps * eps).select(*asked.columns, "node")
    return _in_cells(leaves, visits, key, points, eps, ["node"])


def leaf_radius(leaves: DataFrame, key: str, points: list[str], eps: float) -> DataFrame:
    """``(query, key, distance)``: for each row the rows of its own leaf nearer than eps, itself included; other leaves are not visited.

    Within a leaf rows meet in cells of width eps, so a leaf's pairs are those of neighbouring cells only.
    """
    return _in_cells(leaves, leaves.withColumn("_q", F.col(key)), key, points, eps, ["node"])


def square_distance(vector: Column, centre: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def nearest_centre(vector: Column, centres: list[list[float]]) -> Column:
    """The number of the nearest centre, the first of equals; centres are constants of the plan."""
    return F.array_min(F.array(*[F.struct(square_distance(vector, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]


def lloyd(df: DataFrame, vector: str, centres: list[list[float]], rounds: int) -> list[list[float]]:
    """K-means from given centres: in a round each task sums its vectors by nearest centre, the first of equals, and K rows are gathered; an empty cluster keeps its centre.

    Vectors of another length than the centres, or with a component that is null or not finite, are left out. The plan holds no centres, so rounds share its code.
    """
    m, at = len(centres[0]), np.array(centres, float)
    plain = df.select(F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == m) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(at)), np.zeros_like(at)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            near = np.stack([((x - c) ** 2).sum(1) for c in at], 1).argmin(1)
            n += np.bincount(near, minlength=len(at))
            np.add.at(sums, near, x)
        hit = np.flatnonzero(n)
        places = [pa.array(n[hit]), *[pa.array(column) for column in sums[hit].T]]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), *places], ["i", "n", *[f"s{j}" for j in range(m)]])

    for _ in range(rounds):
        rows = plain.mapInArrow(partial, "i int, n double, " + ", ".join(f"s{j} double" for j in range(m)))
        found = rows.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(m)]).collect()
        new = {r["i"]: [r[f"s{j}"] / r["n"] for j in range(m)] for r in found}
        centres = [new.get(i, c) for i, c in enumerate(centres)]
        at = np.array(centres, float)
    return centres


def kmeans(df: DataFrame, vector: str, key: str, k: int, rounds: int = 100, least: float = 1e-6, seed: int = 42) -> list[list[float]]:
    """Centres of k-means: from ``k`` distinct vectors with the lowest hashes of ``key``, rounds until no centre moves further than ``least``.

    Fewer distinct vectors than ``k`` give as many centres; null vectors are left out. The driver holds the centres.
    """
    known = checkpointed(df.where(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), F.col(vector).cast("array<double>").alias(vector)))
    first = known.groupBy(vector).agg(F.min("h").alias("h")).orderBy("h", vector).limit(k)
    centres = [list(r[vector]) for r in first.collect()]
    for _ in range(rounds if centres else 0):
        new = lloyd(known, vector, centres, 1)
        moved = max(sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5 for x, y in zip(centres, new))
        centres = new
        if moved <= least:
            break
    return centres


def som_round(df: DataFrame, vector: str, weights: list[list[float]], width: int, sigma: float) -> list[list[float]]:
    """One batch round of a self-organising map: each neuron becomes the mean of all vectors, weighted by grid distance to their neuron.

    Sums by winning neuron are one aggregate; the neighbourhood then mixes these few rows.
    """
    m = len(weights[0])
    near = df.select(nearest_centre(F.col(vector), weights).alias("i"), vector)
    rows = near.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(vector)[j]).alias(f"s{j}") for j in range(m)]).collect()
    n, sums = np.zeros(len(weights)), np.zeros((len(weights), m))
    for r in rows:
        n[r["i"]], sums[r["i"]] = r["n"], [r[f"s{j}"] for j in range(m)]
    grid = np.array([divmod(i, width) for i in range(len(weights))], float)
    h = np.exp(-((grid[:, None] - grid[None]) ** 2).sum(2) / sigma**2)
    mass = h @ n
    return np.where(mass[:, None] > 0, (h @ sums) / np.maximum(mass, 1e-300)[:, None], weights).tolist()
