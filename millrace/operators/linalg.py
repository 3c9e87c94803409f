"""Linear algebra on tall tables: moments by one aggregate of the executors, small matrices on the driver.

The aggregate is m x m numbers for m features, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import checkpointed


def moments(df: DataFrame, vector: str, label: str | None = None) -> dict[float, tuple[int, np.ndarray, np.ndarray]]:
    """By label (or 0): number of rows, sum and Gram matrix. Each partition gives one row a label; sums combine in the shuffle.

    Rows with a null label, vector or component, and vectors of another length than most of the table, are left out; no rows give no labels.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, float], list] = {}
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                x = batch.column(1).filter(pa.array(sizes == size)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                own_labels = labels[sizes == size]
                for v in np.unique(own_labels).tolist():
                    own = x[own_labels == v]
                    old = held.setdefault((size, v), [0, 0.0, 0.0])
                    held[size, v] = [old[0] + len(own), old[1] + own.sum(0), old[2] + own.T @ own]
        rows = [(size, v, i, float(a)) for (size, v), (n, s, g) in held.items() for i, a in enumerate([n, *np.ravel(s), *np.ravel(g)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.float64()))], ["size", "label", "i", "a"])

    plain = df.select((F.col(label) if label else F.lit(0)).cast("double").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    plain = plain.where("label is not null and size(v) > 0 and not exists(v, x -> x is null)")
    sums = plain.mapInArrow(partial, "size long, label double, i long, a double").groupBy("size", "label", "i").agg(F.sum("a").alias("a")).collect()
    rows_of: dict[int, float] = {}
    for r in sums:
        if r["i"] == 0:
            rows_of[r["size"]] = rows_of.get(r["size"], 0.0) + r["a"]
    if not rows_of:
        return {}
    m = max(rows_of, key=lambda size: (rows_of[size], -size))
    values: dict[float, np.ndarray] = {}
    for r in sums:
        if r["size"] == m:
            values.setdefault(r["label"], np.zeros(1 + m + m * m))[r["i"]] = r["a"]
    return {v: (int(own[0]), own[1 : m + 1], own[m + 1 :].reshape(m, m)) for v, own in values.items()}


def gram(df: DataFrame, vector: str) -> np.ndarray:
    """The Gram matrix of the components; 0 x 0 without rows."""
    found = moments(df, vector)
    return next(iter(found.values()))[2] if found else np.zeros((0, 0))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest component is positive."""
    if not vectors.size:
        return vectors
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def svd(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and right vectors, from the Gram matrix; none without rows."""
    values, vectors = np.linalg.eigh(gram(df, vector))
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0)), _signed(vectors[:, order])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        if len(sizes):
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


def tall_factor(rows: DataFrame, weights: np.ndarray, meet: int = 32) -> np.ndarray:
    """The triangular factor of a QR of (rows times ``weights``): a factor for each task, then of ``meet`` factors at a time until one is left.

    ``rows`` has one column of vectors of one length. Only factors, ``l`` x ``l`` numbers, leave a task.
    """
    width = weights.shape[1]

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for x in _blocks(batches):
            r = np.linalg.qr(np.vstack([r, x @ weights]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    def joined(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.vstack([np.array(x.as_py()).reshape(-1, width) for x in table["r"]]), mode="r")
        return pa.table({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64())), "task": table["task"][:1]})

    factors = checkpointed(rows.mapInArrow(factored, "r array<double>").withColumn("task", F.spark_partition_id().cast("long")))
    count = factors.count()
    while count > 1:
        groups = factors.withColumn("task", F.expr(f"task div {meet}")).groupBy("task")
        factors = checkpointed(groups.applyInArrow(joined, "r array<double>, task long"))
        count = factors.count()
    found = factors.head()
    return np.array(found["r"]).reshape(-1, width) if found else np.zeros((0, width))


def cross_product(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Transposed rows times (rows times ``weights``): a sum of one matrix for each task, added up in the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.shape)
        for x in _blocks(batches):
            total += x.T @ (x @ weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "a"])

    sums = rows.mapInArrow(partial, "i long, a double").groupBy("i").agg(F.sum("a").alias("a")).collect()
    out = np.zeros(weights.size)
    for r in sums:
        out[r["i"]] = r["a"]
    return out.reshape(weights.shape)


def _orthonormal(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """``weights`` changed so that (rows times weights) has orthonormal columns and the same range; directions without rows go."""
    for _ in range(2):  # the second pass takes out what rounding left of the first
        _, sizes, turned = np.linalg.svd(tall_factor(rows, weights), full_matrices=False)
        keep = sizes > (sizes[0] if len(sizes) else 0.0) * 1e-13
        weights = weights @ (turned[keep].T / sizes[keep])
    return weights


def randomised_svd(df: DataFrame, vector: str, k: int, power: int = 2, over: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`svd`, from the rows themselves: a Gaussian sketch of ``k + over`` columns, ``power`` steps and a projection on the blocks of all steps.

    The sketch's range is made orthonormal by tree-reduced QR of row blocks, so singular values are as exact as those of the table, where the Gram matrix squares its
    condition. A pass over rows costs rows times m times (k + over), the last one (power + 1) times as much or m; tasks send as many columns of m numbers. Rows with nulls or of another length than most are left out.
    """
    plain = df.select(F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0 and not exists(v, x -> x is null)")
    sizes = plain.groupBy(F.size("v").alias("m")).count().orderBy(F.desc("count"), "m").head()
    if sizes is None:
        return np.zeros(0), np.zeros((0, 0))
    m = sizes["m"]
    rows = checkpointed(plain.where(F.size("v") == m))
    blocks = [np.random.default_rng(seed).normal(size=(m, min(k + over, m)))]
    for _ in range(power):
        blocks.append(np.linalg.qr(cross_product(rows, _orthonormal(rows, blocks[-1])))[0])
    # the blocks of all steps together: with a flat spectrum the last one alone needs many more steps
    weights = np.linalg.qr(np.hstack(blocks))[0][:, :m]
    vectors, values, _ = np.linalg.svd(cross_product(rows, _orthonormal(rows, weights)), full_matrices=False)
    return values[:k], _signed(vectors[:, :k])


def discriminant(df: DataFrame, vector: str, label: str, method: str = "eig") -> np.ndarray:
    """The unit direction that separates labels +1 and -1.

    ``eig`` solves with the within-class scatter. ``twostage`` first whitens by the within-class scatter's own axes (those without variance
    go), then takes the leading axis of the between-class scatter there. ``svd`` does the second stage in the axes of the total
    scatter. ``qrsvd`` goes there from a basis of the total scatter's leading axis and a pivoted QR of what it leaves of the class means.
    ``srda`` solves least squares on class indicators. For two classes all give the same direction, but for axes without variance.
    """
    found = moments(df, vector, label)
    if set(found) != {1.0, -1.0}:
        raise ValueError("labels +1 and -1 are needed")
    (n1, s1, g1), (n0, s0, g0) = found[1.0], found[-1.0]
    within = g1 + g0 - np.outer(s1, s1) / n1 - np.outer(s0, s0) / n0
    between = s1 / n1 - s0 / n0
    total = within + n1 * n0 / (n1 + n0) * np.outer(between, between)
    if method == "eig":
        w = np.linalg.solve(within + 1e-12 * np.trace(within) * np.eye(len(within)), between)
    elif method == "twostage":
        w = _second_stage(within, between)
    elif method == "svd":
        w = _second_stage(total, between)
    elif method == "qrsvd":
        basis = _pivoted_basis(np.linalg.eigh(total)[1][:, -1], np.column_stack([s1 / n1, s0 / n0]) - ((s1 + s0) / (n1 + n0))[:, None])
        w = basis @ _second_stage(basis.T @ total @ basis, basis.T @ between)
    elif method == "srda":
        w = np.linalg.lstsq(total, between * n1 * n0 / (n1 + n0), rcond=None)[0]
    else:
        raise ValueError("method is one of eig, twostage, svd, qrsvd, srda")
    return w / np.linalg.norm(w)


def _second_stage(scatter: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The leading direction of the between-class scatter once ``scatter`` is whitened, in the vectors' own space; turned along ``between``."""
    values, axes = np.linalg.eigh(scatter)
    good = values > 1e-12 * values.max()
    whiten = axes[:, good] / np.sqrt(values[good])
    moved = whiten.T @ between
    lead = np.linalg.eigh(np.outer(moved, moved))[1][:, -1]
    return whiten @ lead * (1 if lead @ moved >= 0 else -1)


def _pivoted_basis(lead: np.ndarray, means: np.ndarray) -> np.ndarray:
    """An orthonormal basis: ``lead``, then the columns of ``means`` and of the identity less what comes before, longest remainder first."""
    basis = [lead]
    for group in (means, np.eye(len(lead))):
        rest = group - np.column_stack(basis) @ (np.column_stack(basis).T @ group)
        while rest.size and len(basis) < len(lead):
            longest = int(np.argmax((rest**2).sum(0)))
            if (rest[:, longest] ** 2).sum() <= 1e-16 * max((group**2).sum(), 1e-300):
                break
            axis = rest[:, longest] / np.linalg.norm(rest[:, longest])
            basis.append(axis)
            rest = rest - np.outer(axis, axis @ rest)
    return np.column_stack(basis)


def transform(vector: Column, directions: list[list[float]]) -> Column:
    """``vector`` projected to each of ``directions``: an array with one number a direction, as expressions of the plan."""
    dot = lambda w: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.array(*map(dot, directions))
