"""Tree ensembles as tables of nodes: predictions of every prefix of trees, and Shapley values of features.

A fitted model of ``pyspark.ml`` is read back from its own writer's node table; the arrays (some dozen bytes a node) go to the tasks, and rows stay where they are.

**Shapley values** are the exact path-dependent ones: what a tree expects of a row of which only a set of features is known weighs both sides of an unknown split by
the training rows that went there. For a leaf whose path asks M different features, with ``z_j`` the product of those shares over the nodes that ask feature j
and ``o_j`` whether the row meets them, feature j gets ``value * (o_j - z_j) * integral over t in 0..1 of the product over the other features of (1 - t) z + t o``:
the weights of sets of size s are these integrals of t^s (1 - t)^(M - 1 - s). The product is a polynomial of degree M - 1, so a Gauss-Legendre rule of
M / 2 points integrates it exactly. The work is leaves times M^2 for a row; nothing runs over sets of features.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder

#: numbers that a step over a part of a batch may hold
_CELLS = 2_000_000


@dataclass
class Tree:
    """Nodes by number: the root is 0; a leaf has no ``left``. Rows with a value up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            low = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)


@dataclass
class Ensemble:
    """``values`` of trees add up with ``weights``, divided by their number if ``mean``; ``kind`` says what a prediction makes of the sum."""

    trees: list[Tree]
    weights: list[float]
    mean: bool
    kind: str

    def predict(self, total: np.ndarray) -> np.ndarray:
        if self.kind == "classes":
            return total.argmax(axis=1).astype(float)
        return (total[:, 0] > 0).astype(float) if self.kind == "margin" else total[:, 0]


def export(model, spark: SparkSession | None = None) -> Ensemble:
    """Nodes of a fitted tree, forest or boosted trees; splits on categories are refused. Threads of their own have to give the session."""
    spark = spark or SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "nodeData" in stored.columns:
        stored = stored.select("treeID", "nodeData.*")
    else:
        stored = stored.withColumn("treeID", F.lit(0))
    classes = getattr(model, "numClasses", 0) if not hasattr(model, "trees") or "RandomForest" in type(model).__name__ else 0
    rows = sorted(stored.collect(), key=lambda r: (r["treeID"], r["id"]))
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for _, nodes in sorted(by_tree.items()):
        if any(n["leftChild"] >= 0 and n["split"]["numCategories"] >= 0 for n in nodes):
            raise ValueError("splits on categories have no threshold")
        stats = [np.array(n["impurityStats"], float) for n in nodes]
        value = np.array([s / max(s.sum(), 1e-300) for s in stats]) if classes else np.array([[n["prediction"]] for n in nodes], float)
        cover = np.array([s.sum() if classes else s[0] for s in stats])
        number = {n["id"]: i for i, n in enumerate(nodes)}
        child = lambda key: np.array([number.get(n[key], -1) if n[key] >= 0 else -1 for n in nodes])
        trees.append(Tree(np.array([n["split"]["featureIndex"] for n in nodes]), np.array([(n["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for n in nodes]), child("leftChild"), child("rightChild"), value, cover))
    single = not hasattr(model, "trees")
    boosted = "GBT" in type(model).__name__
    kind = "classes" if classes else "margin" if boosted and "Classification" in type(model).__name__ else "number"
    return Ensemble(trees, [1.0] if single else list(model.treeWeights), not boosted, kind)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(float)


def prefix_predictions(data: DataFrame, ensemble: Ensemble, sizes: list[int]) -> DataFrame:
    """``data`` with ``predictions``: for each of ``sizes`` what the first so many trees predict, from one pass over trees."""
    wanted = sorted(set(min(s, len(ensemble.trees)) for s in sizes))

    @F.pandas_udf("array<double>")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = _matrix(vectors) if len(vectors) else np.zeros((0, 1))
            total, at = np.zeros((len(x), ensemble.trees[0].value.shape[1])), {}
            for i, (tree, weight) in enumerate(zip(ensemble.trees, ensemble.weights), 1):
                total = total + weight * tree.value[tree.leaves_of(x)]
                if i in wanted:
                    at[i] = ensemble.predict(total / i if ensemble.mean else total)
            yield pd.Series(list(np.column_stack([at[min(s, len(ensemble.trees))] for s in sizes])))

    return data.withColumn("predictions", predicted(vector_to_array("_features")))


def paths(tree: Tree) -> list[tuple[int, dict[int, tuple[float, float, float]]]]:
    """Each leaf with, by feature that its path asks, the open lower and closed upper bound and the share of training rows that met them."""
    out, stack = [], [(0, {})]
    while stack:
        node, asked = stack.pop()
        if tree.left[node] < 0:
            out.append((node, asked))
            continue
        f, t = int(tree.feature[node]), float(tree.threshold[node])
        low, high, share = asked.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((tree.left[node], (low, min(high, t))), (tree.right[node], (max(low, t), high))):
            stack.append((int(child), {**asked, f: (*bounds, share * tree.cover[child] / tree.cover[node])}))
    return out


class Explainer:
    """All leaves of an ensemble, those with equally many features together."""

    def __init__(self, ensemble: Ensemble, label: int = 0) -> None:
        groups: dict[int, list] = {}
        self.base = 0.0
        for tree, weight in zip(ensemble.trees, ensemble.weights):
            scale = weight / (len(ensemble.trees) if ensemble.mean else 1)
            for leaf, asked in paths(tree):
                value = scale * float(tree.value[leaf, label])
                self.base += value * float(np.prod([a[2] for a in asked.values()]))
                if asked and value:
                    groups.setdefault(len(asked), []).append((value, sorted(asked.items())))
        self.groups = []
        for m, leaves in sorted(groups.items()):
            points, weights = np.polynomial.legendre.leggauss(-(-m // 2))
            bounds = np.array([[b for _, b in asked] for _, asked in leaves])
            self.groups.append((np.array([v for v, _ in leaves]), np.array([[f for f, _ in asked] for _, asked in leaves]), bounds[..., 0], bounds[..., 1], bounds[..., 2], (points + 1) / 2, weights / 2))

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of each row's features."""
        out = np.zeros(x.shape)
        for value, feature, low, high, share, points, weights in self.groups:
            step = max(1, _CELLS // (feature.size * len(points)))
            for at in range(0, len(x), step):
                some = x[at : at + step][:, feature]
                meets = (~(some <= low) & ((some <= high) | np.isinf(high))).astype(float)
                terms = (1 - points) * share[..., None] + points * meets[..., None]
                before, after = np.ones_like(terms), np.ones_like(terms)
                for j in range(1, feature.shape[1]):
                    before[:, :, j] = before[:, :, j - 1] * terms[:, :, j - 1]
                    after[:, :, -1 - j] = after[:, :, -j] * terms[:, :, -j]
                given = (value[:, None] * (meets - share) * ((before * after) @ weights)).reshape(len(some), -1)
                for f in np.unique(feature):
                    out[at : at + step, f] += given[:, feature.ravel() == f].sum(axis=1)
        return out


def shap_values(data: DataFrame, ensemble: Ensemble, label: int = 1) -> DataFrame:
    """``data`` with ``base`` (what the ensemble expects of a row of which nothing is known), ``explained`` (what it says) and ``shap``, a value for each
    component of ``_features``: base and values add up to explained. Of forests of classes ``label``'s probability is explained, of boosted classes the margin.
    """
    output = label if ensemble.kind == "classes" else 0
    explainer = Explainer(ensemble, output)

    @F.pandas_udf("explained double, shap array<double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            x = _matrix(vectors) if len(vectors) else np.zeros((0, 1))
            total = sum(w * t.value[t.leaves_of(x), output] for t, w in zip(ensemble.trees, ensemble.weights))
            yield pd.DataFrame({"explained": total / (len(ensemble.trees) if ensemble.mean else 1), "shap": list(explainer.values(x))})

    made = data.withColumn("_explained", explain(vector_to_array("_features")))
    return made.select(*data.columns, F.lit(explainer.base).alias("base"), "_explained.explained", "_explained.shap")


def shap_ranking(explained: DataFrame, features: list[str], most: int = 15) -> DataFrame:
    """``(feature, mean_abs)`` of rows of :func:`shap_values`, the largest ``most`` first."""
    means = explained.agg(*[F.avg(F.abs(F.get("shap", F.lit(i)))).alias(f"m{i}") for i in range(len(features))])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_abs")) for i, f in enumerate(features)])).alias("r"))
    return rows.select("r.*").orderBy(F.desc("mean_abs"), "feature").limit(most)
