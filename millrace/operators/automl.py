"""From a raw table to its best model: cleaning, feature sets, comparison, a search for the best, and publication.

Each step is a function of its own; :func:`best_model` chains them. Every score comes from folds by a hash of the key, so rows stay in place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import checkpointed
from ..sources.artifacts import Published, publish
from . import cleaning as C
from . import features as X
from . import models as M
from . import trees as T
from .models import worst_case
from .series import hash_folds


@dataclass
class Found:
    """``ledger`` has a row for each comparison and search; ``sets`` the features of each set; ``published`` is the best model, fitted to all rows."""

    mode: str
    sets: dict[str, list[str]]
    ledger: list[dict]
    best: dict
    published: Published


def scorer_of(classes: int | None) -> str:
    return "neg_mae" if classes is None else "accuracy"


def feature_sets(data: DataFrame, features: list[str], target: str, classes: int | None, key: str, folds: int = 4) -> dict[str, list[str]]:
    """``PPS``: features with predictive power; ``RFT`` and ``RFI``: those of a forest by the threshold and the increment rule.

    ``data`` has numeric features without nulls. A set without features is left out.
    """
    judged = hash_folds(data.withColumn("y", F.col(target).cast("double")), folds, key)
    power = T.select_by_power(T.predictive_power(X.melt(judged, features, ["fold", "y"]), folds), 0.0)
    chosen = {r["feature"] for r in power.collect()}
    ranked = M.importances(M.prepare(data, features, target), features, classes)
    sets = {"PPS": [f for f in features if f in chosen], "RFT": M.keep_thresholded(ranked), "RFI": M.keep_increment(ranked)}
    return {name: some for name, some in sets.items() if some}


def derive(data: DataFrame, features: list[str], target: str, classes: int | None, ops: tuple[str, ...] = ("x", "d"), threshold: float = 0.95, most: int = 50) -> tuple[list[str], list[X.FeatureSpec]]:
    """The original features that stay and the accepted recipes.

    The later one of two colinear columns goes. Products and ratios (``ops``) of the others are scored by a depth-3 tree on each, and those that beat every
    original feature are accepted, ``most`` at most. All candidates are scored in one job. ``data`` has numbers without nulls.
    """
    gone = set(X.colinear(data, features, threshold)) if len(features) > 1 else set()
    stay = [f for f in features if f not in gone]
    specs = X.candidates(stay, ops)
    if not specs:
        return stay, []
    made = X.apply_specs(data.withColumn("y", F.col(target).cast("double")), specs)
    long = X.melt(made, [*features, *[s.name for s in specs]], ["y"])
    scores = T.regression_scores(long) if classes is None else T.binary_scores(long)
    accepted = {r["feature"] for r in X.accept_each(scores.withColumn("component", F.lit(0)), features, most).collect()}
    return stay, [s for s in specs if s.name in accepted]


def top_settings(ledger: list[dict], top: int = 3, done: set[tuple] = frozenset()) -> list[dict]:
    """The first ``top`` rows by worst case, names break ties, NaN last; pairs of model and data set in ``done`` are skipped."""
    order = sorted((r for r in ledger if r.get("resource", 1.0) >= 1.0), key=lambda r: (-worst_case(r), r["model"], r["dataset"]))
    return [r for r in order[:top] if (r["model"], r["dataset"]) not in done]


def optimise(data: dict[str, DataFrame], ledger: list[dict], classes: int | None, key: str, folds: int, model: str | None = None, dataset: str | None = None, top: int = 3, candidates: int = 9) -> list[dict]:
    """Successive halving for the best rows of the ledger, or for one model on one data set: both or neither are given."""
    if (model is None) != (dataset is None):
        raise ValueError("give both a model and a data set, or neither")
    chosen = [(model, dataset)] if model else [(r["model"], r["dataset"]) for r in top_settings(ledger, top)]
    made = M.registry(classes)
    return [row for name, d in chosen for row in M.halving(data[d], d, name, made[name], M.draw(name, candidates), folds, scorer_of(classes), key)]


def validate(data: DataFrame, model: str, params: dict, classes: int | None, folds: int) -> DataFrame:
    """Out-of-fold predictions of a model of the registry by its name and parameters; unknown names raise."""
    made = M.registry(classes)
    if model not in made:
        raise ValueError(f"no model {model}")
    return M.out_of_fold(data, made[model](**params), folds)


def production_score(published: Published, df: DataFrame) -> float | None:
    """Of a published model on rows with a target: mean absolute error of the restored target, or accuracy; None without such rows.

    Rows that the cleaning plan removes are not scored; a probability of a half or more is class 1.
    """
    said, truth = F.col("predicted"), F.col(published.target).cast("double")
    rows = published.predict(df).where(truth.isNotNull())
    if published.classes is None:
        return rows.agg(F.avg(F.abs(said - truth)).alias("s")).first()["s"]
    label = (said >= 0.5).cast("double") if published.classes == 2 else said
    return rows.agg(F.avg((label == truth).cast("double")).alias("s")).first()["s"]


def best_model(
    df: DataFrame,
    key: str,
    numbers: list[str],
    target: str,
    folds: int = 3,
    models: list[str] | None = None,
    top: int = 1,
    candidates: int = 4,
    missing: str = "mean",
    ops: tuple[str, ...] = ("x", "d"),
) -> Found:
    """Clean, derive features, choose feature sets, compare models on each, search the best and fit the winner to all rows with a target.

    Two distinct known target values make a classification (1 against the other), all others a regression. Without a target value anywhere it raises. Only scores over
    all rows compete, and a score that is not a number never wins. The winner is published with the recipes of its set.
    """
    mode = C.target_mode(df, target)
    classes = 2 if mode == "classification" else None
    raw = C.binary_target(df, target).withColumn(target, F.nanvl(F.col(target).cast("double"), F.lit(None)))
    raw = checkpointed(raw.where(F.col(target).isNotNull()))
    if raw.isEmpty():
        raise ValueError(f"{target} has no values")
    plan = C.fit(raw, numbers, missing=missing, order=[key], target=target)
    clean = checkpointed(plan.apply(raw).na.fill(0.0, subset=[c for c in numbers if c not in plan.dropped]))
    usable, specs = derive(clean, [c for c in numbers if c not in plan.dropped], target, classes, ops)
    clean = checkpointed(X.apply_specs(clean, specs))
    usable = usable + [s.name for s in specs]
    sets: dict[str, list[str]] = {}
    for name, some in (feature_sets(clean, usable, target, classes, key) or {"all": usable}).items():
        if sorted(some) not in [sorted(s) for s in sets.values()]:  # equal sets are compared once
            sets[name] = some
    folded = hash_folds(clean, folds, key)
    data = {name: checkpointed(M.prepare(folded, some, target)) for name, some in sets.items()}
    made = {n: m for n, m in M.registry(classes).items() if models is None or n in models}
    ledger = [row for name, rows in data.items() for row in M.compare(rows, name, made, folds, scorer_of(classes))]
    ledger += optimise(data, ledger, classes, key, folds, top=top, candidates=candidates)
    best = M.best_of(ledger)
    used = [s for s in specs if s.name in sets[best["dataset"]]]
    published = publish(raw, plan, used, sets[best["dataset"]], target, classes, best["model"], json.loads(best["params"]))
    return Found(mode, sets, ledger, best, published)
