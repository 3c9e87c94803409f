"""Density clusters of dense and thin data, with copies, nulls and clusters that touch, against a loop over all pairs."""

import numpy as np
import pytest

from millrace.operators import neighbours as N


def _by_hand(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) < eps * eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in np.flatnonzero(core):
        if label[i] != -1:
            continue
        number += 1
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] == -1:
                label[j] = number
                todo += [k for k in np.flatnonzero(near[j] & core) if label[k] == -1]
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.max() if len(own) else -1
    return label


@pytest.mark.parametrize("direct", [1, 1024])
def test_density_clusters(spark, monkeypatch, direct):
    plain = N._cell_links
    monkeypatch.setattr(N, "_cell_links", lambda cores, points, eps: plain(cores, points, eps, direct))
    r = np.random.default_rng(11)
    # dense blobs a little more and a little less than eps apart, a chain, copies of one place, thin noise
    x = np.vstack([r.uniform(0, 0.7, (150, 2)), r.uniform(0, 0.7, (150, 2)) + [1.4, 0], r.uniform(0, 0.7, (150, 2)) + [3.15, 0], np.stack([np.arange(40) * 0.6 - 5, np.full(40, 5.0)], 1), np.tile([[9.0, 9.0]], (60, 1)), r.uniform(-10, 10, (80, 2))])
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(len(x), None, 1.0)], "id long, x double, y double")
    found = {r["id"]: r["cluster"] for r in N.density_clusters(t, "id", ["x", "y"], 1.0, 4).collect()}
    assert found.pop(len(x)) == -1
    assert [found[i] for i in range(len(x))] == _by_hand(x, 1.0, 4).tolist()


def test_empty(spark):
    t = spark.createDataFrame([], "id long, x double, y double")
    assert N.density_clusters(t, "id", ["x", "y"], 1.0, 4).count() == 0
    assert N.outlier_test(t, "id", ["x", "y"], 1.0, 3).count() == 0


@pytest.mark.parametrize("held", [5, 1 << 20])
def test_components_by_contraction(spark, monkeypatch, held):
    """A long chain dealt at random, a hot hub, loops and repeated links: the roots of a plain union-find, however few links a task holds."""
    monkeypatch.setattr(N, "HELD", held)
    rng = np.random.default_rng(0)
    chain = rng.permutation(200)
    links = [(int(a), int(b)) for a, b in zip(chain, chain[1:])] + [(300, i) for i in range(301, 400)] + [(500, 500), (500, 500), (601, 600), (600, 601)]
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    t = spark.createDataFrame([links[i] for i in rng.permutation(len(links))], "a long, b long").repartition(6)
    rows = N.min_labels(t).collect()
    assert len(rows) == len(root) and all(r["root"] == find(r["node"]) for r in rows)
    assert N.min_labels(t.limit(0)).count() == 0
