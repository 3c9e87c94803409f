"""Queries over whole vectors, and cleaning plans, against numpy; with nulls, odd lengths and empty tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions.ordered import quantiles
from millrace.operators import cleaning as C
from millrace.operators import linalg as L
from millrace.operators import neighbours as N
from millrace.operators import online as O
from millrace.plans import modelling as catalogue


@pytest.fixture(scope="module")
def table():
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").sort_by("vec_id")
    return t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float), t["label"].to_numpy()


def run(name, spark, sf_dir):
    return catalogue.QUERIES[name](spark, sf_dir).collect()


def test_singular_values(spark, sf_dir, table):
    _, x, _ = table
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    found = sorted(run("linalg_svd", spark, sf_dir))
    assert np.allclose([r.s for r in found], s, atol=1e-6)
    assert np.allclose(np.abs(np.array([r.v for r in found[:5]]) @ vt[:5].T), np.eye(5), atol=1e-4)
    rough = sorted(run("linalg_rsvd", spark, sf_dir))
    assert [len(r.v) for r in rough] == [64, 64] and np.allclose([r.s for r in rough], s[:2], rtol=0.02)
    assert all(r.s <= b + 1e-9 for r, b in zip(rough, s))


def test_batch_map(spark, sf_dir, table):
    _, x, _ = table
    w, grid = x[:9].copy(), np.array([divmod(i, 3) for i in range(9)])
    for t in range(3):
        near = ((x[:, None] - w[None]) ** 2).sum(2).argmin(1)
        h = np.exp(-((grid[:, None] - grid[near][None]) ** 2).sum(2) / (1.5 * (1 - t / 3)) ** 2)
        w = (h @ x) / h.sum(1)[:, None]
    got = {(r.grid_row, r.grid_col): r.weights for r in run("som_batch", spark, sf_dir)}
    assert np.allclose([got[tuple(g)] for g in grid.tolist()], w)


def test_kmeans_distances(spark, sf_dir, table):
    """The centres are a fixed point of Lloyd's rounds on the standardised vectors, and distances are those to them."""
    ids, x, _ = table
    z = (x - x.mean(0)) / x.std(0)
    rows = {r.vec_id: list(r)[1:] for r in run("feat_kmeans_dist", spark, sf_dir)}
    d = np.array([rows[i] for i in ids.tolist()])
    assert d.shape == (len(x), min(max(int(8 * np.log10(len(x))), 8), 64))
    near = d.argmin(1)
    centres = np.array([z[near == k].mean(0) for k in range(d.shape[1])])
    assert np.allclose(np.sqrt(((z[:, None] - centres[None]) ** 2).sum(2)), d, atol=1e-6)


def test_kmeans_edges(spark):
    t = spark.createDataFrame([(i, [float(i % 2)]) for i in range(9)] + [(9, None)], "i int, v array<double>")
    assert sorted(N.kmeans(t, "v", "i", 5)) == [[0.0], [1.0]]
    assert N.kmeans(t.where("v is null"), "v", "i", 5) == []


def test_linear_fit_separates(spark, sf_dir, table):
    _, x, label = table
    w = np.array([r.w for r in sorted(run("linear_svm_fit", spark, sf_dir))])
    y = np.where(label < 5, 1.0, -1.0)
    assert len(w) == 64 and np.maximum(1 - y * (x @ w), 0).mean() < 1.0


def test_moments_of_odd_rows(spark):
    rows = [(1.0, [1.0, 2.0]), (1.0, [3.0, 4.0]), (None, [9.0, 9.0]), (1.0, None), (-1.0, [5.0, 6.0]), (1.0, [1.0]), (1.0, [7.0, None]), (-1.0, [])]
    t = spark.createDataFrame(rows, "y double, v array<double>").repartition(5)
    found = L.moments(t, "v", "y")
    assert {k: (n, s.tolist()) for k, (n, s, _) in found.items()} == {1.0: (2, [4.0, 6.0]), -1.0: (1, [5.0, 6.0])}
    assert np.allclose(found[1.0][2], [[10, 14], [14, 20]])
    assert L.moments(t.where("false"), "v") == {} and [len(a) for a in L.svd(t.where("false"), "v", 2)] == [0, 0] and len(L.randomised_svd(t.where("false"), "v", 2)[0]) == 0


def test_directions_of_a_flat_axis(spark):
    """An axis without variance: two-stage and SVD directions still separate, and lie in the axes that vary."""
    x = np.random.default_rng(1).normal(size=(60, 3))
    x[:, 2] = 0
    x[:30, 0] += 3
    t = spark.createDataFrame([(1.0 if i < 30 else -1.0, a.tolist()) for i, a in enumerate(x)], "y double, v array<double>")
    for method in ("twostage", "svd", "qrsvd"):
        w = L.discriminant(t, "v", "y", method)
        assert abs(w[2]) < 1e-9 and (x @ w)[:30].min() > (x @ w)[30:].mean()


def test_spectral_filter_against_a_loop(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=40) / 3, rng.normal(size=40) / 3
    t = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, at int, x double, y double")
    s = np.add.outer(np.arange(1, 11), np.arange(1, 11)).astype(float)
    values, vectors = np.linalg.eigh(2 / (s**3 - s))
    filters = []
    for j in np.argsort(values)[::-1][:3]:
        v = vectors[:, j] * np.sign(vectors[np.abs(vectors[:, j]).argmax(), j])
        filters.append(v * values[j] ** 0.25)
    w, want = np.zeros(6), []
    for i in range(40):
        past = np.array([x[i - 1 - j] if i - 1 - j >= 0 else 0.0 for j in range(10)])
        f = np.array([v @ past for v in filters] + [x[i - 1] if i else 0.0, x[i], y[i - 1] if i else 0.0])
        want.append(w @ f)
        w = w - 2 * 0.05 * (want[-1] - y[i]) * f
        w = w / max(1.0, np.linalg.norm(w))
    got = [r["predicted"] for r in O.spectral_fit(t, "k", "at", "x", "y", 10, 3, 0.05).orderBy("at").collect()]
    assert np.allclose(got, want)


def test_clip_is_the_default(spark):
    t = spark.createDataFrame([(1, 1e15), (2, -1e15), (3, None), (4, 5.0), (5, float("inf"))], "i int, v double")
    got = {r.i: r.v for r in C.fit(t, ["v"], order=["i"]).apply(t).collect()}
    assert got == {1: 1e12, 2: -1e12, 3: pytest.approx(-5e11 + 2.5), 4: 5.0, 5: 5.0}


def test_interpolation_of_one_long_series(spark):
    rng = np.random.default_rng(8)
    v = [None if rng.random() < 0.4 else float(rng.integers(100)) for _ in range(500)]
    t = spark.createDataFrame(list(enumerate(v)), "i int, v double").repartition(6)
    known = [i for i, a in enumerate(v) if a is not None]
    want = np.interp(np.arange(500), known, [v[i] for i in known])
    assert np.allclose([r.v for r in C.interpolate(t, ["v"], ["i"]).orderBy("i").collect()], want)
    assert [r.v for r in C.interpolate(t.where("v is null").limit(3), ["v"], ["i"]).collect()] == [0.0] * 3
    assert C.interpolate(t.limit(0), ["v"], ["i"]).count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=333), rng.integers(0, 4, 333).astype(float)
    t = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, float("nan"), None)], "a double, b double, c double")
    got = quantiles(t, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert got["c"] is None and np.allclose(got["a"], np.quantile(a, [0, 0.25, 0.5, 0.9, 1])) and np.allclose(got["b"], np.quantile(b, [0, 0.25, 0.5, 0.9, 1]))


def test_class_labels(spark):
    t = spark.createDataFrame([(0, "a", 5), (1, "b", 6), (None, None, None), (2, "a", 7)], "y int, s string, odd int")
    assert C.class_labels(t, "y") == [0, 1, 2] and C.class_labels(t, "s") == ["a", "b"]
    with pytest.raises(ValueError):
        C.class_labels(t, "odd")


def test_tree_search_beyond_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((200, 2)))], "i int, x double, y double")
    leaves, asks = N.kd_leaves(p, "i", ["x", "y"], 3), p.where("i % 9 = 0")
    near = lambda: sorted((r.query, r.i) for r in N.tree_radius(leaves, asks, "i", "i", ["x", "y"], 0.2).collect())
    few = near()
    monkeypatch.setattr(N, "BOXES_SENT", 2)
    assert near() == few and len(few) > 30


def test_transform(spark):
    t = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in t.select(L.transform(F.col("v"), [[1.0, 1.0], [0.0, 2.0]])).collect()] == [[3.0, 4.0], [None, None]]
