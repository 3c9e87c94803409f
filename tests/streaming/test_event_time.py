"""Streams in event time against plain loops and the batch folds."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import mixtures as G
from millrace.operators import spectral as S
from millrace.streaming import event_time as E

START = datetime.datetime(2024, 1, 1)


def plain_filter(rows, length, k, eta, bound):
    """The definition, written out: one key's rows (inputs, outputs) in order."""
    s = np.array([[2 / ((i + j) ** 3 - (i + j)) for j in range(1, length + 1)] for i in range(1, length + 1)])
    values, vectors = np.linalg.eigh(s)
    order = np.argsort(values)[::-1][:k]
    filters = []
    for o in order:
        v = vectors[:, o]
        filters.append(v * np.sign(v[np.abs(v).argmax()]) * max(values[o], 0) ** 0.25)
    n, m = len(rows[0][0]), len(rows[0][1])
    past, last, w, said = [[0.0] * n for _ in range(length)], [0.0] * m, np.zeros((m, n * (k + 2) + 1)), []
    for x, y in rows:
        f = [sum(past[t][i] * phi[t] for t in range(length)) for phi in filters for i in range(n)] + past[0] + list(x) + [last[0]]
        said.append([float(np.dot(row, f)) for row in w])
        for o in range(m):
            w[o] = w[o] - 2 * eta * (said[-1][o] - y[o]) * np.array(f)
            size = np.sqrt((w[o] ** 2).sum())
            if size > bound:
                w[o] = w[o] * bound / size
        last, past = list(y), [list(x)] + past[:-1]
    return said


PARAMS = S.FilterParams(inputs=2, outputs=2, length=6, filters=3, eta=0.05, bound=0.8)


def table(n=60):
    rng = np.random.default_rng(3)
    return [(i % 2, START + datetime.timedelta(seconds=30 * i), i, *map(float, rng.normal(size=4))) for i in range(n)]


SCHEMA = "k int, at timestamp, n long, a double, b double, y double, z double"


def expected(rows):
    out = {}
    for key in (0, 1):
        own = [r for r in rows if r[0] == key]
        for r, said in zip(own, plain_filter([((r[3], r[4]), (r[5], r[6])) for r in own], 6, 3, 0.05, 0.8)):
            out[r[2]] = said
    return out


def test_batch_filter_and_stored_states(spark):
    rows = table()
    t = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = expected(rows)
    got = {(r.key, r.at): r.predicted for r in S.filter_predictions(t, "k", "n", ["a", "b"], ["y", "z"], PARAMS).collect()}
    assert all(np.allclose(got[n % 2, n], said) for n, said in want.items()) and len(got) == 60
    half = S.filter_states(t.where("n < 25"), "k", "n", ["a", "b"], ["y", "z"], PARAMS)
    rest = {r.at: r.predicted for r in S.filter_predictions(t.where("n >= 25"), "k", "n", ["a", "b"], ["y", "z"], PARAMS, half).collect()}
    assert sorted(rest) == list(range(25, 60)) and all(np.allclose(rest[n], want[n]) for n in rest)
    again = S.filter_states(t.where("n >= 25"), "k", "n", ["a", "b"], ["y", "z"], PARAMS, half)
    one = {r.key: r.weights for r in S.filter_states(t, "k", "n", ["a", "b"], ["y", "z"], PARAMS).collect()}
    assert all(np.allclose(r.weights, one[r.key]) for r in again.collect())
    with pytest.raises(ValueError):
        S.filter_states(t, "k", "n", ["a"], ["y"], PARAMS)


def run(spark, tmp_path, batches, schema, build, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.PROVIDER)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(out)


def test_stream_equals_batch(spark, tmp_path):
    """Rows arrive out of order within the delay, over three runs of the query; the last rows of each key only let the others go."""
    rows = table()
    rng = np.random.default_rng(1)
    mixed = [rows[i] for i in np.argsort(np.arange(60) + rng.uniform(0, 6, 60))]
    late = [(0, START + datetime.timedelta(seconds=30), 9001, 1.0, 1.0, 1.0, 1.0)]
    sentinels = [(k, START + datetime.timedelta(hours=5), 9002 + k, 0.0, 0.0, 0.0, 0.0) for k in (0, 1)]
    build = lambda stream: E.predict_stream(stream, "k", "at", "n", ["a", "b"], ["y", "z"], PARAMS, "5 minutes")
    found = run(spark, tmp_path, [mixed[:20], mixed[20:45], mixed[45:], late + sentinels], SCHEMA, build, "filter").collect()
    got = {r.tie: r.said for r in found}
    want = expected(rows)
    assert len(found) == len(got) and 9001 not in got and set(got) == set(want)
    assert all(np.allclose(got[n], said) for n, said in want.items())


# --- mixtures and the one-class learner

def two_clusters(n=200):
    rng = np.random.default_rng(2)
    return np.vstack([rng.normal(size=(n, 2)) * 0.3, rng.normal(size=(n, 2)) * 0.3 + [6, 6]])


def test_fit_mixture(spark):
    x = two_clusters()
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [None, 1.0])], "i long, v array<double>").repartition(4)
    mixture, likelihood = G.fit_mixture(t, "v", 2)
    weights, means = np.array([c[0] for c in mixture]), np.array(sorted(c[1] for c in mixture))
    assert np.allclose(weights, 0.5, atol=1e-3) and np.allclose(means, [x[:200].mean(0), x[200:].mean(0)], atol=1e-3)
    density = sum(w * np.exp(-0.5 * ((x - m) ** 2 / v).sum(1)) / np.sqrt((2 * np.pi * np.array(v)).prod()) for w, m, v in mixture)
    assert likelihood == pytest.approx(np.log(density).mean(), abs=1e-3)
    assert G.fit_mixture(t.limit(0), "v", 2)[0] == []


def test_a_planted_cluster_is_accepted_after_a_refit(spark):
    rng = np.random.default_rng(5)
    old, new = rng.normal(size=(150, 2)) * 0.3, rng.normal(size=(150, 2)) * 0.3 + [5, -5]
    t = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(np.vstack([old, new]))] + [("b", i, v.tolist()) for i, v in enumerate(old)] + [("b", 999, None)], "k string, i long, v array<double>").repartition(3)
    mixture, _ = G.fit_mixture(t.where("k = 'b'"), "v", 3)
    growth = G.Growth(sigma=1.0, eta=0.1, near=0.2, memory=40, more=2, widen=10)
    states = {r.key: G.OneClass.load(r.asDict(), growth) for r in G.one_class_grow(t, "k", "i", "v", mixture, growth).collect()}
    assert states["b"].refits == 0 and len(states["b"].means) == 3 and states["b"].score(np.array([5.0, -5.0])) < -0.9
    grown = states["a"]
    assert grown.refits == 1 and len(grown.means) == 5 and len(grown.kept) < grown.memory == 50
    inside = [grown.score(v) for v in new[100:]]
    assert np.mean(np.array(inside) > -0.3) > 0.9 and grown.score(np.array([-5.0, 5.0])) < -0.9
    assert np.mean([grown.score(v) > -0.3 for v in old]) > 0.9
    assert sum(c[0] for c in grown.mixture) == pytest.approx(1.0)


def test_one_class_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(40, 2)) * 0.3, rng.normal(size=(40, 2)) * 0.3 + [5, -5]])
    rows = [("a", START + datetime.timedelta(seconds=10 * i), i, v.tolist()) for i, v in enumerate(x)]
    end = [("a", START + datetime.timedelta(hours=3), 999, [0.0, 0.0])]
    mixture, growth = [(1.0, [0.0, 0.0], [0.1, 0.1])], G.Growth(memory=15, more=1)
    build = lambda stream: E.one_class_stream(stream, "k", "at", "n", "v", mixture, growth, "1 minute")
    found = run(spark, tmp_path, [rows[:50], rows[50:], end], "k string, at timestamp, n long, v array<double>", build, "one")
    got = {r.tie: r.said for r in found.collect()}
    alone = G.OneClass(mixture, growth)
    for i, v in enumerate(x):
        assert got[i] == pytest.approx([alone.score(v), alone.refits])
        alone.learn(v)
    assert alone.refits == 1 and set(got) == set(range(80))
    batch = G.one_class_grow(spark.createDataFrame(rows, "k string, at timestamp, n long, v array<double>"), "k", "n", "v", mixture, growth).head()
    assert np.allclose(batch.alpha, alone.alpha) and np.allclose(batch.means, alone.means.ravel())
