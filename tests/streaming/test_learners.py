"""A stream in one micro-batch learns what the batch fold learns; later micro-batches go on from the kept state."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import online as O
from millrace.streaming.learners import learn


def _rows(n):
    r = np.random.default_rng(3)
    return [(i % 2, i, float(1 if r.random() < 0.5 else -1), r.normal(size=2).tolist()) for i in range(n)]


def _replay(rows, learner, p):
    from millrace.streaming.learners import margin

    states, out = {}, {}
    for k, i, y, x in rows:
        s = states.setdefault(k, O.State(2))
        out[i] = margin(s, np.array(x), p.sigma)
        O.update(s, np.array(x), y, p, learner)
    return out


def test_stream_goes_on_from_its_state(spark, tmp_path):
    rows, p = _rows(40), O.Params(radius=0.3, eps=0.05, sigma=0.7)
    schema = "model int, at long, y double, x array<double>"
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scored = learn(stream, "model", "at", "y", "x", "robust", p)
    q = scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    found = {r["at"]: r["margin"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = _replay(rows, "robust", p)
    assert found.keys() == expected.keys()
    assert all(abs(found[i] - m) < 1e-9 for i, m in expected.items())


def test_linear_fold_by_hand(spark):
    t = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, -1.0, [0.0, 1.0]), (0, 3, 1.0, [20.0, 0.0]), (None, 1, 1.0, [1.0, 1.0])], "k int, o int, y double, x array<double>")
    (row,) = O.linear_fold(t, "k", "o", "y", "x", 2, 0.1).collect()
    assert row["k"] == 0 and np.allclose(row["w"], [0.1, -0.1])
    assert O.linear_fold(t.where(F.lit(False)), "k", "o", "y", "x", 2, 0.1).count() == 0
