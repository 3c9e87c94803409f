"""One series of any length: stretches with halos, integration over ranges; against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import ordered
from millrace.operators import features as X
from millrace.operators import series as S


@pytest.fixture(params=[3, 7, 1 << 16])
def chunk(request, monkeypatch):
    monkeypatch.setattr(ordered.along, "__defaults__", (None, request.param))
    return request.param


def series(spark, n=40, who=None):
    rng = np.random.default_rng(n)
    rows = [(i * 10, who or ("hot" if i % 3 else f"u{i % 4}"), float(v)) for i, v in enumerate(rng.uniform(1, 9, n))]
    return rows, spark.createDataFrame(rows, "at long, who string, v double").repartition(4)


def test_no_single_partition(spark):
    """What meets in one task is a row for each range, never rows of the series."""
    _, t = series(spark)
    for made in (S.lagged(t, ["v"], [1, 2], ["at"]), S.sequences(t, ["v"], "v", 2, 1, 0, ["at"]), S.output_windows(t, "v", 3, ["at"]), X.apply_specs(t, [X.FeatureSpec("lag", ("v",), 2)], ["at"])):
        lines = made._jdf.queryExecution().executedPlan().toString().split("\n")
        below = [lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line]
        assert below and all("HashAggregate(keys=[_range" in line for line in below)
        assert any("Window" in line and "_slot" in line for line in lines)


def test_halos(spark, chunk):
    rows, t = series(spark)
    v = [r[2] for r in rows]
    got = {r.at // 10: (r.v_2, r.v_5) for r in S.lagged(t, ["v"], [2, 5], ["at"]).collect()}
    assert got == {i: (v[i - 2], v[i - 5]) for i in range(5, 40)}
    got = {r.at // 10: list(r.window) for r in S.output_windows(t, "v", 4, ["at"]).collect()}
    assert got == {i: v[i : i + 4] for i in range(37)}
    got = {r.at // 10: ([x[0] for x in r.x], list(r.y)) for r in S.sequences(t, ["v"], "v", [0, 4], [1, 3], 1, ["at"]).collect()}
    assert got == {i: ([v[i - 4], v[i]], [v[i + 2], v[i + 4]]) for i in range(4, 36)}
    got = {r.at // 10: r for r in X.apply_specs(t, [X.FeatureSpec("diff", ("v",), 3), X.FeatureSpec("lag", ("v",), 1)], ["at"]).collect()}
    want = np.diff(v, 3)
    assert all(got[i]["v__diff__3"] == (pytest.approx(want[i - 3]) if i > 2 else 0.0) and got[i]["v__lag__1"] == (v[i - 1] if i else 0.0) for i in range(40))
    got = {r.at // 10: r["v__lag__2"] for r in X.apply_specs(t, [X.FeatureSpec("lag", ("v",), 2)], ["at"], look_ahead=True).collect()}
    assert got == {i: v[i + 2] if i < 38 else 0.0 for i in range(40)}
    assert S.lagged(t.limit(0), ["v"], [1], ["at"]).count() == 0


def test_hot_entities_are_spread(spark, chunk):
    rows, t = series(spark)
    plain, spread = ({(r.who, r.at, r.v_1, r.v_3) for r in S.lagged(t, ["v"], [1, 3], ["at"], ["who"], spread=s).collect()} for s in (None, True))
    assert plain == spread and len(plain) > 20


def test_statistics_of_one_series(spark, chunk):
    rows, t = series(spark)
    v = np.array([r[2] for r in rows])
    c = v - v.mean()
    got = {r.lag: r.acf for r in S.autocorrelation(t, "v", [1, 4], ["at"], []).collect()}
    assert got == pytest.approx({k: float(c[k:] @ c[:-k] / (c @ c)) for k in (1, 4)})
    got = {r.lag: r.r for r in S.cross_correlation(t.withColumn("w", F.col("v") * F.col("v")), "v", "w", [-2, 0, 3], ["at"], []).collect()}
    w, both = v * v, np.sqrt((v @ v) * ((v * v) @ (v * v)))
    assert got == pytest.approx({0: float(v @ w / both), 3: float(v[:-3] @ w[3:] / both), -2: float(v[2:] @ w[:-2] / both)})
    got = {r.differences: r.variance for r in S.difference_variance(t, "v", 2, ["at"], []).collect()}
    unit = v / v.std(ddof=1)
    assert got == pytest.approx({k: float(np.diff(unit, k).var(ddof=1)) for k in range(3)})


@pytest.mark.parametrize("times", [1, 2, 3])
@pytest.mark.parametrize("by", [[], ["who"]])
@pytest.mark.parametrize("log", [False, True])
def test_difference_then_integrate(spark, times, by, log):
    """Changes of any order, with levels known at the start and here and there, give the series back."""
    _, t = series(spark)
    level = F.ln("v") if log else F.col("v")
    made = X.apply_specs(t.withColumn("u", level), [X.FeatureSpec("diff", ("u",), times)], ["at"], by)
    place = ordered.ranked(made, by, ["at"], "place")
    known = place.withColumn("level", F.when((F.col("place") <= times) | (F.col("at") % 130 == 0), F.col("v")))
    got = S.integrate(known, f"u__diff__{times}", "level", ["at"], by, times, log).collect()
    assert len(got) == 40 and set(got[0].asDict()) == {*known.columns, "reverted"}
    assert all(r.reverted == pytest.approx(r.v) for r in got)


def test_integration_starts_anew(spark):
    rows = [(0, None, 5.0), (1, 10.0, 7.0), (2, None, 1.0), (3, None, None), (4, 50.0, 9.0), (5, None, 2.0)]
    t = spark.createDataFrame(rows, "at long, level double, change double")
    got = [r.reverted for r in S.integrate(t, "change", "level", ["at"]).orderBy("at").collect()]
    assert got == [None, 10.0, 11.0, 11.0, 50.0, 52.0]
    with pytest.raises(ValueError):
        S.integrate(t, "change", "level", ["at"], times=0)


@pytest.mark.parametrize("period, n, places", [(7, 1500, 1), (4, 700, 128), (12, 30, 1), (5, 9, 1)])
def test_stl_of_one_long_series(spark, period, n, places):
    """Stretches with halos give what the whole series gives, at its ends, at cuts and for a series shorter than a stretch or than two periods."""
    rng = np.random.default_rng(period)
    y = np.cumsum(rng.normal(size=n)) + 3 * np.sin(np.arange(n) * 2 * np.pi / period)
    t = spark.createDataFrame([(i * 3, float(v)) for i, v in enumerate(y)] + [(1, None)], "at long, v double").repartition(5)
    trend, season = S.stl_parts(y, period) if n >= 2 * period else (np.full(n, y.mean()), np.zeros(n))
    got = sorted(S.stl(t, "v", period, "at", chunk=places).collect(), key=lambda r: r["at"])
    assert [r["at"] // 3 for r in got] == list(range(n))
    assert np.allclose([r["trend"] for r in got], trend, atol=1e-9) and np.allclose([r["season"] for r in got], season, atol=1e-9)
    assert np.allclose([r["remainder"] for r in got], y - trend - season, atol=1e-9)


def test_stl_of_hot_entities(spark):
    rng = np.random.default_rng(1)
    v = {"a": rng.normal(size=900), "b": rng.normal(size=40), None: rng.normal(size=30)}
    t = spark.createDataFrame([(w, i, float(x)) for w, xs in v.items() for i, x in enumerate(xs)], "who string, at long, v double")
    same = lambda df: sorted(((r["who"] or "", r["at"], round(r["trend"], 7), round(r["season"], 7)) for r in df.collect()))
    assert same(S.stl(t, "v", 7, "at", "who", spread=True, chunk=1)) == same(S.stl(t, "v", 7, "at", "who"))


@pytest.mark.parametrize("period", [1, 4, 5])
def test_classical_parts_of_one_long_series(spark, chunk, period):
    rows, t = series(spark, 60)
    y, half = np.array([r[2] for r in rows]), period // 2
    weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.r_[np.full(half, np.nan), np.convolve(y, weights, "valid"), np.full(half, np.nan)]
    season = np.array([np.nanmean((y - trend)[np.arange(60) % period == p]) for p in range(period)])[np.arange(60) % period]
    for made in (S.seasonal(t, "v", period, ["at"]), S.seasonal(t.withColumn("one", F.lit(None).cast("string")), "v", period, ["at"], ["one"], spread=True)):
        got = sorted(made.collect(), key=lambda r: r["at"])
        assert np.allclose([np.nan if r["trend"] is None else r["trend"] for r in got], trend, equal_nan=True)
        assert np.allclose([r["season"] for r in got], season) and [r["phase"] for r in got] == [i % period for i in range(60)]
