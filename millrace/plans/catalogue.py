"""All queries of the library's own operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import features as X
from ..operators import linalg as L
from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import online as O
from ..operators import series as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the same rows in DuckDB SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with a null in every seventh value."""
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k").cast("double")).alias("k"), F.lit(1.0).alias("one"))


_GAPPY = """gappy AS (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
    CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, CAST(1 AS DOUBLE) AS one FROM events)"""


# --- cleaning ---

@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def clean_dedupe(spark, sf_dir):
    return C.drop_duplicates(_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def clean_dedupe_first(spark, sf_dir):
    return C.drop_duplicates(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events")
def clean_try_numeric(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return _table(spark, sf_dir, "events").select("event_id", C.to_number(text).alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE date_trunc('day', o_orderdate) END AS day FROM orders")
def clean_dates_utc(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 4 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.to_time(text).cast("timestamp_ntz").alias("day"))


@query("SELECT event_id, " + ", ".join(f"CAST(event_type = '{v}' AS INT) AS event_type_{v}" for v in ("click", "error", "purchase", "signup", "view")) + " FROM events")
def clean_onehot(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "event_type")
    return C.one_hot(e, "event_type", C.levels(e, "event_type"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, CAST(0.25 AS DOUBLE)) AS a, quantile_cont(l_extendedprice, CAST(0.75 AS DOUBLE)) AS b FROM lineitem)
    SELECT l_returnflag, count(l_extendedprice)::BIGINT AS n, count(CASE WHEN l_extendedprice BETWEEN a - 1.5::DOUBLE * (b - a) AND b + 1.5::DOUBLE * (b - a) THEN 1 END)::BIGINT AS kept
    FROM lineitem, q GROUP BY l_returnflag""")
def clean_outlier_boxplot(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", F.col("l_extendedprice").alias("kept"))
    return C.null_outside(t, C.fit_boxplot(t, ["kept"])).groupBy("l_returnflag").agg(F.count("l_extendedprice").alias("n"), F.count("kept").alias("kept"))


@query("""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)
    SELECT event_id, CASE WHEN value <= m + 1.5::DOUBLE * d THEN value END AS value FROM events, s""")
def clean_outlier_zscore(spark, sf_dir):
    t = _table(spark, sf_dir, "events").select("event_id", "value")
    return C.null_outside(t, C.fit_zscore(t, ["value"], 1.5))


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(least(value, CAST(300 AS DOUBLE)), CAST(5 AS DOUBLE)) END AS value FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)")
def clean_outlier_clip(spark, sf_dir):
    t = _gappy(spark, sf_dir).select("event_id", "value")
    return C.fit(t, ["value"], outliers="clip", missing="none", bounds=(5.0, 300.0)).apply(t)


@query(f"""WITH {_GAPPY}, n AS (SELECT *, row_number() OVER w AS r FROM gappy WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER b AS pr, last_value(value IGNORE NULLS) OVER b AS pv,
          first_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER a AS nr, first_value(value IGNORE NULLS) OVER a AS nv FROM n
          WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(value, pv + (nv - pv) * (r - pr)::DOUBLE / greatest(nr - pr, 1)::DOUBLE, pv, nv, 0), 6) AS value FROM p""")
def clean_fill_interpolate(spark, sf_dir):
    t = C.interpolate(_gappy(spark, sf_dir).select("event_id", "user_id", "value"), ["value"], ["event_id"], ["user_id"])
    return t.select("event_id", _r("value").alias("value"))


@query(f"WITH {_GAPPY} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM gappy)), 6) AS value FROM gappy")
def clean_fill_mean(spark, sf_dir):
    t = _gappy(spark, sf_dir).select("event_id", "value")
    return C.fit(t, ["value"], outliers="none", missing="mean").apply(t).select("event_id", _r("value").alias("value"))


@query(f"WITH {_GAPPY} SELECT event_id, coalesce(value, 0) AS value, coalesce(k, 0) AS k FROM gappy")
def clean_fill_zero(spark, sf_dir):
    t = _gappy(spark, sf_dir).select("event_id", "value", "k")
    return C.fit(t, ["value", "k"], outliers="none", missing="zero").apply(t)


@query(f"WITH {_GAPPY} SELECT event_id, value, k FROM gappy WHERE value IS NOT NULL AND k IS NOT NULL")
def clean_drop_rows(spark, sf_dir):
    t = _gappy(spark, sf_dir).select("event_id", "value", "k")
    return C.fit(t, ["value", "k"], outliers="none", missing="remove_rows").apply(t)


@query(f"WITH {_GAPPY} SELECT event_id, user_id, one FROM gappy")
def clean_drop_cols(spark, sf_dir):
    t = _gappy(spark, sf_dir)
    return C.fit(t, ["value", "k", "one"], outliers="none", missing="remove_cols", keep_constants=True).apply(t)


@query(f"WITH {_GAPPY} SELECT event_id, user_id, value, k FROM gappy")
def clean_drop_constants(spark, sf_dir):
    t = _gappy(spark, sf_dir)
    return C.fit(t, ["value", "k", "one"], outliers="none", missing="none").apply(t)


@query(f"WITH {_GAPPY} SELECT count(*) FILTER (value IS NULL)::BIGINT AS value, count(*) FILTER (k IS NULL)::BIGINT AS k, 0::BIGINT AS one FROM gappy")
def clean_finite_check(spark, sf_dir):
    return C.not_finite(_gappy(spark, sf_dir), ["value", "k", "one"])


@query(f"""WITH {_GAPPY}, s AS (SELECT avg(value) AS m, stddev_samp(value) AS d, avg(k) AS mk, stddev_samp(k) AS dk FROM gappy),
    c AS (SELECT event_id, CASE WHEN value <= m + 2 * d THEN value END AS value, CASE WHEN k <= mk + 2 * dk THEN k END AS k FROM gappy, s)
    SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM c)), 6) AS value, round(coalesce(k, (SELECT avg(k) FROM c)), 6) AS k FROM c""")
def clean_pipeline(spark, sf_dir):
    t = _gappy(spark, sf_dir).select("event_id", "value", "k", "one")
    plan = C.fit(t, ["value", "k", "one"], outliers="zscore", missing="mean", threshold=2.0)
    return plan.apply(t).select("event_id", _r("value").alias("value"), _r("k").alias("k"))


@query(f"""WITH {_GAPPY}, n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM gappy),
    p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER b AS pr, last_value(value IGNORE NULLS) OVER b AS pv,
          first_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER a AS nr, first_value(value IGNORE NULLS) OVER a AS nv FROM n
          WINDOW b AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(value, pv + (nv - pv) * (r - pr)::DOUBLE / greatest(nr - pr, 1)::DOUBLE, pv, nv, 0), 6) AS value FROM p""")
def clean_fill_interpolate_table(spark, sf_dir):
    """The default plan: one series, interpolated along the whole table."""
    t = _gappy(spark, sf_dir).select("event_id", "value")
    return C.fit(t, ["value"], order=["event_id"]).apply(t).select("event_id", _r("value").alias("value"))


# --- features ---

def _prices(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"))


def _derived(spark, sf_dir, *names):
    t = X.apply_specs(_prices(spark, sf_dir), [X.FeatureSpec.parse(n) for n in names])
    return t.select("l_orderkey", "l_linenumber", "l_partkey", *[_r(n).alias(n) for n in names])


_PRICES = "FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(q * p, 6) AS q__x__p, round(p * d, 6) AS p__x__d {_PRICES}")
def feat_product(spark, sf_dir):
    return _derived(spark, sf_dir, "q__x__p", "p__x__d")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN d = 0 THEN CASE WHEN p > 0 THEN 1e12::DOUBLE ELSE 0 END ELSE p / d END, 6) AS p__d__d, round(CASE WHEN q = 0 THEN 1e12::DOUBLE ELSE p / q END, 6) AS p__d__q {_PRICES}")
def feat_ratio(spark, sf_dir):
    return _derived(spark, sf_dir, "p__d__d", "p__d__q")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(q + d, 6) AS q__add__d, round(q - d, 6) AS q__sub__d {_PRICES}")
def feat_add_sub(spark, sf_dir):
    return _derived(spark, sf_dir, "q__add__d", "q__sub__d")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(sin(q), 6) AS sin__q, round(cos(d), 6) AS cos__d {_PRICES}")
def feat_trig(spark, sf_dir):
    return _derived(spark, sf_dir, "sin__q", "cos__d")


_USER = "WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


@query(f"""SELECT event_id, round(coalesce(value - lag(value) OVER w, 0), 6) AS value__diff__1,
    round(coalesce(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 0), 6) AS value__diff__2 FROM events {_USER}""")
def feat_diff(spark, sf_dir):
    specs = [X.FeatureSpec("diff", ("value",), k) for k in (1, 2)]
    t = X.apply_specs(_table(spark, sf_dir, "events").select("event_id", "user_id", "value"), specs, ["event_id"], ["user_id"])
    return t.select("event_id", *[_r(s.name).alias(s.name) for s in specs])


@query(f"SELECT event_id, coalesce(lag(value, 1) OVER w, 0) AS value__lag__1, coalesce(lag(value, 3) OVER w, 0) AS value__lag__3 FROM events {_USER}")
def feat_lag(spark, sf_dir):
    specs = [X.FeatureSpec("lag", ("value",), k) for k in (1, 3)]
    return X.apply_specs(_table(spark, sf_dir, "events").select("event_id", "user_id", "value"), specs, ["event_id"], ["user_id"]).select("event_id", *[s.name for s in specs])


def _seeds(t: DataFrame, k: int) -> list[list[float]]:
    """The k vectors with the lowest ids."""
    return [list(map(float, r[0])) for r in t.orderBy("vec_id").select("embedding").limit(k).collect()]


@query()
def feat_kmeans_dist(spark, sf_dir):
    """Distances to the centres of a k-means fitted to all standardised components, as many as the rule for the number of rows says."""
    t = _vectors(spark, sf_dir)
    scaling = O.fit_scaling(t, "e")
    scaled = t.select("vec_id", O.scaled(F.col("e"), scaling).alias("e"))
    centres = N.kmeans(scaled, "e", "vec_id", X.centre_count(t.count(), len(scaling[0])))
    return scaled.select("vec_id", *X.centre_distances(F.col("e"), centres))


@query("""SELECT a, b, round(r, 6) AS r FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)""")
def feat_colinearity(spark, sf_dir):
    return X.correlations(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", _r("r").alias("r"))


_STUMP = """melted AS (SELECT f.feature, f.x, y FROM (SELECT (l_returnflag = 'R')::INT AS y, unnest([{'feature': 'q', 'x': l_quantity}, {'feature': 'd', 'x': l_discount}, {'feature': 'q__x__d', 'x': l_quantity * l_discount}]) AS f FROM lineitem)),
    counts AS (SELECT feature, x, sum(y)::DOUBLE AS ones, count(*)::DOUBLE AS n FROM melted GROUP BY feature, x),
    cuts AS (SELECT feature, (x + lead(x) OVER w) / 2 AS threshold, sum(ones) OVER w AS l1, sum(n) OVER w AS l, sum(ones) OVER (PARTITION BY feature) AS t1, sum(n) OVER (PARTITION BY feature) AS t FROM counts WINDOW w AS (PARTITION BY feature ORDER BY x)),
    scored AS (SELECT feature, threshold, (greatest(l1, l - l1) + greatest(t1 - l1, t - l - t1 + l1)) / t AS accuracy FROM cuts WHERE threshold IS NOT NULL),
    scores AS (SELECT feature, min(threshold) AS threshold, any_value(accuracy) AS accuracy FROM (SELECT *, max(accuracy) OVER (PARTITION BY feature) AS best FROM scored) WHERE accuracy = best GROUP BY feature)"""


def _stumps(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    t = t.withColumn("q__x__d", F.col("q") * F.col("d"))
    return X.stump_scores(X.melt(t, ["q", "d", "q__x__d"], ["y"]))


@query(f"WITH {_STUMP} SELECT feature, round(threshold, 6) AS threshold, round(accuracy, 9) AS accuracy FROM scores")
def feat_score_stump(spark, sf_dir):
    return _stumps(spark, sf_dir).select("feature", _r("threshold").alias("threshold"), _r("accuracy", 9).alias("accuracy"))


@query(f"WITH {_STUMP} SELECT feature, round(accuracy, 9) AS accuracy FROM scores WHERE feature = 'q__x__d' AND accuracy > (SELECT max(accuracy) FROM scores WHERE feature IN ('q', 'd'))")
def feat_accept_topk(spark, sf_dir):
    return X.accept(_stumps(spark, sf_dir), ["q", "d"]).select("feature", _r("accuracy", 9).alias("accuracy"))


# --- scaling, sequences, folds ---

@query("SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders)")
def scale_standard(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.standardise(t, S.fit_standard(t, ["o_totalprice"])).select("o_orderkey", _r("o_totalprice").alias("o_totalprice"))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def scale_target_inverse(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    scales = S.fit_standard(t, ["o_totalprice"])
    return S.standardise(t, scales).select("o_orderkey", _r(S.restore(F.col("o_totalprice"), scales["o_totalprice"]), 4).alias("o_totalprice"))


def _flat(t: DataFrame) -> DataFrame:
    return t.select("event_id", *[_r(F.col("x")[i][0]).alias(f"x{i}") for i in range(3)], *[_r(F.col("y")[i]).alias(f"y{i}") for i in range(2)])


def _sequences(spark, sf_dir, diff):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return _flat(S.sequences(e, ["value"], "value", 2, 2, 1, ["event_id"], ["user_id"], diff))


def _seq_sql(v: str) -> str:
    at = [f"lag({v}, {-i}) OVER w" if i < 0 else f"lead({v}, {i}) OVER w" if i else v for i in range(-2, 4)]
    return f"WITH s AS (SELECT event_id, {', '.join(f'{a} AS a{i}' for i, a in enumerate(at))} FROM (SELECT *, lag(value) OVER w AS before FROM events {_USER}) {_USER}) SELECT event_id, round(a0, 6) AS x0, round(a1, 6) AS x1, round(a2, 6) AS x2, round(a4, 6) AS y0, round(a5, 6) AS y1 FROM s WHERE a0 IS NOT NULL AND a5 IS NOT NULL"


@query(_seq_sql("value"))
def seq_io(spark, sf_dir):
    return _sequences(spark, sf_dir, "none")


@query(_seq_sql("(value - before)"))
def seq_diff(spark, sf_dir):
    return _sequences(spark, sf_dir, "diff")


@query(_seq_sql("(ln(value) - ln(before))"))
def seq_logdiff(spark, sf_dir):
    return _sequences(spark, sf_dir, "logdiff")


@query(f"SELECT event_id, round(lag(value) OVER w + (value - lag(value) OVER w), 6) AS reverted FROM events {_USER}")
def seq_revert(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = _table(spark, sf_dir, "events").select("event_id", "user_id", "value").withColumn("change", F.col("value") - F.lag("value").over(w))
    return S.revert(t, "change", "value", ["event_id"], ["user_id"]).select("event_id", _r("reverted").alias("reverted"))


_FOLD = "CASE WHEN i < n % 3 * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE n % 3 + (i - n % 3 * (n // 3 + 1)) // greatest(n // 3, 1) END::INT AS fold"


@query(f"SELECT event_id, user_id, {_FOLD} FROM (SELECT event_id, user_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events {_USER})")
def cv_kfold(spark, sf_dir):
    return S.k_folds(_table(spark, sf_dir, "events").select("event_id", "user_id"), 3, ["event_id"], ["user_id"])


@query(f"SELECT vec_id, label, {_FOLD} FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def cv_stratified(spark, sf_dir):
    return S.k_folds(_table(spark, sf_dir, "embeddings").select("vec_id", "label"), 3, ["vec_id"], ["label"])


# --- metrics ---

def _predictions(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(F.col("l_discount") * 8 + F.col("l_tax"), 2).alias("score"), "l_quantity", "l_linestatus").withColumn("predicted", (F.col("score") > 0.5).cast("int"))


_PREDICTIONS = "p AS (SELECT *, (score > 0.5::DOUBLE)::INT AS predicted FROM (SELECT l_returnflag, l_linestatus, l_quantity, (l_returnflag = 'R')::INT AS y, round(l_discount * 8 + l_tax, 2) AS score FROM lineitem))"


@query(f"WITH {_PREDICTIONS}, e AS (SELECT l_linestatus, l_quantity AS y, score * 50 AS f FROM p) SELECT l_linestatus, round(avg(abs(y - f)), 6) AS mae, round(avg(power(y - f, 2)), 6) AS mse, round(1 - avg(power(y - f, 2)) / var_pop(y), 6) AS r2 FROM e GROUP BY l_linestatus")
def metric_regression(spark, sf_dir):
    t = _predictions(spark, sf_dir).withColumn("f", F.col("score") * 50)
    m = M.regression(t, "l_quantity", "f", ["l_linestatus"])
    return m.select("l_linestatus", *[_r(c).alias(c) for c in ("mae", "mse", "r2")])


@query(f"""WITH {_PREDICTIONS}, c AS (SELECT l_linestatus, count(*) FILTER (y = 1 AND predicted = 1) AS tp, count(*) FILTER (y = 0 AND predicted = 1) AS fp, count(*) FILTER (y = 1 AND predicted = 0) AS fn, count(*) FILTER (y = 0 AND predicted = 0) AS tn FROM p GROUP BY l_linestatus)
    SELECT *, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def metric_binary(spark, sf_dir):
    m = M.binary(_predictions(spark, sf_dir), "y", "predicted", ["l_linestatus"])
    return m.select("l_linestatus", "tp", "fp", "fn", "tn", *[_r(c).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")])


@query("""WITH p AS (SELECT label, vec_id % 10 AS predicted FROM embeddings), n AS (SELECT label, count(*) AS support, count(*) FILTER (label = predicted) AS hits FROM p GROUP BY label),
    m AS (SELECT predicted AS label, count(*) AS predicted FROM p GROUP BY predicted)
    SELECT coalesce(n.label, m.label) AS label, coalesce(support, 0)::BIGINT AS support, round(2 * coalesce(hits, 0)::DOUBLE / (coalesce(support, 0) + coalesce(m.predicted, 0)), 6) AS f1 FROM n FULL JOIN m ON n.label = m.label""")
def metric_multiclass(spark, sf_dir):
    t = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), (F.col("vec_id") % 10).alias("predicted"))
    return M.multiclass(t, "label", "predicted").select("label", "support", _r("f1").alias("f1"))


@query(f"""WITH {_PREDICTIONS}, g AS (SELECT l_linestatus, score, sum(y) AS a, count(*) AS n FROM p GROUP BY ALL),
    r AS (SELECT l_linestatus, score, sum(n - a) OVER w / sum(n - a) OVER s AS fpr, sum(a) OVER w / sum(a) OVER s AS tpr FROM g WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC), s AS (PARTITION BY l_linestatus))
    SELECT l_linestatus, round(sum(area), 6) AS auc FROM (SELECT l_linestatus, (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS area FROM r WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC)) GROUP BY l_linestatus""")
def metric_roc_auc(spark, sf_dir):
    return M.auc(_predictions(spark, sf_dir), "y", "score", ["l_linestatus"]).select("l_linestatus", _r("auc").alias("auc"))


@query(f"WITH {_PREDICTIONS}, q AS (SELECT l_linestatus, y, greatest(least(score, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE) AS s FROM p) SELECT l_linestatus, round(avg(-CASE WHEN y = 1 THEN ln(s) ELSE ln(1 - s) END), 6) AS log_loss FROM q GROUP BY l_linestatus")
def metric_logloss(spark, sf_dir):
    return M.log_loss(_predictions(spark, sf_dir), "y", "score", ["l_linestatus"]).select("l_linestatus", _r("log_loss").alias("log_loss"))


_LEDGER = "(SELECT p_brand AS model, p_type AS dataset, p_name AS params, p_retailprice AS mean_objective, p_size::DOUBLE AS std_objective FROM part)"


def _ledger(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_type").alias("dataset"), F.col("p_name").alias("params"), F.col("p_retailprice").alias("mean_objective"), F.col("p_size").cast("double").alias("std_objective"))


@query(f"SELECT *, round(mean_objective - std_objective, 6) AS worst_case FROM {_LEDGER}")
def search_rank(spark, sf_dir):
    return M.worst_case(_ledger(spark, sf_dir)).withColumn("worst_case", _r("worst_case"))


@query(f"SELECT model, max(struct_pack(w := mean_objective - std_objective, p := params)).p AS params, round(max(mean_objective - std_objective), 6) AS worst_case FROM {_LEDGER} GROUP BY model")
def ledger_best_params(spark, sf_dir):
    return M.best_params(_ledger(spark, sf_dir), ["model"]).withColumn("worst_case", _r("worst_case"))


# --- exploration ---

@query(f"WITH {_GAPPY} SELECT event_id, value IS NULL AS value, k IS NULL AS k FROM gappy")
def eda_missing(spark, sf_dir):
    return _gappy(spark, sf_dir).select("event_id", *[F.col(c).isNull().alias(c) for c in ("value", "k")])


@query("""WITH q AS (SELECT event_type, quantile_cont(value, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(value, CAST(0.5 AS DOUBLE)) AS median, quantile_cont(value, CAST(0.75 AS DOUBLE)) AS q3 FROM events GROUP BY event_type),
    j AS (SELECT *, value BETWEEN q1 * 2.5::DOUBLE - q3 * 1.5::DOUBLE AND q3 * 2.5::DOUBLE - q1 * 1.5::DOUBLE AS inside FROM events JOIN q USING (event_type))
    SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside)::BIGINT AS outliers FROM j GROUP BY ALL""")
def eda_boxplot(spark, sf_dir):
    t = S.box_stats(_table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"])
    return t.withColumns({c: _r(c) for c in ("q1", "median", "q3")})


@query(f"""WITH c AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events), l AS (SELECT user_id, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2 FROM c {_USER}),
    s AS (SELECT user_id, sum(x * x) AS d, coalesce(sum(x * l1), 0) AS a1, coalesce(sum(x * l2), 0) AS a2 FROM l GROUP BY user_id)
    SELECT user_id, 1 AS lag, round(a1 / d, 6) AS acf FROM s UNION ALL SELECT user_id, 2, round(a2 / d, 6) FROM s""")
def eda_acf(spark, sf_dir):
    return S.autocorrelation(_table(spark, sf_dir, "events"), "value", [1, 2], ["event_id"], ["user_id"]).withColumn("acf", _r("acf"))


@query(f"""WITH t AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), l AS (SELECT user_id, value, k, lag(k) OVER w AS b, lead(k) OVER w AS a FROM t {_USER}),
    s AS (SELECT user_id, sqrt(sum(value * value) * sum(k * k)) AS d, coalesce(sum(value * b), 0) AS m, sum(value * k) AS z, coalesce(sum(value * a), 0) AS p FROM l GROUP BY user_id)
    SELECT user_id, -1 AS lag, round(m / d, 6) AS r FROM s UNION ALL SELECT user_id, 0, round(z / d, 6) FROM s UNION ALL SELECT user_id, 1, round(p / d, 6) FROM s""")
def eda_ccf(spark, sf_dir):
    t = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return S.cross_correlation(t, "value", "k", [-1, 0, 1], ["event_id"], ["user_id"]).withColumn("r", _r("r"))


@query(f"""WITH z AS (SELECT *, value / nullif(stddev_samp(value) OVER (PARTITION BY user_id), 0) AS s FROM events), a AS (SELECT *, s - lag(s) OVER w AS s1 FROM z {_USER}), b AS (SELECT *, s1 - lag(s1) OVER w AS s2 FROM a {_USER}),
    v AS (SELECT user_id, var_samp(s) AS v0, var_samp(s1) AS v1, var_samp(s2) AS v2 FROM b GROUP BY user_id)
    SELECT user_id, 0 AS differences, round(v0, 6) AS variance FROM v UNION ALL SELECT user_id, 1, round(v1, 6) FROM v UNION ALL SELECT user_id, 2, round(v2, 6) FROM v""")
def eda_diff_variance(spark, sf_dir):
    return S.difference_variance(_table(spark, sf_dir, "events"), "value", 2, ["event_id"], ["user_id"]).withColumn("variance", _r("variance"))


@query(f"""WITH n AS (SELECT event_id, user_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM events {_USER}),
    t AS (SELECT *, CASE WHEN i >= 3 AND i < c - 3 THEN m END AS trend, (i % 7)::INT AS phase FROM n), s AS (SELECT *, avg(value - trend) OVER (PARTITION BY user_id, phase) AS season FROM t)
    SELECT event_id, phase, round(trend, 6) AS trend, round(season, 6) AS season, round(value - trend - season, 6) AS remainder FROM s""")
def eda_seasonal_classical(spark, sf_dir):
    t = S.seasonal(_table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", 7, ["event_id"], ["user_id"])
    return t.select("event_id", "phase", *[_r(c).alias(c) for c in ("trend", "season", "remainder")])


@query("""WITH n AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS c, avg(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM events),
    t AS (SELECT *, CASE WHEN i >= 3 AND i < c - 3 THEN m END AS trend, (i % 7)::INT AS phase FROM n), s AS (SELECT *, avg(value - trend) OVER (PARTITION BY phase) AS season FROM t)
    SELECT event_id, phase, round(trend, 6) AS trend, round(season, 6) AS season, round(value - trend - season, 6) AS remainder FROM s""")
def eda_seasonal_long(spark, sf_dir):
    """The events of all users as one series."""
    t = S.seasonal(_table(spark, sf_dir, "events").select("event_id", "value"), "value", 7, ["event_id"])
    return t.select("event_id", "phase", *[_r(c).alias(c) for c in ("trend", "season", "remainder")])


# --- neighbours and clusters ---

_POINTS = "pts AS (SELECT c_custkey, c_acctbal / 100 AS x, c_nationkey::DOUBLE AS y FROM customer)"


def _points(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


_NEAR = f"{_POINTS}, near AS (SELECT l.c_custkey AS a, r.c_custkey AS b, sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) AS distance FROM pts l, pts r WHERE power(l.x - r.x, 2) + power(l.y - r.y, 2) < 2.25::DOUBLE)"


@query(f"WITH {_NEAR} SELECT a, b, round(distance, 6) AS distance FROM near")
def nn_radius_join(spark, sf_dir):
    return N.radius_pairs(_points(spark, sf_dir), "c_custkey", ["x", "y"], 1.5).withColumn("distance", _r("distance"))


@query(f"WITH {_NEAR} SELECT a AS c_custkey, count(*) <= 3 AS outlier FROM near GROUP BY a")
def cluster_outlier_test(spark, sf_dir):
    return N.outlier_test(_points(spark, sf_dir), "c_custkey", ["x", "y"], 1.5, 3)


@query(f"""WITH RECURSIVE {_NEAR}, cores AS (SELECT a AS core FROM near GROUP BY a HAVING count(*) >= 4),
    links AS (SELECT a, b FROM near WHERE a IN (SELECT core FROM cores) AND b IN (SELECT core FROM cores)),
    reach(n, r) AS (SELECT core, core FROM cores UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.n WHERE reach.r < links.b),
    roots AS (SELECT n, min(r) AS root FROM reach GROUP BY n), numbered AS (SELECT n, dense_rank() OVER (ORDER BY root) AS cluster FROM roots),
    border AS (SELECT a, max(cluster) AS cluster FROM near JOIN numbered ON b = n GROUP BY a)
    SELECT c_custkey, coalesce(numbered.cluster, border.cluster, -1)::INT AS cluster FROM pts LEFT JOIN numbered ON n = c_custkey LEFT JOIN border ON a = c_custkey""")
def cluster_density(spark, sf_dir):
    return N.density_clusters(_points(spark, sf_dir), "c_custkey", ["x", "y"], 1.5, 4).withColumn("cluster", F.col("cluster").cast("int"))


_KD = f"""{_POINTS}, a AS (SELECT *, (row_number() OVER (ORDER BY x, c_custkey) > count(*) OVER () // 2)::INT + 1 AS n1 FROM pts),
    b AS (SELECT *, n1 * 2 + 1 + (row_number() OVER (PARTITION BY n1 ORDER BY y, c_custkey) > count(*) OVER (PARTITION BY n1) // 2)::INT AS node FROM a)"""


@query(f"WITH {_KD} SELECT c_custkey, node::INT AS node FROM b")
def nn_kd_build(spark, sf_dir):
    return N.kd_leaves(_points(spark, sf_dir), "c_custkey", ["x", "y"], 2).select("c_custkey", "node")


@query(f"WITH {_KD} SELECT l.node::INT AS node, count(DISTINCT l.c_custkey)::BIGINT AS n, round(avg(power(l.x - r.x, 2) + power(l.y - r.y, 2)), 4) AS mean_square FROM b l JOIN b r ON l.node = r.node GROUP BY l.node")
def nn_leaf_profile(spark, sf_dir):
    return N.leaf_profile(N.kd_leaves(_points(spark, sf_dir), "c_custkey", ["x", "y"], 2), ["x", "y"]).withColumn("mean_square", _r("mean_square", 4))


_V = "v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings)"
_SQ = "list_sum([power(v.e[i] - c.e[i], 2) for i in range(1, 65)])"


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query(f"""WITH {_V}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, e FROM (SELECT * FROM v ORDER BY vec_id LIMIT 3)),
    near AS (SELECT vec_id, v.e, min(struct_pack(d := {_SQ}, i := c.i)).i AS k FROM v, c GROUP BY vec_id, v.e)
    SELECT k::INT AS k, j::INT AS j, round(avg(e[j + 1]), 5) AS c FROM near, range(0, 64) r(j) GROUP BY k, j""")
def cluster_lloyd(spark, sf_dir):
    """One round from given centres."""
    centres = N.lloyd(_vectors(spark, sf_dir), "e", _seeds(_table(spark, sf_dir, "embeddings"), 3), 1)
    return spark.createDataFrame([(i, j, round(x, 5)) for i, c in enumerate(centres) for j, x in enumerate(c)], "k int, j int, c double")


@query(f"""WITH {_V}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, e FROM (SELECT * FROM v ORDER BY vec_id LIMIT 9)),
    near AS (SELECT vec_id, min(struct_pack(d := {_SQ}, i := c.i)).i AS k FROM v, c GROUP BY vec_id)
    SELECT vec_id, (k // 3)::INT AS grid_row, (k % 3)::INT AS grid_col FROM near""")
def som_map(spark, sf_dir):
    t = _vectors(spark, sf_dir).withColumn("k", N.nearest_centre(F.col("e"), _seeds(_table(spark, sf_dir, "embeddings"), 9)))
    return t.select("vec_id", F.floor(F.col("k") / 3).cast("int").alias("grid_row"), (F.col("k") % 3).alias("grid_col"))


@query()
def som_batch(spark, sf_dir):
    weights = _seeds(_table(spark, sf_dir, "embeddings"), 9)
    for t in range(3):
        weights = N.som_round(_vectors(spark, sf_dir), "e", weights, 3, 1.5 * (1 - t / 3))
    return spark.createDataFrame([(i // 3, i % 3, w) for i, w in enumerate(weights)], "grid_row int, grid_col int, weights array<double>")


@query(f"""WITH {_V}, c AS (SELECT e FROM (SELECT * FROM v ORDER BY vec_id LIMIT 3))
    SELECT vec_id, round(sum(0.5::DOUBLE * exp(-{_SQ} / 0.5::DOUBLE)) - 1, 6) AS score FROM v, c GROUP BY vec_id""")
def oneclass_score(spark, sf_dir):
    t = _vectors(spark, sf_dir)
    return t.select("vec_id", _r(O.one_class_scores(t, "e", _seeds(_table(spark, sf_dir, "embeddings"), 3), [0.5] * 3, 0.5)).alias("score"))


@query(f"""WITH {_V}, c AS (SELECT vec_id, e FROM v ORDER BY vec_id LIMIT 20)
    SELECT v.vec_id, c.vec_id AS centre, round(exp(-{_SQ} / 0.5::DOUBLE), 6) AS k FROM v, c""")
def kernel_gram(spark, sf_dir):
    """The kernel of every vector with each of the 20 first."""
    t = _vectors(spark, sf_dir)
    centres = [(r.vec_id, list(r.e)) for r in t.orderBy("vec_id").limit(20).collect()]
    made = O.kernel_rows(t, "vec_id", "e", [c for _, c in centres], 0.5)
    return made.select("vec_id", F.get(F.array(*[F.lit(i) for i, _ in centres]), F.col("i")).alias("centre"), _r("k").alias("k"))


# --- online learners ---

def _labelled(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"), "e", (F.col("label") % 5).alias("model"))


_FOLDED = "v AS (SELECT (label % 5)::INT AS model, vec_id, row_number() OVER (PARTITION BY label % 5 ORDER BY vec_id) AS r, CASE WHEN label < 5 THEN 1::DOUBLE ELSE -1::DOUBLE END AS y, [x::DOUBLE for x in embedding] AS e FROM embeddings)"
_LINEAR = f"""WITH RECURSIVE {_FOLDED},
    f(model, r, w) AS (SELECT DISTINCT model, 0::BIGINT, [0::DOUBLE for i in range(1, 65)] FROM v UNION ALL
    SELECT f.model, v.r, CASE WHEN v.y * list_sum([w[i] * e[i] for i in range(1, 65)]) < 1 THEN [w[i] + 0.1::DOUBLE * y * e[i] for i in range(1, 65)] ELSE w END
    FROM f JOIN v ON v.model = f.model AND v.r = f.r + 1),
    last AS (SELECT model, w FROM f WHERE (model, r) IN (SELECT (model, max(r)) FROM v GROUP BY model))"""


@query(f"{_LINEAR} SELECT model, j::INT AS j, round(w[j + 1], 6) AS w FROM last, range(0, 64) r(j)")
def linear_svm_online(spark, sf_dir):
    t = O.linear_fold(_labelled(spark, sf_dir), "model", "vec_id", "y", "e", 64, 0.1)
    return t.select("model", F.posexplode("w").alias("j", "w")).withColumn("w", _r("w"))


@query(f"{_LINEAR} SELECT vec_id, round(list_sum([w[i] * e[i] for i in range(1, 65)]), 6) AS margin FROM v JOIN last USING (model)")
def linear_svm_predict(spark, sf_dir):
    """Each vector by its model's weights."""
    t = _labelled(spark, sf_dir)
    models = O.linear_fold(t, "model", "vec_id", "y", "e", 64, 0.1)
    return t.join(models, "model").select("vec_id", _r(F.aggregate(F.zip_with("e", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("margin"))


def _learner(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _labelled(spark, sf_dir)
        p = O.Params(radius=0.9, eps=0.05, sigma=0.5)
        scored = O.margins(t, O.fit(t, "model", "vec_id", "y", "e", name, p), "model", "e", p.sigma)
        return scored.groupBy("model").agg(F.avg((F.signum("margin") == F.col("y")).cast("double")).alias("accuracy"), F.avg("margin").alias("mean_margin"))

    run.__name__ = f"online_{name}"
    query()(run)


for _name in O.LEARNERS:
    _learner(_name)


@query()
def spectral_filter(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 500).alias("value"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("k"))
    return O.spectral_fit(e, "user_id", "event_id", "k", "value")


# --- linear algebra ---

@query(f"""WITH {_V}, ij AS (SELECT i::INT AS i, j::INT AS j FROM range(0, 64) a(i), range(0, 64) b(j))
    SELECT i, j, round(sum(e[i + 1] * e[j + 1]), 5) AS g FROM v, ij GROUP BY i, j""")
def linalg_gram(spark, sf_dir):
    gram = L.gram(_vectors(spark, sf_dir), "e")
    return spark.createDataFrame([(i, j, round(float(g), 5)) for i, row in enumerate(gram) for j, g in enumerate(row)], "i int, j int, g double")


@query()
def linalg_svd(spark, sf_dir):
    values, vectors = L.svd(_vectors(spark, sf_dir), "e", 64)
    return spark.createDataFrame([(i, float(s), vectors[:, i].tolist()) for i, s in enumerate(values)], "i int, s double, v array<double>")


@query(f"""WITH {_V}, g AS (SELECT i, j, sum(e[i] * e[j]) AS g FROM v, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j)
    SELECT round(sum(g) FILTER (i = j), 4) AS squares, round(sqrt(sum(g * g)), 4) AS fourth_root FROM g""")
def linalg_svd_norms(spark, sf_dir):
    """What all singular values have to add up to: their squares to the trace of the Gram matrix, their fourth powers to its squared norm."""
    values, _ = L.svd(_vectors(spark, sf_dir), "e", 64)
    return spark.createDataFrame([(round(float((values**2).sum()), 4), round(float((values**4).sum() ** 0.5), 4))], "squares double, fourth_root double")


@query()
def linalg_rsvd(spark, sf_dir):
    values, vectors = L.randomised_svd(_vectors(spark, sf_dir), "e", 2)
    return spark.createDataFrame([(i, float(s), vectors[:, i].tolist()) for i, s in enumerate(values)], "i int, s double, v array<double>")


#: within-class scatter as a list of rows, the means' difference, and the system solved by 100 steps of conjugate gradients
_SOLVED = f"""WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE -1 END AS l, [x::DOUBLE for x in embedding] AS e FROM embeddings),
    means AS (SELECT l, i, avg(e[i]) AS m FROM v, range(1, 65) a(i) GROUP BY l, i), lists AS (SELECT l, list(m ORDER BY i) AS m FROM means GROUP BY l),
    c AS (SELECT [e[i] - m[i] for i in range(1, 65)] AS e FROM v JOIN lists USING (l)),
    cells AS (SELECT i, j, sum(e[i] * e[j]) AS s FROM c, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j), rows_ AS (SELECT i, list(s ORDER BY j) AS s FROM cells GROUP BY i),
    matrix AS MATERIALIZED (SELECT list(s ORDER BY i) AS a FROM rows_), d AS (SELECT [p.m[i] - n.m[i] for i in range(1, 65)] AS d FROM lists p, lists n WHERE p.l = 1 AND n.l = -1),
    cg(k, x, r, p) AS (SELECT 0, [0::DOUBLE for i in range(1, 65)], d, d FROM d UNION ALL
        SELECT k + 1, x2, r2, [r2[i] + p[i] * list_sum([y * y for y in r2]) / rr for i in range(1, 65)] FROM (
            SELECT k, p, rr, [x[i] + p[i] * step for i in range(1, 65)] AS x2, [r[i] - ap[i] * step for i in range(1, 65)] AS r2 FROM (
                SELECT *, rr / list_sum([p[i] * ap[i] for i in range(1, 65)]) AS step FROM (
                    SELECT cg.*, [list_sum([row_[i] * p[i] for i in range(1, 65)]) for row_ in a] AS ap, list_sum([y * y for y in r]) AS rr FROM cg, matrix WHERE k < 100)))
        WHERE rr > 1e-24::DOUBLE),
    w AS (SELECT [y / sqrt(list_sum([z * z for z in x])) for y in x] AS w FROM cg WHERE k = (SELECT max(k) FROM cg))"""


def _direction(spark, sf_dir, method: str) -> list[float]:
    return [float(x) for x in L.discriminant(_labelled(spark, sf_dir), "e", "y", method)]


def _lda(method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(j, round(x, 5)) for j, x in enumerate(_direction(spark, sf_dir, method))], "j int, w double")

    run.__name__ = f"lda_{method}"
    query(f"{_SOLVED} SELECT j::INT AS j, round(w[j + 1], 5) AS w FROM w, range(0, 64) r(j)")(run)


for _name in ("eig", "twostage", "svd", "qrsvd", "srda"):
    _lda(_name)


@query(f"{_SOLVED} SELECT vec_id, round(list_sum([e[i] * w[i] for i in range(1, 65)]), 5) AS along FROM v, w")
def lda_transform(spark, sf_dir):
    """Each vector's place along the direction that separates the labels."""
    t = _labelled(spark, sf_dir)
    return t.select("vec_id", _r(L.transform(F.col("e"), [_direction(spark, sf_dir, "eig")])[0], 5).alias("along"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``, gaps interpolated along each user, outliers removed, standardised, with differences and lags."""
    t = C.interpolate(_gappy(spark, sf_dir).select("event_id", "user_id", "value", "k"), ["value", "k"], ["event_id"], ["user_id"])
    t = C.null_outside(t, C.fit_boxplot(t, ["value", "k"])).na.fill(0.0, subset=["value", "k"])
    t = S.standardise(t, S.fit_standard(t, ["value", "k"]))
    specs = [X.FeatureSpec("diff", ("value",), 1), X.FeatureSpec("lag", ("value",), 1), X.FeatureSpec("x", ("value", "k"))]
    return X.apply_specs(t, specs, ["event_id"], ["user_id"])
