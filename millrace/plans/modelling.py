"""Queries of feature scores, models, searches and stored plans; importing this module adds them to the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.storage import shared_folder
from ..operators import automl as AM
from ..operators import cleaning as C
from ..operators import ensembles as E
from ..operators import features as X
from ..operators import hinge as H
from ..operators import linalg as L
from ..operators import metrics as V
from ..operators import mixtures as G
from ..operators import models as M
from ..operators import neighbours as N
from ..operators import online as O
from ..operators import series as S
from ..operators import spectral as P
from ..operators import screening as SC
from ..operators import trees as T
from ..operators.series import hash_folds
from ..sources import artifacts as A
from ..sources.centres import fit_centres, load_centres
from ..sources.store import Store
from .catalogue import _KD, _POINTS, _PREDICTIONS, _SQ, _V, ORACLE_SQL, QUERIES, _gappy, _labelled, _points, _predictions, _r, _seeds, _table, _vectors, flagship, query

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


# --- trees on single features ---

def _tree_sql(melted: str, ys: list[str], depth: int = 3) -> str:
    """Leaves of depth-limited trees on single features, as common table expressions ending in ``leaves``."""
    parts = [f"melted AS ({melted})", f"r0 AS (SELECT feature, x, 1 AS node, count(*)::DOUBLE AS n, {', '.join(f'sum({y})::DOUBLE AS {y}' for y in ys)}, sum({' + '.join(f'{y} * {y}' for y in ys)})::DOUBLE AS square FROM melted GROUP BY feature, x)"]
    gain = " + ".join(f"l_{y} * l_{y} / l_n + (t_{y} - l_{y}) * (t_{y} - l_{y}) / (t_n - l_n)" for y in ys)
    for d in range(depth):
        run = ", ".join(f"sum({c}) OVER w AS l_{c}, sum({c}) OVER (PARTITION BY feature, node) AS t_{c}" for c in ("n", *ys))
        parts.append(f"c{d} AS (SELECT feature, node, x, {run} FROM r{d} WINDOW w AS (PARTITION BY feature, node ORDER BY x))")
        parts.append(f"b{d} AS (SELECT feature, node, min(struct_pack(loss := -({gain}), x := x)).x AS cut FROM c{d} WHERE l_n < t_n GROUP BY feature, node)")
        parts.append(f"r{d + 1} AS (SELECT r.* REPLACE (r.node * 2 + coalesce((r.x > cut)::INT, 0) AS node) FROM r{d} r LEFT JOIN b{d} b ON r.feature = b.feature AND r.node = b.node)")
    parts.append(f"leaves AS (SELECT feature, node, {', '.join(f'sum({c}) AS {c}' for c in ('n', *ys, 'square'))} FROM r{depth} GROUP BY feature, node)")
    return "WITH " + ", ".join(parts)


_UNNEST = "unnest([{'feature': 'q', 'x': l_quantity}, {'feature': 'd', 'x': l_discount}, {'feature': 'q__x__d', 'x': l_quantity * l_discount}]) AS f FROM lineitem"


def _melted(spark, sf_dir, *y):
    t = _table(spark, sf_dir, "lineitem").select(*y, F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return X.melt(t.withColumn("q__x__d", F.col("q") * F.col("d")), ["q", "d", "q__x__d"], ["y"])


@query(_tree_sql(f"SELECT f.feature, f.x, y FROM (SELECT (l_returnflag = 'R')::INT AS y, {_UNNEST})", ["y"]) + " SELECT feature, round(sum(greatest(y, n - y)) / sum(n), 9) AS score FROM leaves GROUP BY feature")
def feat_score_tree(spark, sf_dir):
    return T.binary_scores(_melted(spark, sf_dir, (F.col("l_returnflag") == "R").cast("int").alias("y"))).withColumn("score", _r("score", 9))


@query(_tree_sql(f"SELECT f.feature, f.x, y FROM (SELECT l_extendedprice AS y, {_UNNEST})", ["y"]) + " SELECT feature, round(1 - sum(square - y * y / n) / (sum(square) - sum(y) * sum(y) / sum(n)), 6) AS score FROM leaves GROUP BY feature")
def feat_score_tree_regression(spark, sf_dir):
    return T.regression_scores(_melted(spark, sf_dir, F.col("l_extendedprice").alias("y"))).withColumn("score", _r("score"))


@query(_tree_sql(f"SELECT f.feature, f.x, (y = 'A')::INT AS y_0, (y = 'N')::INT AS y_1, (y = 'R')::INT AS y_2 FROM (SELECT l_returnflag AS y, {_UNNEST})", ["y_0", "y_1", "y_2"])
       + """, top AS (SELECT *, CASE greatest(y_0, y_1, y_2) WHEN y_0 THEN 'A' WHEN y_1 THEN 'N' ELSE 'R' END AS chosen FROM leaves),
    own AS (SELECT feature, chosen, unnest([{'class': 'A', 'n': y_0}, {'class': 'N', 'n': y_1}, {'class': 'R', 'n': y_2}]) AS e FROM top)
    SELECT feature, e.class AS class, round(sum(CASE WHEN e.class = chosen THEN e.n ELSE 0 END) / sum(e.n), 9) AS score FROM own GROUP BY feature, e.class""")
def feat_score_tree_classes(spark, sf_dir):
    return T.class_scores(_melted(spark, sf_dir, F.col("l_returnflag").alias("y")), ["A", "N", "R"]).withColumn("score", _r("score", 9))


_SEARCHED = X.candidates(["p", "d", "t"])


def _search_sql() -> str:
    value = {"x": "{0} * {1}", "d": "CASE WHEN {1} = 0 THEN CASE WHEN {0} > 0 THEN 1e12 WHEN {0} < 0 THEN -1e12 ELSE 0 END ELSE {0} / {1} END"}
    each = ", ".join([f"{{'feature': '{c}', 'x': {c}}}" for c in "pdt"] + [f"{{'feature': '{s.name}', 'x': ({value[s.op].format(*s.inputs)})::DOUBLE}}" for s in _SEARCHED])
    rows = "SELECT l_extendedprice::DOUBLE AS p, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t, (l_extendedprice::DOUBLE * l_discount::DOUBLE > 1500)::INT AS y FROM lineitem"
    return _tree_sql(f"SELECT f.feature, f.x, y FROM (SELECT y, unnest([{each}]) AS f FROM ({rows}))", ["y"]) + """, scores AS (SELECT feature, sum(greatest(y, n - y)) / sum(n) AS score FROM leaves GROUP BY feature)
    SELECT feature, round(score, 9) AS score FROM scores WHERE feature NOT IN ('p', 'd', 't') AND score > (SELECT max(score) FROM scores WHERE feature IN ('p', 'd', 't'))"""


@query(_search_sql())
def feat_search(spark, sf_dir):
    """Products and ratios that tell rebates above 1,500 better than every original feature does, found by bounds first and exact scores after."""
    t = _table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(n) for n, c in (("p", "l_extendedprice"), ("d", "l_discount"), ("t", "l_tax"))])
    t = t.withColumn("y", (F.col("p") * F.col("d") > 1500).cast("int"))
    found = SC.search(t, ["p", "d", "t"], _SEARCHED, "y", 2)
    return spark.createDataFrame(found.accepted, "feature string, score double").withColumn("score", _r("score", 9))


def _pps_sql() -> str:
    each = ", ".join(f"avg(CASE WHEN fold <> {f} THEN y END) AS m{f}" for f in range(4))
    near = ", ".join(f"last_value(CASE WHEN m{f} IS NOT NULL THEN struct_pack(x := x, m := m{f}) END IGNORE NULLS) OVER b AS l{f}, first_value(CASE WHEN m{f} IS NOT NULL THEN struct_pack(x := x, m := m{f}) END IGNORE NULLS) OVER a AS h{f}" for f in range(4))
    pick = " ".join(f"WHEN {f} THEN CASE WHEN h{f} IS NULL OR k.x - l{f}.x <= h{f}.x - k.x THEN l{f}.m ELSE h{f}.m END" for f in range(4))
    return f"""WITH k AS (SELECT f.feature, f.x, y, fold FROM (SELECT value AS y, (event_id % 4)::INT AS fold, unnest([{{'feature': 'k', 'x': CAST(json_extract_string(props, '$.k') AS DOUBLE)}}, {{'feature': 'user_id', 'x': user_id::DOUBLE}}]) AS f FROM events)),
    r AS (SELECT feature, x, {each} FROM k GROUP BY feature, x), m AS (SELECT feature, x, {near} FROM r WINDOW b AS (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY feature ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    d AS (SELECT feature, median(y) AS med FROM k GROUP BY feature), e AS (SELECT k.feature, avg(abs(y - CASE fold {pick} END)) AS mae, avg(abs(y - med)) AS naive FROM k JOIN m ON k.feature = m.feature AND k.x = m.x JOIN d ON d.feature = k.feature GROUP BY k.feature)
    SELECT feature, round(mae, 6) AS mae, round(naive, 6) AS naive, round(greatest(0::DOUBLE, 1 - mae / naive), 6) AS score FROM e"""


@query(_pps_sql())
def feat_predictive_power(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("value").alias("y"), (F.col("event_id") % 4).cast("int").alias("fold"), F.get_json_object("props", "$.k").cast("double").alias("k"), "user_id")
    found = T.predictive_power(X.melt(e, ["k", "user_id"], ["fold", "y"]))
    return found.select("feature", *[_r(c).alias(c) for c in ("mae", "naive", "score")])


# --- series and neighbours ---

@query("""WITH c AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events), l AS (SELECT user_id, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT user_id, coalesce(sum(x * l1), 0) / sum(x * x) AS a, coalesce(sum(x * l2), 0) / sum(x * x) AS b FROM l GROUP BY user_id)
    SELECT user_id, 1 AS lag, round(a, 6) AS pacf FROM s UNION ALL SELECT user_id, 2, round((b - a * a) / (1 - a * a), 6) FROM s""")
def eda_pacf(spark, sf_dir):
    t = S.partial_autocorrelations(_table(spark, sf_dir, "events"), "value", 2, ["event_id"], ["user_id"])
    return t.select("user_id", F.col("lag").cast("int").alias("lag"), _r("pacf").alias("pacf"))


@query()
def eda_seasonal_stl(spark, sf_dir):
    return S.stl(_table(spark, sf_dir, "events"), "value", 7, "event_id", "user_id")


@query()
def eda_seasonal_stl_long(spark, sf_dir):
    """The events of all users as one series, smoothed in stretches with halos."""
    return S.stl(_table(spark, sf_dir, "events"), "value", 7, "event_id")


@query(f"""WITH {_POINTS} SELECT q.c_custkey AS query, p.c_custkey, round(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)), 6) AS distance
    FROM pts q, pts p WHERE q.c_custkey % 10 = 0 AND power(p.x - q.x, 2) + power(p.y - q.y, 2) < 4""")
def nn_kd_radius(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = N.tree_radius(N.kd_leaves(points, "c_custkey", ["x", "y"], 4), points.where("c_custkey % 10 = 0"), "c_custkey", "c_custkey", ["x", "y"], 2.0)
    return found.withColumn("distance", _r("distance"))


@query("""WITH w AS (SELECT event_id, value, lag(value, 1) OVER w AS a, lag(value, 3) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, round(a - value, 6) AS value_d_1, round(b - value, 6) AS value_d_3 FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def seq_lagged_diff(spark, sf_dir):
    t = S.lagged(_table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["value"], [1, 3], ["event_id"], ["user_id"], diff=True)
    return t.select("event_id", _r("value_d_1").alias("value_d_1"), _r("value_d_3").alias("value_d_3"))


@query("""SELECT event_id, value AS y0, y1, y2 FROM (SELECT event_id, value, lead(value, 1) OVER w AS y1, lead(value, 2) OVER w AS y2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE y2 IS NOT NULL""")
def seq_output_windows(spark, sf_dir):
    t = S.output_windows(_table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", 3, ["event_id"], ["user_id"])
    return t.select("event_id", *[F.col("window")[i].alias(f"y{i}") for i in range(3)])


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i, greatest(count(*) OVER () / 300::DOUBLE, 1) AS step, min(value) OVER () AS low, max(value) OVER () AS high FROM events)
    SELECT event_id, value, round((value - low) / (high - low), 6) AS colour FROM n WHERE floor((i - 1) / step) <> floor((i - 2) / step)""")
def eda_time_plot(spark, sf_dir):
    t = S.plot_rows(_table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", 300)
    return t.withColumn("colour", _r("colour"))


@query()
def som_online(spark, sf_dir):
    t = _vectors(spark, sf_dir).withColumn("model", F.col("label") % 5)
    return O.map_fold(t, "model", "vec_id", "e", _seeds(_table(spark, sf_dir, "embeddings"), 9), 3)


@query()
def linear_svm_fit(spark, sf_dir):
    w = O.hinge_fit(_labelled(spark, sf_dir), "y", "e", 64, 20)
    return spark.createDataFrame(list(enumerate(w)), "j int, w double")


@query()
def online_surface(spark, sf_dir):
    """The robust learner on all components' projection to their two leading axes."""
    t = _labelled(spark, sf_dir)
    t = t.withColumn("e", L.transform(F.col("e"), L.svd(t, "e", 2)[1].T.tolist()))
    return O.surface(O.fit(t, "model", "vec_id", "y", "e", "robust", O.Params(radius=0.1, eps=0.05, sigma=0.5)), 0.5, 20)


@query(f"""WITH {_KD} SELECT l.c_custkey AS query, r.c_custkey, round(sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)), 6) AS distance
    FROM b l JOIN b r ON l.node = r.node WHERE power(l.x - r.x, 2) + power(l.y - r.y, 2) < 0.25""")
def nn_kd_leaf_search(spark, sf_dir):
    """Each row's neighbours within 0.5 among the rows of its own leaf."""
    found = N.leaf_radius(N.kd_leaves(_points(spark, sf_dir), "c_custkey", ["x", "y"], 2), "c_custkey", ["x", "y"], 0.5)
    return found.withColumn("distance", _r("distance"))


@query("""WITH e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id::DOUBLE AS user_id, row_number() OVER (ORDER BY event_id) - 1 AS i, greatest(count(*) OVER () / 200::DOUBLE, 1) AS step FROM events),
    m AS (SELECT event_id, value AS target, unnest([{'feature': 'k', 'x': k}, {'feature': 'user_id', 'x': user_id}]) AS f FROM e WHERE i = 0 OR floor(i / step) <> floor((i - 1) / step))
    SELECT event_id, f.feature AS feature, f.x AS x, target FROM m""")
def eda_scatter(spark, sf_dir):
    """Points of each feature against the target: evenly spaced rows, as many as a plot shows."""
    e = _table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("user_id"))
    return S.scatter_rows(e, "event_id", ["k", "user_id"], "value", 200)


@query(_pps_sql().replace("SELECT feature, round(mae, 6) AS mae, round(naive, 6) AS naive, round(greatest(0::DOUBLE, 1 - mae / naive), 6) AS score FROM e", "SELECT feature, round(greatest(0::DOUBLE, 1 - mae / naive), 6) AS score FROM e WHERE greatest(0::DOUBLE, 1 - mae / naive) > 0.01"))
def select_pps(spark, sf_dir):
    """The features whose predictive power exceeds a threshold."""
    e = _table(spark, sf_dir, "events").select(F.col("value").alias("y"), (F.col("event_id") % 4).cast("int").alias("fold"), F.get_json_object("props", "$.k").cast("double").alias("k"), "user_id")
    found = T.select_by_power(T.predictive_power(X.melt(e, ["k", "user_id"], ["fold", "y"])), 0.01)
    return found.select("feature", _r("score").alias("score"))


# --- mixtures ---

def _mixture(spark, sf_dir):
    return [(1 / 3, c, [1.0] * 64) for c in _seeds(_table(spark, sf_dir, "embeddings"), 3)]


@query(f"""WITH {_V}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, e FROM (SELECT * FROM v ORDER BY vec_id LIMIT 3)),
    p AS (SELECT vec_id, v.e, k, exp(-{_SQ} / 2) AS p FROM v, c), r AS (SELECT k, e, p / sum(p) OVER (PARTITION BY vec_id) AS r FROM p),
    m AS (SELECT k, j, sum(r) AS n, sum(r * e[j + 1]) / sum(r) AS m, sum(r * e[j + 1] * e[j + 1]) / sum(r) AS q FROM r, range(0, 64) d(j) GROUP BY k, j)
    SELECT k::INT AS k, j::INT AS j, round(n / sum(n) OVER (PARTITION BY j), 5) AS weight, round(m, 5) AS mean, round(q - m * m + 1e-6::DOUBLE, 5) AS variance FROM m""")
def mixture_round(spark, sf_dir):
    made = G.em_round(_vectors(spark, sf_dir), "e", _mixture(spark, sf_dir))
    rows = [(k, j, round(w, 5), round(a, 5), round(b, 5)) for k, (w, m, v) in enumerate(made) for j, (a, b) in enumerate(zip(m, v))]
    return spark.createDataFrame(rows, "k int, j int, weight double, mean double, variance double")


@query()
def oneclass_online(spark, sf_dir):
    t = _vectors(spark, sf_dir).withColumn("model", F.col("label") % 5)
    return G.one_class_fit(t, "model", "vec_id", "e", _mixture(spark, sf_dir), 0.5, threshold=0.6)


# --- models ---

_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _modelled(spark, sf_dir):
    """Whether a line was returned, by its numbers; folds by a hash of the order."""
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_FEATURES, (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return M.prepare(hash_folds(t, 3, "l_orderkey"), _FEATURES, "y")


_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def model_compare(spark, sf_dir):
    """Every family of the registry, cross-validated: whether a customer's balance is above the middle, by nation, segment and key."""
    t = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"), (F.col("c_custkey") % 7).cast("double").alias("rest"), (F.col("c_acctbal") > 4500).cast("double").alias("y"))
    rows = M.prepare(hash_folds(t, 3, "c_custkey"), ["nation", "building", "rest"], "y")
    return M.ledger(spark, M.compare(rows, "customer", M.registry(2), 3, "accuracy")).drop("mean_time", "std_time")


@query()
def model_last_fold(spark, sf_dir):
    """The last fold's model of a comparison, stored and loaded again, on the rows that it has not seen."""
    keep, rows = f"{shared_folder(spark)}/folds-{uuid.uuid4().hex}", _modelled(spark, sf_dir)
    (row,) = M.compare(rows, "lineitem", {"tree": M.registry(2)["tree"]}, 3, "accuracy", keep=keep)
    return M.last_fold(keep, row).transform(rows.where("fold = 2")).select("l_orderkey", "l_linenumber", F.col("prediction").cast("int").alias("predicted"), F.col("_label").cast("int").alias("label"))


@query()
def feat_centres_reload(spark, sf_dir):
    """Distances to k-means centres of the lines' numbers that were stored with their scales and loaded again."""
    t = _table(spark, sf_dir, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber")).select("id", *_SCALED)
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    version = store.new_version("centres of the lines")
    fit_centres(t, _SCALED, "id").save(store, version)
    return load_centres(store, version).distances(t).select("id.*", "*").drop("id", *_SCALED)


@query()
def search_grid(spark, sf_dir):
    """Every configuration of a small grid, cross-validated."""
    grid = M.grid({"maxDepth": [2, 4], "maxBins": [16, 32]})
    return M.ledger(spark, M.compare(_modelled(spark, sf_dir), "lineitem", {"tree": M.registry(2)["tree"]}, 3, "accuracy", {"tree": grid})).drop("mean_time", "std_time")


@query()
def model_halving(spark, sf_dir):
    rows = M.halving(_modelled(spark, sf_dir), "lineitem", "tree", M.registry(2)["tree"], M.draw("tree", 4), 3, "accuracy", "l_orderkey")
    return M.ledger(spark, rows).drop("mean_time", "std_time")


@query()
def feat_forest_importance(spark, sf_dir):
    """Forest importances, and whether the two rules keep a feature."""
    found = M.importances(_modelled(spark, sf_dir), _FEATURES, 2, 20)
    thresholded, increment = M.keep_thresholded(found), M.keep_increment(found)
    return spark.createDataFrame([(f, float(i), f in thresholded, f in increment) for f, i in found], "feature string, importance double, thresholded boolean, increment boolean")


@query()
def model_publish_predict(spark, sf_dir):
    """A regression of event values, published to the shared folder, loaded and applied."""
    e = _gappy(spark, sf_dir)
    plan = C.fit(e, ["value", "k"], outliers="none", missing="mean", target="value")
    specs = [X.FeatureSpec("sin", ("k",)), X.FeatureSpec("x", ("k", "one"))]
    made = A.publish(e, plan, specs, ["k", "sin__k", "k__x__one"], "value", None, "ridge")
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    made.save(spark, path)
    return A.load(spark, path).predict(e.drop("value")).select("event_id", "predicted")


# --- from raw table to best model ---

@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target FROM orders")
def clean_binary_target(spark, sf_dir):
    """A target of the values 1 and 2, with gaps, as 1 and 0."""
    t = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)).alias("target"))
    return C.binary_target(t, "target")


@query("SELECT l_linestatus, round(avg(-ln(CASE l_returnflag WHEN 'A' THEN 0.2::DOUBLE + l_discount WHEN 'N' THEN 0.5::DOUBLE - l_discount ELSE 0.3::DOUBLE END)), 6) AS log_loss FROM lineitem GROUP BY l_linestatus")
def metric_logloss_classes(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    t = _table(spark, sf_dir, "lineitem").select("l_linestatus", label.alias("y"), F.array(F.lit(0.2) + F.col("l_discount"), F.lit(0.5) - F.col("l_discount"), F.lit(0.3)).alias("p"))
    return V.log_loss_classes(t, "y", "p", ["l_linestatus"]).select("l_linestatus", _r("log_loss").alias("log_loss"))


@query(f"""WITH {_PREDICTIONS}, g AS (SELECT l_linestatus, score, sum(y)::DOUBLE AS p, (count(*) - sum(y))::DOUBLE AS n FROM p GROUP BY ALL),
    c AS (SELECT l_linestatus, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER s AS all_p, sum(n) OVER s AS all_n FROM g WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC), s AS (PARTITION BY l_linestatus)),
    e AS (SELECT l_linestatus, (fp - n) / all_n AS x0, fp / all_n AS x1, (tp - p) / all_p AS y0, tp / all_p AS y1 FROM c WHERE all_p > 0 AND all_n > 0),
    o AS (SELECT l_linestatus, i, i / 99::DOUBLE AS fpr, max(CASE WHEN i = 0 THEN 0 WHEN x1 = x0 THEN y1 ELSE y0 + (y1 - y0) * (i / 99::DOUBLE - x0) / (x1 - x0) END) AS tpr FROM e JOIN range(0, 100) r(i) ON i / 99::DOUBLE BETWEEN x0 AND x1 GROUP BY l_linestatus, i)
    SELECT i, round(fpr, 6) AS fpr, round(avg(tpr), 6) AS mean_tpr, round(greatest(avg(tpr) - stddev_pop(tpr), 0), 6) AS low, round(least(avg(tpr) + stddev_pop(tpr), 1), 6) AS high FROM o GROUP BY i, fpr""")
def metric_roc_band(spark, sf_dir):
    """The mean curve on 100 points, a fold for each line status, with a band of a standard deviation."""
    t = V.roc_band(_predictions(spark, sf_dir), "y", "score", "l_linestatus")
    return t.select("i", *[_r(c).alias(c) for c in ("fpr", "mean_tpr", "low", "high")])


def _balances(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"), (F.col("c_custkey") % 7).cast("double").alias("rest"), (F.col("c_acctbal") / 1000).alias("balance"), (F.col("c_acctbal") + 500 * F.col("c_nationkey") > 10000).cast("int").alias("rich"))


@query()
def automl_best(spark, sf_dir):
    """Cleaning, feature sets, comparison of three families, search and publication; the ledger, best worst case first."""
    found = AM.best_model(_balances(spark, sf_dir), "c_custkey", ["nation", "building", "rest", "balance"], "rich", models=["ridge", "tree", "forest"])
    return M.ledger(spark, found.ledger).drop("mean_time", "std_time")


@query()
def feat_sets(spark, sf_dir):
    """The features of each set: predictive power, and the two rules on forest importances."""
    sets = AM.feature_sets(_balances(spark, sf_dir), ["nation", "building", "rest", "balance"], "rich", 2, "c_custkey")
    return spark.createDataFrame([(name, f) for name, some in sets.items() for f in some], "name string, feature string")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 END AS target FROM events")
def clean_class_target(spark, sf_dir):
    """A target of 0.0 and 1.0 with nulls and NaN is binary and has two classes."""
    t = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 != 0, (F.col("event_id") % 2).cast("double")).alias("target"))
    if C.class_labels(t, "target") != [0.0, 1.0] or C.target_mode(t, "target") != "classification":
        raise ValueError("a binary target has the classes 0 and 1")
    return C.binary_target(t, "target")


@query(_tree_sql(f"SELECT f.feature, f.x, (y = 'A')::INT AS y_0, (y = 'N')::INT AS y_1, (y = 'R')::INT AS y_2 FROM (SELECT l_returnflag AS y, {_UNNEST})", ["y_0", "y_1", "y_2"])
       + """, top AS (SELECT *, CASE greatest(y_0, y_1, y_2) WHEN y_0 THEN 'A' WHEN y_1 THEN 'N' ELSE 'R' END AS chosen FROM leaves),
    own AS (SELECT feature, chosen, unnest([{'class': 'A', 'n': y_0}, {'class': 'N', 'n': y_1}, {'class': 'R', 'n': y_2}]) AS e FROM top),
    s AS (SELECT feature, e.class AS component, sum(CASE WHEN e.class = chosen THEN e.n ELSE 0 END) / sum(e.n) AS score FROM own GROUP BY feature, e.class),
    b AS (SELECT component, max(score) AS base FROM s WHERE feature IN ('q', 'd') GROUP BY component)
    SELECT feature, component, round(score, 9) AS score, row_number() OVER (PARTITION BY component ORDER BY score DESC, feature)::INT AS rank
    FROM s WHERE feature IN (SELECT feature FROM s JOIN b USING (component) WHERE feature NOT IN ('q', 'd') AND score > base)""")
def feat_accept_classes(spark, sf_dir):
    """Derived features that beat the original ones in some class."""
    scores = T.class_scores(_melted(spark, sf_dir, F.col("l_returnflag").alias("y")), ["A", "N", "R"]).withColumnRenamed("class", "component")
    return X.accept_each(scores, ["q", "d"]).withColumn("score", _r("score", 9))


# --- ensembles ---

def _explained(spark, sf_dir):
    data = _modelled(spark, sf_dir)
    return E.shap_values(data, E.export(M.registry(2)["forest"](numTrees=12, maxDepth=4).fit(data), spark))


@query()
def eda_shap(spark, sf_dir):
    """Mean absolute Shapley values of a forest's features, largest first."""
    return E.shap_ranking(_explained(spark, sf_dir), _FEATURES)


@query("SELECT l_linenumber, count(*) AS n, count(*) AS adding_up FROM lineitem GROUP BY l_linenumber")
def eda_shap_sums(spark, sf_dir):
    """Of each line number's rows, how many have Shapley values that add up to what the forest says less what it expects."""
    gap = F.abs(F.col("base") + F.aggregate("shap", F.lit(0.0), lambda s, v: s + v) - F.col("explained"))
    return _explained(spark, sf_dir).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap < 1e-9).alias("adding_up"))


@query()
def model_halving_size(spark, sf_dir):
    """Successive halving on the number of boosted trees; finalists have a row for each size."""
    t = _balances(spark, sf_dir).withColumn("rich", F.col("rich").cast("double"))
    data = M.prepare(hash_folds(t, 2, "c_custkey"), ["nation", "building", "rest", "balance"], "rich")
    rows = M.halving_by_size(data, "customer", "boosting", M.registry(2)["boosting"], [{"maxDepth": d} for d in (1, 2, 3)], 2, "accuracy", least=4, most=12)
    return M.ledger(spark, rows).drop("mean_time", "std_time")


# --- one long series: no entities, no task that sees the whole ---

def _series(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


_LONG = "long AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


@query(f"""WITH {_LONG}, w AS (SELECT event_id, lag(value, 3) OVER w AS a, lag(k, 3) OVER w AS ka, lag(value, 1) OVER w AS b, lag(k, 1) OVER w AS kb, value AS c, k AS kc, lead(value, 2) OVER w AS y1, lead(value, 4) OVER w AS y2 FROM long WINDOW w AS (ORDER BY event_id))
    SELECT event_id, a AS x0, ka AS k0, b AS x1, kb AS k1, c AS x2, kc AS k2, y1, y2 FROM w WHERE a IS NOT NULL AND y2 IS NOT NULL""")
def seq_series(spark, sf_dir):
    """Rows t-3, t-1 and t, and targets t+2 and t+4, along the whole table."""
    t = S.sequences(_series(spark, sf_dir), ["value", "k"], "value", [0, 1, 3], [1, 3], 1, ["event_id"])
    return t.select("event_id", *[F.col("x")[i][j].alias(f"{n}{i}") for i in range(3) for j, n in enumerate("xk")], *[F.col("y")[i].alias(f"y{i + 1}") for i in range(2)])


@query(f"""WITH {_LONG}, w AS (SELECT event_id, row_number() OVER w AS i, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS d, lag(value, 5) OVER w AS l FROM long WINDOW w AS (ORDER BY event_id))
    SELECT event_id, round(CASE WHEN i > 2 THEN d ELSE 0 END, 6) AS value__diff__2, round(coalesce(l, 0), 6) AS value__lag__5 FROM w""")
def feat_series(spark, sf_dir):
    """Second differences and lags along the whole table."""
    t = X.apply_specs(_series(spark, sf_dir), [X.FeatureSpec("diff", ("value",), 2), X.FeatureSpec("lag", ("value",), 5)], ["event_id"])
    return t.select("event_id", _r("value__diff__2").alias("value__diff__2"), _r("value__lag__5").alias("value__lag__5"))


@query(f"""WITH {_LONG}, w AS (SELECT event_id, value AS y0, lead(value, 1) OVER w AS y1, lead(value, 2) OVER w AS y2 FROM long WINDOW w AS (ORDER BY event_id)) SELECT * FROM w WHERE y2 IS NOT NULL""")
def seq_output_series(spark, sf_dir):
    t = S.output_windows(_series(spark, sf_dir), "value", 3, ["event_id"])
    return t.select("event_id", *[F.col("window")[i].alias(f"y{i}") for i in range(3)])


@query("SELECT event_id, round(value, 4) AS reverted FROM events")
def seq_revert_series(spark, sf_dir):
    """Second differences along the whole table, integrated twice from two known levels in every thousand: the values again."""
    t = X.apply_specs(_series(spark, sf_dir), [X.FeatureSpec("diff", ("value",), 2)], ["event_id"])
    first = t.agg(F.min("event_id").alias("at")).first()["at"]
    known = ((F.col("event_id") - first) % 1000 < 2) | (F.col("event_id") == first)
    made = S.integrate(t.withColumn("level", F.when(known, F.col("value"))), "value__diff__2", "level", ["event_id"], times=2)
    return made.select("event_id", _r("reverted", 4).alias("reverted"))


@query(f"""WITH {_LONG}, c AS (SELECT event_id, value - avg(value) OVER () AS x FROM long), l AS (SELECT x, lag(x, 1) OVER w AS l1, lag(x, 7) OVER w AS l7 FROM c WINDOW w AS (ORDER BY event_id))
    SELECT 1 AS lag, round(sum(x * l1) / sum(x * x), 6) AS acf FROM l UNION ALL SELECT 7, round(sum(x * l7) / sum(x * x), 6) FROM l""")
def eda_acf_series(spark, sf_dir):
    t = S.autocorrelation(_series(spark, sf_dir), "value", [1, 7], ["event_id"], [])
    return t.select(F.col("lag").cast("int").alias("lag"), _r("acf").alias("acf"))


@query(ORACLE_SQL["linalg_svd_norms"])
def linalg_rsvd_norms(spark, sf_dir):
    """As linalg_svd_norms, by the sketch of the rows."""
    values, _ = L.randomised_svd(_vectors(spark, sf_dir), "e", 64)
    return spark.createDataFrame([(round(float((values**2).sum()), 4), round(float((values**4).sum() ** 0.5), 4))], "squares double, fourth_root double")


@query()
def linear_svm_exact(spark, sf_dir):
    """The linear SVM's weights at the optimum, with the bounds that prove it."""
    found = H.hinge_optimum(_labelled(spark, sf_dir), "y", "e", reg=1e-2, tolerance=1e-3)
    return spark.createDataFrame([(j, w, found.objective, found.bound) for j, w in enumerate(found.weights)], "j int, w double, objective double, bound double")


@query()
def oneclass_grow(spark, sf_dir):
    """The one-class learner whose mixture, fitted to all vectors, grows by refits on rows that no mean is near."""
    t = _vectors(spark, sf_dir).withColumn("model", F.col("label") % 5)
    mixture, _ = G.fit_mixture(t, "e", 3, rounds=20)
    return G.one_class_grow(t, "model", "vec_id", "e", mixture, G.Growth(sigma=0.5, near=0.6, memory=50))


@query()
def spectral_series(spark, sf_dir):
    """The filter on two input series, half of each user's events learned from a stored state."""
    t = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 500).alias("value"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("k"))
    params = P.FilterParams(inputs=2, outputs=1, length=10, filters=4)
    middle = t.agg(F.avg("event_id").alias("m")).first()["m"] or 0
    first = P.filter_states(t.where(F.col("event_id") < middle), "user_id", "event_id", ["value", "k"], ["value"], params)
    return P.filter_predictions(t.where(F.col("event_id") >= middle), "user_id", "event_id", ["value", "k"], ["value"], params, first)
