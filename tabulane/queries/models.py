"""Checks of regression fits, scores and predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulane.operators import modeling as M
from tabulane.operators import profile as A
from tabulane.operators import projection as P
from tabulane.queries.base import rounded, table, u_sql

ALL = {"type": "none"}


def _lines(spark, d, li=None, *more):
    """Line items with a text key made of all their identifying columns."""
    li = table(spark, d, "lineitem") if li is None else li
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("long"))
    return li.select(key.alias("key"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", *more)


LINES = """
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT)) AS key,
  l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"""
SXY = "regr_sxy(l_extendedprice, l_quantity)"
SXX = "regr_sxx(l_extendedprice, l_quantity)"
TRAIN = f"SELECT * FROM ({LINES}) WHERE NOT {u_sql(42, 'split', 0, 'key')} < 0.2"


def _coefficients(model, features=("l_quantity",), digits=5, **params):
    def run(spark, d):
        fitted = M.fit(_lines(spark, d), "key", model, "l_extendedprice", list(features), params)
        return rounded(fitted.coefficients_frame(spark), digits)

    return run


def _through_origin(penalty: int) -> str:
    return f"""
WITH t AS ({TRAIN}), s AS (SELECT sum(l_extendedprice * l_quantity) / (sum(l_quantity * l_quantity) + {penalty}) AS w FROM t)
SELECT 'l_quantity' AS term, round(w, 5) AS value FROM s UNION ALL SELECT '_intercept', CAST(0 AS DOUBLE)"""


def _one_feature(slope: str) -> str:
    return f"""
WITH t AS ({TRAIN}), s AS (SELECT {slope} AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM t)
SELECT 'l_quantity' AS term, round(b, 5) AS value FROM s UNION ALL SELECT '_intercept', round(my - b * mx, 5) FROM s"""


BAYESIAN_ROUNDS = 12
BAYESIAN_RIDGE = f"""
WITH RECURSIVE t AS ({TRAIN}),
s AS (SELECT count(*) AS n, {SXX} AS xx, {SXY} AS xy, regr_syy(l_extendedprice, l_quantity) AS yy, var_pop(l_extendedprice) AS v,
  avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM t),
r AS (
  SELECT 0 AS i, 1 / v AS noise, CAST(1 AS DOUBLE) AS weight, xy / (xx + v) AS w FROM s
  UNION ALL
  SELECT i + 1, noise2, weight2, xy / (xx + weight2 / noise2) FROM (
    SELECT i, xx, xy, (noise * xx / (weight + noise * xx) + 2e-6) / (w * w + 2e-6) AS weight2,
      (n - noise * xx / (weight + noise * xx) + 2e-6) / (yy - 2 * w * xy + xx * w * w + 2e-6) AS noise2
    FROM r, s WHERE i < {BAYESIAN_ROUNDS}))
SELECT 'l_quantity' AS term, round(w, 3) AS value FROM r WHERE i = {BAYESIAN_ROUNDS}
UNION ALL SELECT '_intercept', round(my - w * mx, 3) FROM r, s WHERE i = {BAYESIAN_ROUNDS}"""

# the feature with the larger sum of centred products, alone
PURSUIT = f"""
WITH t AS ({TRAIN}),
c AS (SELECT 'l_quantity' AS f, {SXY} AS p, {SXX} AS q, avg(l_quantity) AS m, avg(l_extendedprice) AS my FROM t
  UNION ALL SELECT 'l_tax', regr_sxy(l_extendedprice, l_tax), regr_sxx(l_extendedprice, l_tax), avg(l_tax), avg(l_extendedprice) FROM t),
b AS (SELECT *, row_number() OVER (ORDER BY abs(p) DESC) AS place FROM c)
SELECT f AS term, CASE WHEN place = 1 THEN round(p / q, 5) ELSE CAST(0 AS DOUBLE) END AS value FROM b
UNION ALL SELECT '_intercept', round(my - p / q * m, 5) FROM b WHERE place = 1"""


def _two_features() -> str:
    """Least squares with two features from the covariances."""
    return f"""
WITH t AS ({TRAIN}),
c AS (SELECT var_pop(l_quantity) AS a, var_pop(l_tax) AS b, covar_pop(l_quantity, l_tax) AS m, covar_pop(l_quantity, l_extendedprice) AS p,
  covar_pop(l_tax, l_extendedprice) AS q, avg(l_quantity) AS mx, avg(l_tax) AS mz, avg(l_extendedprice) AS my FROM t),
w AS (SELECT *, (p * b - q * m) / (a * b - m * m) AS w1, (q * a - p * m) / (a * b - m * m) AS w2 FROM c)
SELECT 'l_quantity' AS term, round(w1, 5) AS value FROM w UNION ALL SELECT 'l_tax', round(w2, 5) FROM w
UNION ALL SELECT '_intercept', round(my - w1 * mx - w2 * mz, 5) FROM w"""


def fit_flow(spark, d):
    """All scores of a fit: train metrics, test metrics, residual statistics."""
    fitted = M.fit(_lines(spark, d), "key", "linear_regression", "l_extendedprice", ["l_quantity"])
    return rounded(fitted.metrics_frame(spark).unionByName(fitted.diagnostics_frame(spark)), 3)


FIT_FLOW = f"""
WITH t AS ({TRAIN}), s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM t),
e AS (SELECT l_extendedprice AS y, l_extendedprice - (a + b * l_quantity) AS e FROM t, s),
v AS (SELECT l_extendedprice AS y, l_extendedprice - (a + b * l_quantity) AS e FROM ({LINES}), s WHERE {u_sql(42, 'split', 0, 'key')} < 0.2)
SELECT metric, round(value, 3) AS value FROM (
SELECT 'r2' AS metric, 1 - avg(e * e) / var_pop(y) AS value FROM e
UNION ALL SELECT 'mae', avg(abs(e)) FROM e UNION ALL SELECT 'rmse', sqrt(avg(e * e)) FROM e UNION ALL SELECT 'mse', avg(e * e) FROM e
UNION ALL SELECT 'explained_variance', 1 - var_pop(e) / var_pop(y) FROM e UNION ALL SELECT 'median_ae', median(abs(e)) FROM e
UNION ALL SELECT 'max_error', max(abs(e)) FROM e UNION ALL SELECT 'mape', avg(abs(e) / abs(y)) FROM e
UNION ALL SELECT 'test_r2', 1 - avg(e * e) / var_pop(y) FROM v UNION ALL SELECT 'test_mae', avg(abs(e)) FROM v
UNION ALL SELECT 'test_rmse', sqrt(avg(e * e)) FROM v
UNION ALL SELECT 'residuals_mean', avg(e) FROM v UNION ALL SELECT 'residuals_std', stddev_pop(e) FROM v
UNION ALL SELECT 'residuals_min', min(e) FROM v UNION ALL SELECT 'residuals_max', max(e) FROM v)"""


def _scored(spark, d):
    """A fixed prediction, so that scores can be checked on their own."""
    return table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("y"), (F.col("c_nationkey") * 300.0).alias("p"))


SCORED = "SELECT c_custkey, c_acctbal AS y, c_nationkey * CAST(300 AS DOUBLE) AS p FROM customer"


def regression_metrics(spark, d):
    return rounded(A.regression_metrics(_scored(spark, d), "y", "p"), 4)


REGRESSION_METRICS = f"""
WITH t AS (SELECT y, y - p AS e FROM ({SCORED}))
SELECT metric, round(value, 4) AS value FROM (
SELECT 'r2' AS metric, 1 - avg(e * e) / var_pop(y) AS value FROM t UNION ALL SELECT 'mae', avg(abs(e)) FROM t
UNION ALL SELECT 'rmse', sqrt(avg(e * e)) FROM t UNION ALL SELECT 'mse', avg(e * e) FROM t
UNION ALL SELECT 'explained_variance', 1 - var_pop(e) / var_pop(y) FROM t UNION ALL SELECT 'median_ae', median(abs(e)) FROM t
UNION ALL SELECT 'max_error', max(abs(e)) FROM t UNION ALL SELECT 'mape', CASE WHEN count(*) FILTER (y = 0) = 0 THEN avg(abs(e) / abs(y)) END FROM t)
WHERE metric <> 'mape' OR value IS NOT NULL"""


def residual_stats(spark, d):
    return rounded(A.residual_stats(_scored(spark, d), "y", "p"), 5)


def residual_columns(spark, d):
    df = _scored(spark, d).withColumn("p", F.when(F.col("p") > 1000, F.col("p")))
    return rounded(A.residuals(df, "y", "p"))


def predict_ols(spark, d):
    """Prediction for every row; rows without the feature keep NULL."""
    lines = _lines(spark, d)
    fitted = M.fit(lines, "key", "linear_regression", "l_extendedprice", ["l_quantity"], split_spec=ALL)
    gaps = lines.withColumn("l_quantity", F.when(F.col("l_quantity") > 5, F.col("l_quantity")))
    return rounded(M.predict(fitted, gaps).select("key", "_prediction"), 4)


PREDICT_OLS = f"""
WITH t AS ({LINES}), s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM t)
SELECT key, CASE WHEN l_quantity > 5 THEN round(a + b * l_quantity, 4) END AS _prediction FROM t, s"""


def _ml(model, **params):
    """Scores of a fit on the line items."""

    def run(spark, d):
        fitted = M.fit(_lines(spark, d), "key", model, "l_extendedprice", ["l_quantity", "l_tax", "l_discount"], params)
        return rounded(fitted.metrics_frame(spark).unionByName(fitted.diagnostics_frame(spark)), 4)

    return run


def _stump(model, **params):
    """A single split on the tax rate: few distinct values, so every split is a candidate."""

    def run(spark, d):
        lines = _lines(spark, d).select("key", "l_tax", (F.col("l_extendedprice") * F.col("l_tax") * F.col("l_tax")).alias("y"))
        fitted = M.fit(lines, "key", model, "y", ["l_tax"], {"max_depth": 1, **params}, ALL)
        scored = M.predict(fitted, lines).groupBy("l_tax").agg(F.count(F.lit(1)).alias("n"), F.max("_prediction").alias("prediction"))
        return rounded(scored, 5)

    return run


def tree_shape(spark, d):
    """Depth, leaves and importance of a single split, next to the number of training rows."""
    lines = _lines(spark, d).select("key", "l_tax", (F.col("l_extendedprice") * F.col("l_tax")).alias("y"))
    fitted = M.fit(lines, "key", "decision_tree_regressor", "y", ["l_tax"], {"max_depth": 1}, ALL)
    shape = fitted.diagnostics_frame(spark).filter(F.col("metric").isin("tree_depth", "n_leaves"))
    importance = fitted.coefficients_frame(spark).withColumnRenamed("term", "metric")
    rows = lines.agg(F.lit("rows").alias("metric"), F.count("y").cast("double").alias("value"))
    return rounded(shape.unionByName(importance).unionByName(rows), 5)


TREE_SHAPE = """
WITH t AS (SELECT count(*) AS n, CAST(count(DISTINCT l_tax) > 1 AS INTEGER) AS split FROM lineitem)
SELECT 'tree_depth' AS metric, CAST(split AS DOUBLE) AS value FROM t UNION ALL SELECT 'n_leaves', 1 + split FROM t
UNION ALL SELECT 'l_tax_importance', split FROM t UNION ALL SELECT 'rows', n FROM t"""


def huber_wide(spark, d):
    """With a bound no residual reaches and no penalty, the Huber fit is least squares."""
    lines = _lines(spark, d).withColumn("y", F.col("l_extendedprice") / 10_000)
    fitted = M.fit(lines, "key", "huber_regressor", "y", ["l_quantity"], {"epsilon": 1e4, "alpha": 0.0, "max_iter": 500, "tol": 1e-10}, ALL)
    return rounded(fitted.coefficients_frame(spark), 3)


HUBER_WIDE = """
SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice / 10000, l_quantity), 3) AS value FROM lineitem
UNION ALL SELECT '_intercept', round(regr_intercept(l_extendedprice / 10000, l_quantity), 3) FROM lineitem"""


OUTLIERS = "(l_linenumber * 7 + l_partkey) % 10 < 3"  # nearly a third of all rows, far off
HUBER_ROUNDS = 15


def huber(spark, d):
    """A fit among many outliers: weights, scale, scores on both parts and residual statistics."""
    li = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000 + F.when(F.expr(OUTLIERS), 400 - F.col("l_quantity") * 5).otherwise(0))
    lines = _lines(spark, d, li, "y")
    fitted = M.fit(lines, "key", "huber_regressor", "y", ["l_quantity"], {"max_iter": HUBER_ROUNDS, "tol": 0.0})
    found = fitted.metrics_frame(spark).unionByName(fitted.diagnostics_frame(spark).filter("metric <> 'n_iterations'"))
    return rounded(found.unionByName(fitted.coefficients_frame(spark).withColumnRenamed("term", "metric")), 4)


def _huber_sql(epsilon: float = 1.35, alpha: float = 0.0001) -> str:
    """The rounds one by one: weights and scale of each from the sums of the one before."""
    rows = f"""SELECT x, y, NOT {u_sql(42, 'split', 0, 'key')} < 0.2 AS train FROM (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT)) AS key, CAST(l_quantity AS DOUBLE) AS x,
    l_extendedprice / 1000 + CASE WHEN {OUTLIERS} THEN 400 - l_quantity * 5 ELSE 0 END AS y FROM lineitem)"""
    ctes = [f"a AS MATERIALIZED ({rows})", "t AS MATERIALIZED (SELECT x, y FROM a WHERE train)"]
    ctes.append("""s0 AS MATERIALIZED (SELECT w, c, (SELECT sqrt(avg((y - c - w * x) * (y - c - w * x))) FROM t) AS scale, 0 AS n_out
  FROM (SELECT regr_slope(y, x) AS w, regr_intercept(y, x) AS c FROM t))""")
    for k in range(1, HUBER_ROUNDS + 1):
        ctes.append(f"""s{k} AS MATERIALIZED (SELECT w, (sy - w * sx) / su AS c, sqrt(v) AS scale, n_out FROM (
  SELECT *, (su * sxy - sx * sy) / (su * (sxx + {alpha} * scale) - sx * sx) AS w FROM (
    SELECT sum(u) AS su, sum(u * x) AS sx, sum(u * y) AS sy, sum(u * x * x) AS sxx, sum(u * x * y) AS sxy, max(scale) AS scale,
      avg(least(r, {epsilon} * scale) * least(r, {epsilon} * scale)) AS v, count(*) FILTER (r > {epsilon} * scale) AS n_out FROM (
      SELECT *, CASE WHEN r <= {epsilon} * scale THEN 1 ELSE {epsilon} * scale / r END AS u FROM (
        SELECT x, y, scale, abs(y - c - w * x) AS r FROM t, s{k - 1})))))""")
    return "WITH " + ", ".join(ctes) + f""",
z AS (SELECT * FROM s{HUBER_ROUNDS}), e AS (SELECT y, y - (c + w * x) AS e FROM t, z), o AS (SELECT y, y - (c + w * x) AS e FROM a, z WHERE NOT train)
SELECT metric, round(value, 4) AS value FROM (
SELECT 'r2' AS metric, 1 - avg(e * e) / var_pop(y) AS value FROM e
UNION ALL SELECT 'mae', avg(abs(e)) FROM e UNION ALL SELECT 'rmse', sqrt(avg(e * e)) FROM e UNION ALL SELECT 'mse', avg(e * e) FROM e
UNION ALL SELECT 'explained_variance', 1 - var_pop(e) / var_pop(y) FROM e UNION ALL SELECT 'median_ae', median(abs(e)) FROM e
UNION ALL SELECT 'max_error', max(abs(e)) FROM e UNION ALL SELECT 'mape', avg(abs(e) / abs(y)) FROM e
UNION ALL SELECT 'test_r2', 1 - avg(e * e) / var_pop(y) FROM o UNION ALL SELECT 'test_mae', avg(abs(e)) FROM o UNION ALL SELECT 'test_rmse', sqrt(avg(e * e)) FROM o
UNION ALL SELECT 'residuals_mean', avg(e) FROM o UNION ALL SELECT 'residuals_std', stddev_pop(e) FROM o
UNION ALL SELECT 'residuals_min', min(e) FROM o UNION ALL SELECT 'residuals_max', max(e) FROM o
UNION ALL SELECT 'scale', scale FROM z UNION ALL SELECT 'n_outliers', n_out FROM z
UNION ALL SELECT 'l_quantity', w FROM z UNION ALL SELECT '_intercept', c FROM z)"""


def _two_slopes(spark, d):
    """A target that two features explain, quantity more than tax."""
    y = F.col("l_extendedprice") / 1000 + F.col("l_tax") * 200
    return _lines(spark, d).select("key", F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_tax") * 100).alias("tax"), y.alias("y"))


TWO_SLOPES = f"SELECT key, CAST(l_quantity AS DOUBLE) AS quantity, l_tax * 100 AS tax, l_extendedprice / 1000 + l_tax * 200 AS y FROM ({LINES})"


def lars_path(spark, d):
    """All knots of the path of least angles."""
    knots = M.angle_knots(_two_slopes(spark, d), "y", ["quantity", "tax"])
    return rounded(knots, 6)


# first the feature with the larger product alone, until the other one's product is as large; then both, to least squares
LARS_PATH = f"""
WITH m AS (SELECT regr_sxx(y, quantity) / count(*) AS q, regr_sxx(y, tax) / count(*) AS t, covar_pop(quantity, tax) AS qt, covar_pop(quantity, y) AS qy, covar_pop(tax, y) AS ty FROM ({TWO_SLOPES})),
o AS (SELECT abs(qy) >= abs(ty) AS quantity_first, greatest(abs(qy), abs(ty)) AS top, CASE WHEN abs(qy) >= abs(ty) THEN qy ELSE ty END AS c1,
  CASE WHEN abs(qy) >= abs(ty) THEN ty ELSE qy END AS c2, CASE WHEN abs(qy) >= abs(ty) THEN q ELSE t END AS g1, qt, q, t, qy, ty FROM m),
r AS (SELECT *, sign(c1) / g1 AS d, qt * sign(c1) / g1 AS a FROM o),
k AS (SELECT *, least(CASE WHEN a < 1 THEN (top - c2) / (1 - a) ELSE 'inf' END, CASE WHEN a > -1 THEN (top + c2) / (1 + a) ELSE 'inf' END) AS step FROM r)
SELECT knot, round(alpha, 6) AS alpha, term, round(weight, 6) AS weight FROM (
SELECT 0 AS knot, top AS alpha, 'quantity' AS term, CAST(0 AS DOUBLE) AS weight FROM k UNION ALL SELECT 0, top, 'tax', 0 FROM k
UNION ALL SELECT 1, top - step, 'quantity', CASE WHEN quantity_first THEN step * d ELSE 0 END FROM k
UNION ALL SELECT 1, top - step, 'tax', CASE WHEN quantity_first THEN 0 ELSE step * d END FROM k
UNION ALL SELECT 2, 0, 'quantity', (qy * t - ty * qt) / (q * t - qt * qt) FROM k
UNION ALL SELECT 2, 0, 'tax', (ty * q - qy * qt) / (q * t - qt * qt) FROM k)"""


# the split with the least squared error left
STUMP = f"""
WITH t AS (SELECT l_tax, l_extendedprice * l_tax * l_tax AS y FROM ({LINES})), c AS (SELECT DISTINCT l_tax AS cut FROM t),
s AS (SELECT cut, sum(y) FILTER (l_tax <= cut) AS sl, count(*) FILTER (l_tax <= cut) AS nl, sum(y) FILTER (l_tax > cut) AS sr, count(*) FILTER (l_tax > cut) AS nr FROM t, c GROUP BY cut),
b AS (SELECT * FROM s WHERE nr > 0 ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1)
SELECT l_tax, count(*) AS n, round(CASE WHEN l_tax <= max(cut) THEN max(sl / nl) ELSE max(sr / nr) END, 5) AS prediction FROM t, b GROUP BY l_tax"""


def _coded(spark, d):
    """Line items with a target of several features and, in two of them, missing values."""
    y = F.col("l_extendedprice") / 1000 * (1 + F.col("l_tax") * 4) + F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(F.col("l_tax") * 100)
    discount = F.when(F.col("l_quantity") != 7, F.col("l_discount"))
    tax = F.when(F.col("l_quantity") < 44, F.col("l_tax"))
    return _lines(spark, d).select("key", "l_quantity", discount.alias("discount"), tax.alias("tax"), y.alias("y"))


CODED = f"""SELECT key, l_quantity, CASE WHEN l_quantity <> 7 THEN l_discount END AS discount, CASE WHEN l_quantity < 44 THEN l_tax END AS tax,
  l_extendedprice / 1000 * (1 + l_tax * 4) + CASE WHEN l_discount > 0.05 THEN l_quantity ELSE l_tax * 100 END AS y FROM ({LINES})"""


def _grown(rows: str, features: list[str], depth: int, least: int, rounds: int = 1, rate: float = 1.0, missing: bool = False, train: str = "TRUE") -> str:
    """CTEs that grow trees of `depth` levels one split at a time from the counts and sums of every value; the last one, `r{rounds}`, holds p, the prediction of each row.

    A split puts values up to `cut` to the left; where values are missing both sides are tried for them. Rows that fail `train` are only predicted.
    """
    ctes = [f"r0 AS (SELECT *, {f'(SELECT avg(y) FROM rows_ WHERE {train})' if rounds > 1 or rate < 1 else 'CAST(0 AS DOUBLE)'} AS p FROM rows_)", ]
    for k in range(1, rounds + 1):
        ctes.append(f"n{k}_0 AS (SELECT *, 1 AS node, y - p AS rest FROM r{k - 1})")
        for level in range(depth):
            at = f"{k}_{level}"
            cells = " UNION ALL ".join(f"SELECT node, {i} AS f, CAST({c} AS DOUBLE) AS v, count(*) AS n, sum(rest) AS g FROM n{at} WHERE {train} GROUP BY node, {c}" for i, c in enumerate(features))
            ctes.append(f"c{at} AS ({cells})")
            sides = "(VALUES (FALSE), (TRUE)) m(left_)" if missing else "(VALUES (FALSE)) m(left_)"
            ctes.append(f"""s{at} AS (
  SELECT node, f, v AS cut, left_, sum(n) OVER w + CASE WHEN left_ THEN coalesce(mn, 0) ELSE 0 END AS ln, sum(g) OVER w + CASE WHEN left_ THEN coalesce(mg, 0) ELSE 0 END AS lg, tn, tg
  FROM c{at} JOIN (SELECT node, f, sum(n) AS tn, sum(g) AS tg, sum(n) FILTER (v IS NULL) AS mn, sum(g) FILTER (v IS NULL) AS mg FROM c{at} GROUP BY node, f) USING (node, f), {sides}
  WHERE v IS NOT NULL AND (NOT left_ OR mn > 0)
  WINDOW w AS (PARTITION BY node, f, left_ ORDER BY v))""")
            ctes.append(f"""b{at} AS (
  SELECT node, f, cut, left_ FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, left_, cut) AS place FROM (
      SELECT *, lg * lg / ln + (tg - lg) * (tg - lg) / (tn - ln) - tg * tg / tn AS gain FROM s{at} WHERE ln >= {least} AND tn - ln >= {least})
    WHERE gain > 1e-9) WHERE place = 1)""")
            value = "CASE f " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(features)) + " END"
            ctes.append(f"""n{k}_{level + 1} AS (
  SELECT n{at}.* EXCLUDE (node), CASE WHEN f IS NULL THEN n{at}.node WHEN coalesce({value} <= cut, left_) THEN 2 * n{at}.node ELSE 2 * n{at}.node + 1 END AS node
  FROM n{at} LEFT JOIN b{at} ON b{at}.node = n{at}.node)""")
        ctes.append(f"r{k} AS (SELECT t.* EXCLUDE (node, rest, p), p + {rate} * avg(rest) FILTER ({train}) OVER (PARTITION BY node) AS p, node AS leaf FROM n{k}_{depth} t)".replace("EXCLUDE (node, rest, p)", "EXCLUDE (node, rest, p, leaf)" if k > 1 else "EXCLUDE (node, rest, p)"))
    return f"WITH rows_ AS ({rows}), " + ", ".join(ctes)


def tree_levels(spark, d):
    """Three levels of splits on three features of few values: every leaf's rows, and the tree's shape."""
    rows = _coded(spark, d).filter("discount IS NOT NULL AND tax IS NOT NULL")
    fitted = M.fit(rows, "key", "decision_tree_regressor", "y", ["l_quantity", "discount", "tax"], {"max_depth": 3, "min_samples_leaf": 5}, ALL)
    scored = M.predict(fitted, rows)
    leaves = scored.groupBy(F.round(M.PREDICTION, 5).alias("prediction")).agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return leaves.withColumns({"low": F.col("low").cast("double"), "high": F.col("high").cast("double"), "n_leaves": F.lit(fitted.diagnostics["n_leaves"])})


TREE_LEVELS = _grown(f"SELECT * FROM ({CODED}) WHERE discount IS NOT NULL AND tax IS NOT NULL", ["l_quantity", "discount", "tax"], 3, 5) + """
SELECT round(p, 5) AS prediction, count(*) AS n, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high,
  CAST((SELECT count(DISTINCT leaf) FROM r1) AS DOUBLE) AS n_leaves FROM r1 GROUP BY 1"""

_FEATURES = ["l_quantity", "l_tax", "l_discount"]
TREE = _grown(f"SELECT *, l_extendedprice AS y, NOT {u_sql(42, 'split', 0, 'key')} < 0.2 AS train FROM ({LINES})", _FEATURES, 4, 1, train="train") + """,
e AS (SELECT y, y - p AS e FROM r1 WHERE train), v AS (SELECT y, y - p AS e FROM r1 WHERE NOT train)
SELECT metric, round(value, 4) AS value FROM (
SELECT 'r2' AS metric, 1 - avg(e * e) / var_pop(y) AS value FROM e
UNION ALL SELECT 'mae', avg(abs(e)) FROM e UNION ALL SELECT 'rmse', sqrt(avg(e * e)) FROM e UNION ALL SELECT 'mse', avg(e * e) FROM e
UNION ALL SELECT 'explained_variance', 1 - var_pop(e) / var_pop(y) FROM e UNION ALL SELECT 'median_ae', median(abs(e)) FROM e
UNION ALL SELECT 'max_error', max(abs(e)) FROM e UNION ALL SELECT 'mape', avg(abs(e) / abs(y)) FROM e
UNION ALL SELECT 'test_r2', 1 - avg(e * e) / var_pop(y) FROM v UNION ALL SELECT 'test_mae', avg(abs(e)) FROM v UNION ALL SELECT 'test_rmse', sqrt(avg(e * e)) FROM v
UNION ALL SELECT 'residuals_mean', avg(e) FROM v UNION ALL SELECT 'residuals_std', stddev_pop(e) FROM v
UNION ALL SELECT 'residuals_min', min(e) FROM v UNION ALL SELECT 'residuals_max', max(e) FROM v
UNION ALL SELECT 'n_leaves', count(DISTINCT leaf) FROM r1 WHERE train UNION ALL SELECT 'tree_depth', max(floor(log2(leaf))) FROM r1 WHERE train)"""

BOOSTED = {"max_depth": 2, "min_samples_leaf": 20, "max_iter": 4, "learning_rate": 0.3, "early_stopping": False}


def gbt_rounds(spark, d):
    """Four rounds of two levels, on rows of which many miss a feature: mean prediction by the features' presence and quantity."""
    rows = _coded(spark, d)
    fitted = M.fit(rows, "key", "hist_gradient_boosting_regressor", "y", ["l_quantity", "discount", "tax"], BOOSTED, ALL)
    scored = M.predict(fitted, rows).groupBy("l_quantity", F.col("discount").isNull().alias("no_discount"), F.col("tax").isNull().alias("no_tax"))
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), F.avg(M.PREDICTION).alias("prediction"), F.max(M.PREDICTION).alias("largest")), 5)


GBT_ROUNDS = _grown(CODED, ["l_quantity", "discount", "tax"], 2, 20, 4, 0.3, True) + """
SELECT l_quantity, discount IS NULL AS no_discount, tax IS NULL AS no_tax, count(*) AS n, round(avg(p), 5) AS prediction, round(max(p), 5) AS largest
FROM r4 GROUP BY 1, 2, 3"""


def fits_page(spark, d):
    """A listing of many fits (price on quantity for every supplier), newest first, one page."""
    fits = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept")
    )
    rows, total = P.page(fits, [F.col("l_suppkey").desc()], 10, 20, key=["l_suppkey"])
    return rounded(rows.withColumn("total", F.lit(total).cast("long")), 4)


FITS_PAGE = """
WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(slope, 4) AS slope, round(intercept, 4) AS intercept, (SELECT count(*) FROM f) AS total FROM f ORDER BY l_suppkey DESC LIMIT 20 OFFSET 10"""


@dataclass
class MeanModel:
    """Predicts the mean of the target."""

    value: float

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn(M.PREDICTION, F.lit(self.value))

    def coefficients(self) -> dict[str, float]:
        return {"_intercept": self.value}

    def details(self) -> dict[str, float]:
        return {}


def custom_model(spark, d):
    M.register_model("mean", lambda df, target, features, params: MeanModel(df.agg(F.avg(target)).first()[0]))
    fitted = M.fit(_lines(spark, d), "key", "mean", "l_extendedprice", [], split_spec=ALL)
    return rounded(fitted.coefficients_frame(spark).withColumn("mae", F.lit(fitted.metrics["mae"])), 5)


CHECKS = {
    "ols_coefficients": (_coefficients("linear_regression", ("l_quantity", "l_tax")), _two_features()),
    "ols_no_intercept": (_coefficients("linear_regression", fit_intercept=False), _through_origin(0)),
    "ridge_no_intercept": (_coefficients("ridge", alpha=50.0, fit_intercept=False), _through_origin(50)),
    "ridge": (_coefficients("ridge", alpha=50.0), _one_feature(f"{SXY} / ({SXX} + 50)")),
    "lasso": (
        _coefficients("lasso", alpha=100.0),
        _one_feature(f"sign({SXY}) * greatest(abs({SXY}) / count(*) - 100, 0) / ({SXX} / count(*))"),
    ),
    "elastic_net": (
        _coefficients("elastic_net", alpha=10.0, l1_ratio=0.3),
        _one_feature(f"sign({SXY}) * greatest(abs({SXY}) / count(*) - CAST(10 * 0.3 AS DOUBLE), 0) / ({SXX} / count(*) + CAST(10 * 0.7 AS DOUBLE))"),
    ),
    "bayesian_ridge": (_coefficients("bayesian_ridge", digits=3, max_iter=BAYESIAN_ROUNDS, tol=0.0), BAYESIAN_RIDGE),
    "matching_pursuit": (_coefficients("orthogonal_matching_pursuit", ("l_tax", "l_quantity"), n_nonzero_coefs=1), PURSUIT),
    "fit_flow": (fit_flow, FIT_FLOW),
    "regression_metrics": (regression_metrics, REGRESSION_METRICS),
    "residual_stats": (
        residual_stats,
        f"""WITH t AS (SELECT y - p AS e FROM ({SCORED})) SELECT 'residuals_mean' AS metric, round(avg(e), 5) AS value FROM t
        UNION ALL SELECT 'residuals_std', round(stddev_pop(e), 5) FROM t UNION ALL SELECT 'residuals_min', round(min(e), 5) FROM t
        UNION ALL SELECT 'residuals_max', round(max(e), 5) FROM t""",
    ),
    "residual_columns": (
        residual_columns,
        f"SELECT c_custkey, round(y, 6) AS y, p, round(y - p, 6) AS _residual, round(abs(y - p), 6) AS _abs_error FROM ({SCORED}) WHERE p > 1000",
    ),
    "predict_ols": (predict_ols, PREDICT_OLS),
    "tree": (_ml("decision_tree_regressor", max_depth=4), TREE),
    "forest": (_ml("random_forest_regressor", n_estimators=10, max_depth=4), None),
    "gbt": (_ml("gradient_boosting_regressor", n_estimators=5, max_depth=3), None),
    "huber": (huber, _huber_sql()),
    "huber_features": (_ml("huber_regressor", max_iter=50), None),
    "lars": (_coefficients("lars", n_nonzero_coefs=2, features=("l_quantity", "l_tax")), _two_features()),
    "lars_path": (lars_path, LARS_PATH),
    "lasso_lars": (
        _coefficients("lasso_lars", alpha=100.0),
        _one_feature(f"sign({SXY}) * greatest(abs({SXY}) / count(*) - 100, 0) / ({SXX} / count(*))"),
    ),
    "huber_wide": (huber_wide, HUBER_WIDE),
    "tree_shape": (tree_shape, TREE_SHAPE),
    "tree_levels": (tree_levels, TREE_LEVELS),
    "gbt_rounds": (gbt_rounds, GBT_ROUNDS),
    "tree_stump": (_stump("decision_tree_regressor"), STUMP),
    "forest_single": (_stump("random_forest_regressor", n_estimators=1, bootstrap=False), STUMP),
    "gbt_single": (_stump("gradient_boosting_regressor", n_estimators=1), STUMP),
    "fits_page": (fits_page, FITS_PAGE),
    "custom_model": (
        custom_model,
        "SELECT '_intercept' AS term, round(m, 5) AS value, round((SELECT avg(abs(l_extendedprice - m)) FROM lineitem), 5) AS mae FROM (SELECT avg(l_extendedprice) AS m FROM lineitem)",
    ),
}
