"""Checks of profiles, correlations, histograms, constraints and key figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulane.operators import kpi as K
from tabulane.operators import profile as A
from tabulane.operators import quality as Q
from tabulane.queries.base import rounded, table
from tabulane.queries.tables import AS_OF
from tabulane.sources.tables import infer_schema

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def infer_schema_orders(spark, d):
    """Logical types, next to the missing values of each column."""
    od = table(spark, d, "orders")
    nulls = A.profile_nulls(od).select(F.col("column").alias("name"), "rows", "null_count")
    return infer_schema(od).join(F.broadcast(nulls), "name")


INFER_ORDERS = """
SELECT name, dtype, (SELECT count(*) FROM orders) AS rows, CAST(0 AS BIGINT) AS null_count
FROM (VALUES ('o_orderkey', 'int'), ('o_custkey', 'int'), ('o_orderstatus', 'string'), ('o_totalprice', 'float'),
  ('o_orderdate', 'datetime'), ('o_orderpriority', 'string')) AS t(name, dtype)"""


def _gaps(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("view")).alias("kind"),
        F.when(F.col("value") >= 20, F.col("value")).alias("value"),
        (F.col("value") > 50).alias("large"),
    )


GAPS = "SELECT event_id, NULLIF(event_type, 'view') AS kind, CASE WHEN value >= 20 THEN value END AS value, value > 50 AS large FROM events"


def profile_lineitem(spark, d):
    return rounded(A.profile_numeric(table(spark, d, "lineitem"), NUMBERS), 5)


def _numeric_sql(col: str, source: str) -> str:
    c = f"CAST({col} AS DOUBLE)"
    return (
        f"SELECT '{col}' AS \"column\", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min, "
        f"round(max({c}), 5) AS max, round(median({c}), 5) AS median FROM {source}"
    )


PROFILE_LINEITEM = " UNION ALL ".join(_numeric_sql(c, "lineitem") for c in NUMBERS)


def profile_events(spark, d):
    return rounded(A.profile(_gaps(spark, d)), 5)


PROFILE_EVENTS = f"""
WITH g AS ({GAPS}), n AS ({_numeric_sql('event_id', 'g')} UNION ALL {_numeric_sql('value', 'g')}),
k AS (SELECT 'event_id' AS "column", 'int' AS dtype, count(*) AS rows, count(*) - count(event_id) AS null_count FROM g
  UNION ALL SELECT 'kind', 'string', count(*), count(*) - count(kind) FROM g
  UNION ALL SELECT 'value', 'float', count(*), count(*) - count(value) FROM g
  UNION ALL SELECT 'large', 'bool', count(*), count(*) - count(large) FROM g)
SELECT k."column" AS "column", dtype, rows, null_count, round(null_count / CAST(rows AS DOUBLE), 5) AS null_rate, mean, std, min, max, median
FROM k LEFT JOIN n ON k."column" = n."column" """


def profile_full(spark, d):
    return rounded(A.profile_full(_gaps(spark, d)), 5)


def profile_nulls(spark, d):
    return rounded(A.profile_nulls(_gaps(spark, d)))


PROFILE_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_rate FROM ({GAPS})"
    for c in ("event_id", "kind", "value", "large")
)


def profile_categories(spark, d):
    return rounded(A.profile_categories(_gaps(spark, d)))


PROFILE_CATEGORIES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS category, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS rate FROM ({GAPS}) WHERE {c} IS NOT NULL GROUP BY 2"
    for c in ("kind", "large")
)


def detect_types(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", (F.col("value") > 50).alias("large"))
    return A.detect_types(ev, "event_id")


def _detect_sql(col: str) -> str:
    return f"SELECT '{col}' AS \"column\", CASE WHEN count(DISTINCT {col}) < 0.2 * count(*) THEN 'category' ELSE 'string' END AS dtype FROM (SELECT {col} FROM events ORDER BY event_id LIMIT 100)"


DETECT_TYPES = f"""
SELECT 'event_id' AS "column", 'int' AS dtype UNION ALL SELECT 'user_id', 'int' UNION ALL SELECT 'large', 'bool'
UNION ALL SELECT 'value', CASE WHEN bool_and(value = floor(value)) THEN 'int' ELSE 'float' END FROM (SELECT value FROM events ORDER BY event_id LIMIT 100)
UNION ALL {_detect_sql('event_type')} UNION ALL {_detect_sql('props')}"""


def correlation(spark, d):
    return rounded(A.correlation(_gaps(spark, d), "event_id", "value"))


def correlation_matrix(spark, d):
    return rounded(A.correlation_matrix(table(spark, d, "lineitem"), NUMBERS))


CORRELATION_MATRIX = " UNION ALL ".join(
    f"SELECT '{x}' AS col_x, '{y}' AS col_y, round(regr_sxy({y}, {x}) / sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 6) AS r, count(*) AS n FROM lineitem"
    for x in NUMBERS
    for y in NUMBERS
)


def histogram(spark, d):
    return rounded(A.histogram(table(spark, d, "customer"), "c_acctbal"))


def histogram_grouped(spark, d):
    """Grouped by a category with missing values."""
    ev = table(spark, d, "events").select("value", F.nullif("event_type", F.lit("view")).alias("kind"))
    return rounded(A.histogram(ev, "value", 12, by="kind"))


def _histogram_sql(source: str, col: str, category: str, bins: int) -> str:
    return f"""
WITH t AS (SELECT {col} AS v, {category} AS category FROM {source} WHERE {col} IS NOT NULL),
s AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins} AS w FROM t),
h AS (SELECT category, CAST(least(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM t, s GROUP BY 1, 2),
c AS (SELECT DISTINCT category FROM t), g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT g.bin AS bin, round(lo + g.bin * w, 6) AS start, round(lo + (g.bin + 1) * w, 6) AS "end", c.category AS category, coalesce(h.n, 0) AS n,
  CAST(coalesce(sum(h.n) OVER (PARTITION BY g.bin), 0) AS BIGINT) AS total
FROM g CROSS JOIN c CROSS JOIN s LEFT JOIN h ON h.bin = g.bin AND h.category = c.category"""


def group_stats(spark, d):
    return rounded(A.group_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), 5)


def scatter_summary(spark, d):
    return A.scatter_summary(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


SCATTER = """
SELECT 'x_min' AS item, min(l_quantity) AS value, CAST(NULL AS VARCHAR) AS category FROM lineitem
UNION ALL SELECT 'x_max', max(l_quantity), NULL FROM lineitem UNION ALL SELECT 'y_min', min(l_extendedprice), NULL FROM lineitem
UNION ALL SELECT 'y_max', max(l_extendedprice), NULL FROM lineitem
UNION ALL SELECT DISTINCT 'category', CAST(NULL AS DOUBLE), l_returnflag FROM lineitem"""


# constraints --------------------------------------------------------------------------------

RULES = [
    {"type": "range", "target": "o_totalprice", "min": 1000, "max": 400000},
    {"type": "not_null", "target": "priority"},
    {"type": "unique", "target": "o_custkey"},
    {"type": "comparison", "target": "o_custkey", "operator": "<=", "other": "o_orderkey"},
]


def _orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )


FLAGS = """
SELECT o_orderkey, o_custkey, o_totalprice, NULLIF(o_orderpriority, '5-LOW') AS priority,
  o_totalprice BETWEEN 1000 AND 400000 AS a, o_orderpriority <> '5-LOW' AS b,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS c, o_custkey <= o_orderkey AS e FROM orders"""


def constraint_nan(spark, d):
    """NaN is missing: only not_null fails on it."""
    value = F.when(F.col("value") >= 60, F.lit(float("nan"))).when(F.col("value") >= 20, F.col("value"))
    ev = table(spark, d, "events").select("event_id", value.alias("value"), F.lit(30.0).alias("limit"))
    rules = [
        {"type": "not_null", "target": "value"},
        {"type": "range", "target": "value", "max": 50},
        {"type": "comparison", "target": "value", "operator": "<=", "other": "limit"},
    ]
    return rounded(Q.constraint_report(ev, rules))


CONSTRAINT_NAN = """
WITH f AS (SELECT CASE WHEN value >= 20 AND value < 60 THEN value END AS value FROM events),
r AS (SELECT count(*) AS n, count(*) FILTER (value <= 30) AS good, count(*) FILTER (value IS NULL) AS a,
  count(*) FILTER (value > 50) AS b, count(*) FILTER (value > 30) AS c FROM f)
SELECT * FROM (SELECT 'all' AS type, '' AS target, n - good AS failures, round(good / CAST(n AS DOUBLE), 6) AS pass_rate FROM r
UNION ALL SELECT 'not_null', 'value', a, round((n - a) / CAST(n AS DOUBLE), 6) FROM r
UNION ALL SELECT 'range', 'value', b, round((n - b) / CAST(n AS DOUBLE), 6) FROM r
UNION ALL SELECT 'comparison', 'value', c, round((n - c) / CAST(n AS DOUBLE), 6) FROM r)
WHERE type = 'all' OR failures > 0"""


def constraint_report(spark, d):
    return rounded(Q.constraint_report(_orders(spark, d), RULES, "o_orderkey"))


CONSTRAINT_REPORT = f"""
WITH f AS ({FLAGS}), r AS (SELECT count(*) AS n, count(*) FILTER (a AND b AND c AND e) AS good, count(*) FILTER (NOT a) AS fa,
  count(*) FILTER (NOT b) AS fb, count(*) FILTER (NOT c) AS fc, count(*) FILTER (NOT e) AS fe FROM f)
SELECT * FROM (SELECT 'all' AS type, '' AS target, n - good AS failures, round(good / CAST(n AS DOUBLE), 6) AS pass_rate FROM r
UNION ALL SELECT 'range', 'o_totalprice', fa, round((n - fa) / CAST(n AS DOUBLE), 6) FROM r
UNION ALL SELECT 'not_null', 'priority', fb, round((n - fb) / CAST(n AS DOUBLE), 6) FROM r
UNION ALL SELECT 'unique', 'o_custkey', fc, round((n - fc) / CAST(n AS DOUBLE), 6) FROM r
UNION ALL SELECT 'comparison', 'o_custkey', fe, round((n - fe) / CAST(n AS DOUBLE), 6) FROM r)
WHERE type = 'all' OR failures > 0"""


def quarantine(spark, d):
    clean, bad = Q.quarantine(_orders(spark, d), RULES, "o_orderkey")
    bad = bad.select("o_orderkey", F.array_join("_reasons", "; ").alias("reasons"))
    return clean.select("o_orderkey", F.lit("").alias("reasons")).unionByName(bad)


QUARANTINE = f"""
SELECT o_orderkey, concat_ws('; ', CASE WHEN NOT a THEN 'range(o_totalprice)' END, CASE WHEN NOT b THEN 'not_null(priority)' END,
  CASE WHEN NOT c THEN 'unique(o_custkey)' END, CASE WHEN NOT e THEN 'o_custkey <= o_orderkey' END) AS reasons FROM ({FLAGS})"""


def constraint_unique_shared(spark, d):
    """A unique value among rows whose key is shared by several of them."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_partkey") % 1000 * 7 + F.col("l_quantity").cast("long")).alias("code"))
    return Q.check(lines, [{"type": "unique", "target": "code"}], "l_orderkey").withColumnRenamed("_ok_0", "first")


CONSTRAINT_UNIQUE_SHARED = """
SELECT l_orderkey, l_partkey, l_linenumber, code, n = 1 OR (l_orderkey = low AND count(*) OVER (PARTITION BY code, l_orderkey) = 1) AS first
FROM (SELECT *, count(*) OVER w AS n, min(l_orderkey) OVER w AS low FROM (
  SELECT l_orderkey, l_partkey, l_linenumber, l_partkey % 1000 * 7 + CAST(trunc(l_quantity) AS BIGINT) AS code FROM lineitem) WINDOW w AS (PARTITION BY code))"""


def constraint_unique(spark, d):
    flagged = Q.check(_orders(spark, d), [{"type": "unique", "target": "o_custkey"}], "o_orderkey")
    return flagged.select("o_orderkey", F.col("_ok_0").alias("first"))


# key figures --------------------------------------------------------------------------------


def usage_events(ev):
    """The event table in the shape of usage events; every row is kept.

    error is a latency sample; view and signup stand for two usage types each, told apart by k.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when((F.col("event_type") == "view") & (k < 50), "flow_started")
        .when(F.col("event_type") == "view", "visible_actions_snapshot")
        .when(F.col("event_type") == "purchase", "flow_completed")
        .when(F.col("event_type") == "error", "feedback_latency")
        .when((F.col("event_type") == "signup") & (k < 50), "progress_feedback")
        .when(F.col("event_type") == "signup", "manual_orchestration")
        .otherwise(F.col("event_type"))
    )
    metadata = F.to_json(
        F.struct(
            k.alias("count"),
            F.col("value").alias("pointer_travel_px"),
            (k > 30).alias("familiar_pattern"),
            (k < 90).alias("user_initiated"),
        )
    )
    return ev.select(
        F.col("user_id").cast("string").alias("user_id"),
        kind.alias("event_type"),
        F.col("user_id").cast("string").alias("path_id"),
        F.lit(None).cast("string").alias("stage"),
        F.lit(None).cast("string").alias("action"),
        F.col("value").cast("int").alias("latency_ms"),
        metadata.alias("metadata"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


USAGE_EVENTS = """
SELECT *, CASE WHEN event_type = 'view' AND k < 50 THEN 'flow_started' WHEN event_type = 'view' THEN 'visible_actions_snapshot'
  WHEN event_type = 'purchase' THEN 'flow_completed' WHEN event_type = 'error' THEN 'feedback_latency'
  WHEN event_type = 'signup' AND k < 50 THEN 'progress_feedback' WHEN event_type = 'signup' THEN 'manual_orchestration'
  ELSE event_type END AS kind
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

FIGURES = """
  coalesce(CAST(max(k) FILTER (kind = 'visible_actions_snapshot') AS DOUBLE), 0) AS visible_primary_actions,
  coalesce(avg(value), 0) AS avg_pointer_travel_px,
  coalesce(avg(CASE WHEN k > 30 THEN 100.0 ELSE 0.0 END), 0) AS familiar_pattern_coverage_pct,
  coalesce(count(*) FILTER (kind = 'click') / CAST(NULLIF(count(DISTINCT user_id) FILTER (kind = 'click'), 0) AS DOUBLE), 0) AS avg_clicks_happy_path,
  CAST(count(*) FILTER (kind = 'manual_orchestration') AS DOUBLE) AS manual_orchestration_steps,
  least(100, coalesce(count(*) FILTER (kind = 'progress_feedback') / CAST(NULLIF(count(*) FILTER (kind = 'flow_started'), 0) AS DOUBLE) * 100, 0)) AS progress_feedback_coverage_pct,
  coalesce(quantile_cont(trunc(value), CAST(0.95 AS DOUBLE)) FILTER (kind = 'feedback_latency' AND k < 90), 0) AS p95_feedback_latency_ms,
  coalesce(count(*) FILTER (kind = 'flow_completed') / CAST(NULLIF(count(*) FILTER (kind = 'flow_started'), 0) AS DOUBLE) * 100, 0) AS completion_rate_pct"""


def kpi_snapshot(spark, d):
    return rounded(K.kpi_snapshot(usage_events(table(spark, d, "events")), AS_OF, 168))


_SNAPSHOT = f"WITH w AS ({USAGE_EVENTS}), s AS (SELECT {FIGURES} FROM w WHERE ts >= TIMESTAMP '2024-01-24 00:00:00')"
_LONG = " UNION ALL ".join(f"SELECT '{k}' AS kpi, round(CAST({k} AS DOUBLE), 6) AS value FROM s" for k in K.KPIS)


def kpi_gate(spark, d):
    return rounded(K.kpi_gate(K.kpi_snapshot(usage_events(table(spark, d, "events")), AS_OF, 168)))


_GATES = ", ".join(f"('{p}', '{k}', '{op}', CAST({t} AS DOUBLE))" for p, k, op, t in K.GATES)
KPI_GATE = f"""
{_SNAPSHOT}, l AS ({_LONG}), t(phase, kpi, op, target) AS (VALUES {_GATES})
SELECT phase, t.kpi AS kpi, op, target, value, CASE op WHEN '<=' THEN value <= target ELSE value >= target END AS passed
FROM t JOIN l ON t.kpi = l.kpi"""

PROFILE_FULL = " UNION ALL ".join(
    [
        f"SELECT \"column\", '{s}' AS statistic, CAST(NULL AS VARCHAR) AS category, CAST({s} AS DOUBLE) AS value FROM ({PROFILE_EVENTS}) WHERE {s} IS NOT NULL"
        for s in ("rows", "null_count", "null_rate", "mean", "std", "min", "max", "median")
    ]
    + [
        f"SELECT \"column\", '{s}', category, CAST({v} AS DOUBLE) FROM ({PROFILE_CATEGORIES.replace(', 6) AS rate', ', 5) AS rate')})"
        for s, v in (("count", "n"), ("rate", "rate"))
    ]
)

CHECKS = {
    "profile_full": (profile_full, PROFILE_FULL),
    "infer_schema_orders": (infer_schema_orders, INFER_ORDERS),
    "profile_lineitem": (profile_lineitem, PROFILE_LINEITEM),
    "profile_events": (profile_events, PROFILE_EVENTS),
    "profile_nulls": (profile_nulls, PROFILE_NULLS),
    "profile_categories": (profile_categories, PROFILE_CATEGORIES),
    "detect_types": (detect_types, DETECT_TYPES),
    "correlation": (
        correlation,
        f"SELECT 'event_id' AS col_x, 'value' AS col_y, round(corr(value, event_id), 6) AS r, count(value) AS n FROM ({GAPS})",
    ),
    "correlation_matrix": (correlation_matrix, CORRELATION_MATRIX),
    "histogram": (histogram, _histogram_sql("customer", "c_acctbal", "'All'", 20)),
    "histogram_grouped": (
        histogram_grouped,
        _histogram_sql("(SELECT value, NULLIF(event_type, 'view') AS kind FROM events)", "value", "coalesce(kind, 'Unknown')", 12),
    ),
    "group_stats": (
        group_stats,
        "SELECT l_returnflag AS category, count(*) AS n, round(avg(l_extendedprice), 5) AS mean, round(stddev_pop(l_extendedprice), 5) AS std FROM lineitem GROUP BY 1",
    ),
    "scatter_summary": (scatter_summary, SCATTER),
    "constraint_nan": (constraint_nan, CONSTRAINT_NAN),
    "constraint_report": (constraint_report, CONSTRAINT_REPORT),
    "quarantine": (quarantine, QUARANTINE),
    "constraint_unique_shared": (constraint_unique_shared, CONSTRAINT_UNIQUE_SHARED),
    "constraint_unique": (constraint_unique, f"SELECT o_orderkey, c AS first FROM ({FLAGS})"),
    "kpi_snapshot": (kpi_snapshot, f"{_SNAPSHOT} {_LONG}"),
    "kpi_gate": (kpi_gate, KPI_GATE),
}
