"""Checks of selecting, sorting, paging, splitting, lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulane.operators import lookup as L
from tabulane.operators import projection as P
from tabulane.operators.ranking import with_rank
from tabulane.queries.base import table, u_sql

AS_OF = "2024-01-31T00:00:00"


def sort_nulls_last(spark, d):
    """Every row with its position in both directions; missing values, NULL and NaN, come last."""
    value = F.when(F.col("value") >= 60, F.lit(float("nan"))).when(F.col("value") >= 20, F.col("value"))
    ev = table(spark, d, "events").select("event_id", value.alias("value"))
    both = [
        with_rank(ev, P.sort_keys(ev, "value", up, "event_id"), "position").select("event_id", "position", F.lit(name).alias("direction"))
        for up, name in ((True, "up"), (False, "down"))
    ]
    return both[0].unionByName(both[1])


SORT_NULLS_LAST = """
WITH t AS (SELECT event_id, CASE WHEN value >= 20 AND value < 60 THEN value END AS value FROM events)
SELECT event_id, row_number() OVER (ORDER BY value ASC NULLS LAST, event_id) - 1 AS position, 'up' AS direction FROM t
UNION ALL SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1, 'down' FROM t"""


def lookup_large(spark, d):
    """A table of 300 entries, text and numbers mixed, with a default."""
    entries = {str(k): f"part {k}" if k % 3 else k for k in range(1, 301)}
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return L.lookup(li, "l_partkey", entries, "found", default=0)


LOOKUP_LARGE = """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_partkey > 300 THEN '0' WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE 'part ' || l_partkey END AS found FROM lineitem"""


def group_value_nan(spark, d):
    """Largest value per event type where some values are NaN."""
    ev = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("value") >= 60, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return L.group_value(ev, "event_type", F.max("value"), "top", row_key=["event_id"]).select("event_id", "top")


GROUP_VALUE_NAN = "SELECT event_id, max(value) FILTER (value < 60) OVER (PARTITION BY event_type) AS top FROM events"


def preview_orders(spark, d):
    od = P.select_columns(table(spark, d, "orders"), "o_orderkey, o_totalprice")
    return P.preview(od, 200, ["o_orderkey"])


def page_orders(spark, d):
    od = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    rows, total = P.page(od, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100, 50, key=["o_orderkey"])
    return rows.withColumn("total", F.lit(total).cast("long"))


def thin_points(spark, d):
    return P.thin(table(spark, d, "events").select("event_id", "value"), [F.col("event_id")], 1000, key=["event_id"])


def page_deep(spark, d):
    """A page behind half of the table."""
    ev = table(spark, d, "events").select("event_id", "value")
    rows, total = P.page(ev, [F.col("value").desc(), F.col("event_id")], ev.count() // 2, 50, key=["event_id"])
    return rows.withColumn("total", F.lit(total).cast("long"))


PAGE_DEEP = """
SELECT event_id, value, n AS total FROM (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS rn, count(*) OVER () AS n FROM events)
WHERE rn >= n // 2 AND rn < n // 2 + 50"""


THIN_POINTS = """
WITH t AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS rn, CAST(ceil(count(*) OVER () / 1000.0) AS BIGINT) AS k FROM events)
SELECT event_id, value FROM t WHERE rn % k = 0"""


def latest_order_per_customer(spark, d):
    od = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return P.latest_per_key(od, "o_custkey", ["o_orderdate", "o_orderkey"])


LATEST_ORDER = """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""


def trailing_events(spark, d):
    ev = P.trailing_window(table(spark, d, "events"), "ts", 168, AS_OF, event_type="click")
    return ev.select("event_id", "ts", "user_id")


def split_train_test(spark, d):
    od = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    train, test = P.split(od, "o_orderkey", 0.2, 42)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def split_exact(spark, d):
    od = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    train, test = P.split_exact(od, "o_orderkey", 0.2, 42)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


SPLIT_EXACT = f"""
SELECT o_orderkey, o_orderpriority, CASE WHEN place <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT *, row_number() OVER (ORDER BY {u_sql(42, "split_exact", 0, "'+' || o_orderkey")}) AS place, count(*) OVER () AS n FROM orders)"""


def _gaps(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        "event_id",
        F.nullif("event_type", F.lit("view")).alias("kind"),
        F.when(F.col("value") >= 20, F.col("value")).alias("value"),
    )


GAPS = "SELECT event_id, NULLIF(event_type, 'view') AS kind, CASE WHEN value >= 20 THEN value END AS value FROM events"


def complete_cases(spark, d):
    return P.complete_cases(_gaps(spark, d), ["kind", "value"], check=True)


def valid_flag(spark, d):
    return P.valid_flag(_gaps(spark, d), ["kind", "value"], "ok").select("event_id", "ok")


def completeness(spark, d):
    return P.completeness(_gaps(spark, d), ["kind", "value"])


def distinct_and_count(spark, d):
    od = table(spark, d, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "5-LOW"))
    total = P.count_rows(table(spark, d, "orders"), F.col("o_orderstatus") == "O").withColumn("value", F.lit("open orders"))
    kinds = od.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select("n", F.col("o_orderpriority").alias("value"))
    return total.unionByName(kinds)


def distinct_segments(spark, d):
    return P.distinct_values(table(spark, d, "customer"), "c_mktsegment")


def join_chain_page(spark, d):
    """Line items with order, customer and nation: filtered, counted, newest first, one page."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    od = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), "o_orderdate")
    cu = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))
    na = table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name", "n_regionkey")
    joined = L.join_chain(li, [(od, ["orderkey"]), (cu, ["custkey"]), (na, ["nationkey"])]).filter(F.col("n_regionkey") == 1)
    cols = ["orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows, total = P.page(joined, [F.col("o_orderdate").desc(), *[F.col(c) for c in cols]], 20, 100)
    return rows.select("o_orderdate", "n_name", *cols).withColumn("total", F.lit(total).cast("long"))


JOIN_CHAIN_PAGE = """
WITH j AS (SELECT o_orderdate, n_name, l_orderkey AS orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_regionkey = 1)
SELECT *, (SELECT count(*) FROM j) AS total FROM j
ORDER BY o_orderdate DESC, orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 100 OFFSET 20"""


def exists_match(spark, d):
    cu = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    od = table(spark, d, "orders").withColumnRenamed("o_custkey", "custkey")
    return L.exists_match(cu, od, ["custkey"], F.col("o_totalprice") > 450000)


PRIORITY = {"1-URGENT": 5, "2-HIGH": 3, "3-MEDIUM": 2.5}


def lookup_default(spark, d):
    od = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return L.lookup(od, "o_orderpriority", PRIORITY, "weight", default=1).select("o_orderkey", "weight")


def map_values(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return L.map_values(cu, "c_nationkey", {"1": "one", "2": "two", 3: "three"}, "word", default="many").select("c_custkey", "word")


def lookup_table(spark, d):
    """Lookup in a table instead of a literal, with a default for nations of other regions."""
    cu = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, d, "nation").filter(F.col("n_regionkey") < 3)
    out = L.lookup(cu, "c_nationkey", na, "nation", default="elsewhere", table_key="n_nationkey", table_value="n_name")
    return out.select("c_custkey", "nation")


def lookup_strict(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    out = L.lookup(li, "l_returnflag", {"A": 1, "N": 2, "R": 3}, "code", on_missing="error", name="codes")
    return out.select("l_orderkey", "l_linenumber", "code")


def group_value(spark, d):
    od = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = L.group_value(od, "o_orderpriority", F.max("o_totalprice"), "top")
    first = L.first_per_group(od, "o_orderpriority", "o_orderkey", ["o_orderkey", "o_totalprice"]).select(
        "o_orderpriority", F.col("o_orderkey").alias("first_key"), F.col("o_totalprice").alias("first_price")
    )
    out = L.dimension_join(out, first, ["o_orderpriority"], "left")
    return out.select("o_orderkey", "top", "first_key", "first_price")


GROUP_VALUE = """
WITH g AS (SELECT o_orderpriority AS p, max(o_totalprice) AS top, min(o_orderkey) AS first_key, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY 1)
SELECT o_orderkey, top, first_key, first_price FROM orders JOIN g ON o_orderpriority = p"""

CHECKS = {
    "page_deep": (page_deep, PAGE_DEEP),
    "sort_nulls_last": (sort_nulls_last, SORT_NULLS_LAST),
    "lookup_large": (lookup_large, LOOKUP_LARGE),
    "group_value_nan": (group_value_nan, GROUP_VALUE_NAN),
    "preview_orders": (preview_orders, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 200"),
    "page_orders": (
        page_orders,
        "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100",
    ),
    "thin_points": (thin_points, THIN_POINTS),
    "latest_order_per_customer": (latest_order_per_customer, LATEST_ORDER),
    "trailing_events": (
        trailing_events,
        "SELECT event_id, ts, user_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-24 00:00:00'",
    ),
    "split_train_test": (
        split_train_test,
        f"SELECT o_orderkey, o_orderpriority, CASE WHEN {u_sql(42, 'split', 0, 'o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS part FROM orders",
    ),
    "split_exact": (split_exact, SPLIT_EXACT),
    "complete_cases": (complete_cases, f"SELECT * FROM ({GAPS}) WHERE kind IS NOT NULL AND value IS NOT NULL"),
    "valid_flag": (valid_flag, f"SELECT event_id, kind IS NOT NULL AND value IS NOT NULL AS ok FROM ({GAPS})"),
    "completeness": (
        completeness,
        f"SELECT count(*) FILTER (kind IS NOT NULL AND value IS NOT NULL) AS complete, count(*) FILTER (kind IS NULL OR value IS NULL) AS incomplete FROM ({GAPS})",
    ),
    "distinct_and_count": (
        distinct_and_count,
        """SELECT count(*) FILTER (o_orderstatus = 'O') AS n, 'open orders' AS value FROM orders
        UNION ALL SELECT count(*), o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 2""",
    ),
    "distinct_segments": (distinct_segments, "SELECT DISTINCT c_mktsegment FROM customer"),
    "join_chain_page": (join_chain_page, JOIN_CHAIN_PAGE),
    "exists_match": (
        exists_match,
        "SELECT c_custkey AS custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    ),
    "lookup_default": (
        lookup_default,
        "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2.5 ELSE 1 END AS DOUBLE) AS weight FROM orders",
    ),
    "map_values": (
        map_values,
        "SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE 'many' END AS word FROM customer",
    ),
    "lookup_table": (
        lookup_table,
        "SELECT c_custkey, coalesce(n_name, 'elsewhere') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey",
    ),
    "lookup_strict": (
        lookup_strict,
        "SELECT l_orderkey, l_linenumber, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS DOUBLE) AS code FROM lineitem",
    ),
    "group_value": (group_value, GROUP_VALUE),
}
