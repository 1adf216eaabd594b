"""Checks of formulas, steps, post-processing and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulane.functions.formula import formula
from tabulane.operators.postprocess import post_process
from tabulane.operators.profile import profile_nulls
from tabulane.operators.projection import derive
from tabulane.plans import recipes as R
from tabulane.queries.base import even_sql, rounded, table

NET = "l_extendedprice * (1 - l_discount)"


def derive_net_price(spark, d):
    li = derive(table(spark, d, "lineitem"), "net", f"round({NET}, 2)")
    return li.select("l_orderkey", "l_linenumber", "net")


def derive_overwrite(spark, d):
    li = derive(table(spark, d, "lineitem"), "l_tax", "round(l_tax * 100)", allow_overwrite=True)
    return li.select("l_orderkey", "l_linenumber", "l_tax")


def formula_math(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    texts = {
        "ln_v": "log(c_acctbal)",
        "ln_base": "log(abs(c_acctbal) + 1, 2)",
        "lg_v": "log10(c_acctbal)",
        "sq_v": "sqrt(c_acctbal)",
        "ex_v": "exp(c_acctbal / 10000)",
        "pw_v": "pow(c_acctbal / 1000, 3) + (c_acctbal / 1000) ** 2",
        "si_v": "sin(c_acctbal)",
        "co_v": "cos(c_acctbal)",
        "ta_v": "tan(c_acctbal / 10000)",
        "fl_v": "floor(c_acctbal)",
        "ce_v": "ceil(c_acctbal)",
        "ab_v": "abs(-c_acctbal)",
        "ro_v": "round(c_acctbal)",
    }
    return rounded(df.select("c_custkey", *[formula(t, df).alias(n) for n, t in texts.items()]))


FORMULA_MATH = f"""
SELECT c_custkey,
  round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS ln_v,
  round(ln(abs(c_acctbal) + 1) / ln(CAST(2 AS DOUBLE)), 6) AS ln_base,
  round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS lg_v,
  round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS sq_v,
  round(exp(c_acctbal / 10000), 6) AS ex_v,
  round(pow(c_acctbal / 1000, 3) + pow(c_acctbal / 1000, 2), 6) AS pw_v,
  round(sin(c_acctbal), 6) AS si_v, round(cos(c_acctbal), 6) AS co_v, round(tan(c_acctbal / 10000), 6) AS ta_v,
  floor(c_acctbal) AS fl_v, ceil(c_acctbal) AS ce_v, abs(-c_acctbal) AS ab_v, {even_sql('c_acctbal', 0)} AS ro_v
FROM customer"""


def formula_logic(spark, d):
    df = table(spark, d, "lineitem")
    texts = {
        "big": "where(l_quantity > 25, l_extendedprice, 0)",
        "chosen": "if_else(l_returnflag == 'R', l_tax, l_discount)",
        "both": "l_quantity > 10 and l_discount < 0.05",
        "either": "l_quantity > 40 or not l_tax > 0.02",
        "chain": "10 < l_quantity <= 30",
        "held": "clip(l_quantity, 10, 40)",
        "held_too": "clamp(l_quantity, 20, 30)",
        "low": "min(l_quantity, l_linenumber * 5)",
        "high": "max(l_quantity, l_linenumber * 5, 12)",
        "tern": "1 if l_linenumber == 3 else 2",
        "operand": "l_tax or l_quantity",
    }
    return df.select("l_orderkey", "l_linenumber", *[formula(t, df).alias(n) for n, t in texts.items()])


FORMULA_LOGIC = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE CAST(0 AS DOUBLE) END AS big,
  CASE WHEN l_returnflag = 'R' THEN l_tax ELSE l_discount END AS chosen,
  (l_quantity > 10 AND l_discount < CAST(0.05 AS DOUBLE)) AS both,
  (l_quantity > 40 OR NOT l_tax > CAST(0.02 AS DOUBLE)) AS either,
  (10 < l_quantity AND l_quantity <= 30) AS chain,
  greatest(CAST(10 AS DOUBLE), least(CAST(40 AS DOUBLE), l_quantity)) AS held,
  greatest(CAST(20 AS DOUBLE), least(CAST(30 AS DOUBLE), l_quantity)) AS held_too,
  least(l_quantity, CAST(l_linenumber * 5 AS DOUBLE)) AS low,
  greatest(l_quantity, CAST(l_linenumber * 5 AS DOUBLE), CAST(12 AS DOUBLE)) AS high,
  CAST(CASE WHEN l_linenumber = 3 THEN 1 ELSE 2 END AS BIGINT) AS tern,
  CASE WHEN l_tax <> 0 THEN l_tax ELSE l_quantity END AS operand
FROM lineitem"""


def formula_mod_floor(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return rounded(
        df.select(
            "c_custkey",
            formula("c_acctbal // 7", df).alias("whole"),
            formula("c_acctbal % 7", df).alias("rest"),
            formula("c_acctbal % -7", df).alias("rest_neg"),
            formula("(c_custkey - 100) // 7", df).alias("int_whole"),
            formula("(c_custkey - 100) % -7", df).alias("int_rest"),
            formula("c_acctbal % c_nationkey", df).alias("by_zero"),
        )
    )


FORMULA_MOD_FLOOR = """
WITH t AS (SELECT c_custkey, c_acctbal AS a, c_custkey - 100 AS k, CAST(c_nationkey AS DOUBLE) AS z FROM customer)
SELECT c_custkey, floor(a / 7) AS whole, round(a - floor(a / 7) * 7, 6) AS rest,
  round(a - floor(a / -7) * -7, 6) AS rest_neg, floor(CAST(k AS DOUBLE) / 7) AS int_whole,
  CAST(k - floor(CAST(k AS DOUBLE) / -7) * -7 AS BIGINT) AS int_rest,
  CASE WHEN z <> 0 THEN round(a - floor(a / z) * z, 6) END AS by_zero
FROM t"""


def _with_nulls(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("value") >= 20, F.col("value")).alias("value"))


def formula_null(spark, d):
    df = _with_nulls(spark, d)
    texts = {
        "no_value": "isnan(value)",
        "no_kind": "isnull(kind)",
        "filled": "coalesce(value, -1)",
        "kind_filled": "coalesce(kind, 'none')",
        "least_v": "min(value, 100)",
        "branch": "where(value > 50, 1, 0)",
    }
    return df.select("event_id", *[formula(t, df).alias(n) for n, t in texts.items()])


FORMULA_NULL = """
WITH t AS (SELECT event_id, NULLIF(event_type, 'view') AS kind, CASE WHEN value >= 20 THEN value END AS value FROM events)
SELECT event_id, value IS NULL AS no_value, kind IS NULL AS no_kind, coalesce(value, CAST(-1 AS DOUBLE)) AS filled,
  coalesce(kind, 'none') AS kind_filled, CASE WHEN value IS NOT NULL THEN least(value, CAST(100 AS DOUBLE)) END AS least_v,
  CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS BIGINT) AS branch
FROM t"""


def formula_arith(spark, d):
    df = table(spark, d, "lineitem")
    context = {"RATE": 0.15, "fee": {"A": 1.5, "N": 2.5, "R": 4.0}}
    texts = {
        "ratio": "l_extendedprice / (l_linenumber - 3)",
        "bits": "(l_linenumber & 3) | (l_partkey ^ 5)",
        "moved": "(l_linenumber << 2) + (l_partkey >> 1) + ~l_linenumber",
        "circle": "PI * l_quantity + E",
        "flag": "TRUE and not FALSE",
        "taxed": "l_quantity * RATE",
        "fee": "fee[l_returnflag] * l_quantity",
        "word": "if_else(l_quantity > 25, 'many', 'few')",
        "scalar": "2 ** 3 + 7 // 2",
        "alias": "node(\"n1\") * 2",
    }
    out = df.select(
        "l_orderkey",
        "l_linenumber",
        *[formula(t, df, context, aliases={"n1": "l_quantity"}).alias(n) for n, t in texts.items()],
    )
    return rounded(out)


FORMULA_ARITH = """
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_linenumber <> 3 THEN l_extendedprice / (l_linenumber - 3) END, 6) AS ratio,
  (CAST(l_linenumber AS BIGINT) & 3) | xor(l_partkey, CAST(5 AS BIGINT)) AS bits,
  (CAST(l_linenumber AS BIGINT) * 4) + (l_partkey >> 1) + (-CAST(l_linenumber AS BIGINT) - 1) AS moved,
  round(CAST(3.14159265358979 AS DOUBLE) * l_quantity + CAST(2.71828182845904 AS DOUBLE), 6) AS circle,
  TRUE AS flag, round(l_quantity * CAST(0.15 AS DOUBLE), 6) AS taxed,
  round(CASE l_returnflag WHEN 'A' THEN CAST(1.5 AS DOUBLE) WHEN 'N' THEN CAST(2.5 AS DOUBLE) WHEN 'R' THEN CAST(4 AS DOUBLE) END * l_quantity, 6) AS fee,
  CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS word,
  CAST(11 AS DOUBLE) AS scalar, l_quantity * 2 AS alias
FROM lineitem"""


# steps and recipes --------------------------------------------------------------------------


def _step(n, kind, out, **params):
    return {"step_id": f"s{n}", "type": kind, "output_column": out, "params": params, "order": n}


def _one_step(kind):
    def run(spark, d):
        df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
        return rounded(R.apply_recipe(df, [_step(1, kind, "v", column="c_acctbal")]).select("c_custkey", "v"), 6)

    return run


def step_exp(spark, d):
    df = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 2000).alias("x"))
    return rounded(R.apply_recipe(df, [_step(1, "exp", "v", column="x")]).select("c_custkey", "v"), 6)


def step_warnings(spark, d):
    df = table(spark, d, "customer")
    steps = [_step(1, "log", "a", column="c_acctbal"), _step(2, "sqrt", "b", column="c_acctbal"), _step(3, "exp", "c", column="c_acctbal")]
    return R.recipe_warnings(df, steps)


STEP_WARNINGS = """
SELECT 's1' AS step_id, 'a' AS output_column, count(*) FILTER (c_acctbal <= 0) AS warnings FROM customer
UNION ALL SELECT 's2', 'b', count(*) FILTER (c_acctbal < 0) FROM customer
UNION ALL SELECT 's3', 'c', count(*) FILTER (c_acctbal > 700) FROM customer"""


def step_bin(spark, d):
    li = table(spark, d, "lineitem")
    steps = [_step(1, "bin", "price_bin", column="l_extendedprice", bins=10), _step(2, "bin", "disc_bin", column="l_discount", bins=7)]
    return R.apply_recipe(li, steps).select("l_orderkey", "l_linenumber", "price_bin", "disc_bin")


def _bin_sql(col: str, bins: int, lo: str, hi: str) -> str:
    edges = [f"CAST({col} > {lo} + CAST({k} AS DOUBLE) * (({hi} - {lo}) / {bins}) AS INTEGER)" for k in range(1, bins)]
    return "(" + " + ".join(edges) + ")"


STEP_BIN = f"""
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_discount) AS dlo, max(l_discount) AS dhi FROM lineitem)
SELECT l_orderkey, l_linenumber, {_bin_sql('l_extendedprice', 10, 'lo', 'hi')} AS price_bin, {_bin_sql('l_discount', 7, 'dlo', 'dhi')} AS disc_bin
FROM lineitem, r"""


def step_bin_labels(spark, d):
    li = table(spark, d, "lineitem")
    out = R.apply_recipe(li, [_step(1, "bin", "size", column="l_quantity", bins=3, labels="small, medium, large")])
    return out.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


STEP_BIN_LABELS = f"""
WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
b AS (SELECT l_quantity, {_bin_sql('l_quantity', 3, 'lo', 'hi')} AS code FROM lineitem, r)
SELECT list_extract(['small', 'medium', 'large'], code + 1) AS size, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi
FROM b GROUP BY 1"""


def post_process_lineitem(spark, d):
    li = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    li = li.withColumns({"as_int": F.col("net"), "as_bool": F.col("l_tax"), "as_text": F.col("l_linenumber")})
    li = post_process(li, "net", clip_min=5000, clip_max=90000, round_decimals=1)
    li = post_process(li, "as_int", clip_max=50000, dtype="int")
    li = post_process(li, "as_bool", dtype="bool")
    li = post_process(li, "as_text", dtype="category")
    return li.select("l_orderkey", "l_linenumber", "net", "as_int", "as_bool", "as_text")


POST_PROCESS = f"""
WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS net0 FROM lineitem)
SELECT l_orderkey, l_linenumber, {even_sql('greatest(CAST(5000 AS DOUBLE), least(CAST(90000 AS DOUBLE), net0))', 1)} AS net,
  CAST(trunc(least(CAST(50000 AS DOUBLE), net0)) AS BIGINT) AS as_int, l_tax <> 0 AS as_bool, CAST(l_linenumber AS VARCHAR) AS as_text
FROM t"""

STEPS = [
    _step(1, "formula", "net", expression=NET),
    _step(2, "log", "log_net", column="net"),
    _step(3, "formula", "taxed", expression="net * (1 + l_tax)"),
    _step(4, "bin", "net_bin", column="net", bins=5),
    _step(5, "formula", "l_quantity", expression="l_quantity * 2"),
]


def recipe_lineitem(spark, d):
    out = R.apply_recipe(table(spark, d, "lineitem"), STEPS)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "log_net", "taxed", "net_bin"))


RECIPE_LINEITEM = f"""
WITH t AS (SELECT *, {NET} AS net FROM lineitem), r AS (SELECT min(net) AS lo, max(net) AS hi FROM t)
SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 6) AS l_quantity, round(CASE WHEN net > 0 THEN ln(net) END, 6) AS log_net,
  round(net * (1 + l_tax), 6) AS taxed, {_bin_sql('net', 5, 'lo', 'hi')} AS net_bin
FROM t, r"""


def recipe_delete_cascade(spark, d):
    out = R.delete_step(table(spark, d, "lineitem"), STEPS, "s1", cascade=True)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", F.lit(",".join(out.columns[11:])).alias("added"))


def recipe_reorder(spark, d):
    out = R.reorder_steps(table(spark, d, "lineitem"), STEPS, ["s5", "s1", "s4", "s3", "s2"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "taxed", F.lit(",".join(out.columns[11:])).alias("added")))


def recipe_lineage(spark, d):
    """Lineage, with the number of missing values each step's column ends up with."""
    out = R.apply_recipe(table(spark, d, "customer"), LINEAGE_STEPS)
    nulls = profile_nulls(out, ["v", "w"]).select(F.col("column").alias("output_col"), "null_count")
    rows = R.lineage(spark, LINEAGE_STEPS).withColumn("inputs", F.array_join("inputs", ","))
    return rows.join(F.broadcast(nulls), "output_col")


LINEAGE_STEPS = [_step(1, "log", "v", column="c_acctbal"), _step(2, "formula", "w", expression="v + c_nationkey")]
RECIPE_LINEAGE = """
SELECT 'v' AS output_col, 'c_acctbal' AS inputs, 's1' AS step_id, 'log' AS transform_name, count(*) FILTER (c_acctbal <= 0) AS null_count FROM customer
UNION ALL SELECT 'w', 'c_nationkey,v', 's2', 'formula', count(*) FILTER (c_acctbal <= 0) FROM customer"""


def materialize_recipe(spark, d):
    od = table(spark, d, "orders")
    steps = [_step(1, "formula", "unit", expression="o_totalprice / 7"), _step(2, "sqrt", "root", column="unit")]
    return rounded(R.materialize(od, steps, ["o_orderkey", "root"], 1000, ["o_orderkey"]))


def recipe_other_source(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey", F.col("p_retailprice").alias("l_extendedprice"), (F.col("p_size") / 100).alias("l_discount"), (F.col("p_size") / 50).alias("l_tax")
    )
    return rounded(R.apply_recipe(part, STEPS[:3]).select("p_partkey", "net", "log_net", "taxed"))


def custom_transform(spark, d):
    R.register_transform("share_of", lambda df, p: F.col(p["column"]) / F.lit(float(p["whole"])))
    out = R.apply_recipe(table(spark, d, "lineitem"), [_step(1, "share_of", "part", column="l_quantity", whole=50)])
    return rounded(out.select("l_orderkey", "l_linenumber", "part"))


def binned_net_histogram(spark, d):
    """The flagship: derive, bin, then the histogram of the bins by flag."""
    from tabulane.operators.profile import histogram

    li = R.apply_recipe(table(spark, d, "lineitem"), [STEPS[0], _step(2, "bin", "net_bin", column="net", bins=10)])
    return histogram(li, "net_bin", bins=10, by="l_returnflag")


BINNED_NET = f"""
WITH t AS (SELECT l_returnflag, {NET} AS net FROM lineitem), r AS (SELECT min(net) AS lo, max(net) AS hi FROM t),
b AS (SELECT l_returnflag AS category, {_bin_sql('net', 10, 'lo', 'hi')} AS v FROM t, r),
s AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM b),
h AS (SELECT category, least(CAST(floor((v - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS bin FROM b, s),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT g.bin AS bin, s.lo + g.bin * ((s.hi - s.lo) / 10) AS start, s.lo + (g.bin + 1) * ((s.hi - s.lo) / 10) AS "end", c.category AS category,
  (SELECT count(*) FROM h WHERE h.bin = g.bin AND h.category = c.category) AS n, (SELECT count(*) FROM h WHERE h.bin = g.bin) AS total
FROM g, s, (SELECT DISTINCT category FROM h) c"""

DEEP_ROUNDS = 4  # of three levels each


def formula_deep(spark, d):
    """Twelve levels of `%`, `//` and `clip` within each other."""
    text = "floor(l_extendedprice)"
    for i in range(DEEP_ROUNDS):
        text = f"clip({text} * {i + 2} % {40013 + i} - {i}, -5, {39000 - 1000 * i}) // 2 * 3"
    return derive(table(spark, d, "lineitem"), "deep", text).select("l_orderkey", "l_linenumber", "deep")


def _deep_sql():
    inner = "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS x FROM lineitem"
    for i in range(DEEP_ROUNDS):
        m = f"CAST({40013 + i} AS DOUBLE)"
        rest = f"((x * {i + 2}) % {m} + {m}) % {m}"  # whole numbers, so this is exact
        inner = f"SELECT l_orderkey, l_linenumber, floor(greatest(-5, least({39000 - 1000 * i}, {rest} - {i})) / CAST(2 AS DOUBLE)) * 3 AS x FROM ({inner})"
    return f"SELECT l_orderkey, l_linenumber, x AS deep FROM ({inner})"


CHECKS = {
    "formula_deep": (formula_deep, _deep_sql()),
    "binned_net_histogram": (binned_net_histogram, BINNED_NET),
    "derive_net_price": (derive_net_price, f"SELECT l_orderkey, l_linenumber, {even_sql(NET, 2)} AS net FROM lineitem"),
    "derive_overwrite": (derive_overwrite, f"SELECT l_orderkey, l_linenumber, {even_sql('l_tax * 100', 0)} AS l_tax FROM lineitem"),
    "formula_math": (formula_math, FORMULA_MATH),
    "formula_logic": (formula_logic, FORMULA_LOGIC),
    "formula_mod_floor": (formula_mod_floor, FORMULA_MOD_FLOOR),
    "formula_null": (formula_null, FORMULA_NULL),
    "formula_arith": (formula_arith, FORMULA_ARITH),
    "step_log": (_one_step("log"), "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS v FROM customer"),
    "step_sqrt": (_one_step("sqrt"), "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS v FROM customer"),
    "step_exp": (step_exp, "SELECT c_custkey, round(exp(least(700, greatest(-700, c_acctbal / 2000))), 6) AS v FROM customer"),
    "step_warnings": (step_warnings, STEP_WARNINGS),
    "step_bin": (step_bin, STEP_BIN),
    "step_bin_labels": (step_bin_labels, STEP_BIN_LABELS),
    "post_process": (post_process_lineitem, POST_PROCESS),
    "recipe_lineitem": (recipe_lineitem, RECIPE_LINEITEM),
    "recipe_delete_cascade": (
        recipe_delete_cascade,
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity, '' AS added FROM lineitem",
    ),
    "recipe_reorder": (
        recipe_reorder,
        f"SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 6) AS l_quantity, round({NET} * (1 + l_tax), 6) AS taxed, 'net,net_bin,taxed,log_net' AS added FROM lineitem",
    ),
    "recipe_lineage": (recipe_lineage, RECIPE_LINEAGE),
    "materialize_recipe": (
        materialize_recipe,
        "SELECT o_orderkey, round(sqrt(o_totalprice / 7), 6) AS root FROM orders ORDER BY o_orderkey LIMIT 1000",
    ),
    "recipe_other_source": (
        recipe_other_source,
        """WITH t AS (SELECT p_partkey, p_retailprice * (1 - p_size / CAST(100 AS DOUBLE)) AS net, p_size / CAST(50 AS DOUBLE) AS tax FROM part)
        SELECT p_partkey, round(net, 6) AS net, round(CASE WHEN net > 0 THEN ln(net) END, 6) AS log_net, round(net * (1 + tax), 6) AS taxed FROM t""",
    ),
    "custom_transform": (custom_transform, "SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 6) AS part FROM lineitem"),
}
