"""Checks of random columns: every order gets its draws, keyed by the order key."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabulane.functions.distributions import GOLDEN, MIX1, MIX2, SPACING, register_distribution
from tabulane.plans.generate import add_columns, preview_with_profile, with_random
from tabulane.queries.base import even_sql, normal_sql, rounded, table, u_sql

SEED = 42
KEY = "o_orderkey"


def _orders(spark, d, *cols):
    return table(spark, d, "orders").select(KEY, *cols)


def _draw(dist, digits=6, **params):
    def run(spark, d):
        return rounded(with_random(_orders(spark, d), "x", dist, params, SEED, KEY), digits)

    return run


def _sql(expr: str, digits: int | None = 6) -> str:
    value = expr if digits is None else f"round({expr}, {digits})"
    return f"SELECT {KEY}, {value} AS x FROM orders"


U = u_sql(SEED, "x", 0, KEY)
Z = normal_sql(SEED, "x", KEY)
POISSON = f"""
WITH p AS (SELECT k, sum(exp(CAST(-3 AS DOUBLE)) * pow(CAST(3 AS DOUBLE), k) / CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE)) OVER (ORDER BY k) AS upto
  FROM (SELECT range AS k FROM range(33))),
t AS (SELECT list(upto) AS upto FROM p)
SELECT {KEY}, CAST(len(list_filter(upto, lambda c: c < {U})) AS BIGINT) AS x FROM orders, t"""


def random_scopes(spark, d):
    od = _orders(spark, d, "o_orderpriority", "o_totalprice")
    od = with_random(od, "one", "normal", {"mu": 5, "sigma": 2}, SEED, KEY, scope="global")
    od = with_random(od, "first_row", "normal", {"mu": "o_totalprice", "sigma": 1}, SEED, KEY, scope="global")
    od = with_random(od, "per_group", "uniform", {"low": 0, "high": 10}, SEED, KEY, scope="group", group_by="o_orderpriority")
    od = with_random(od, "group_first", "normal", {"mu": "o_totalprice", "sigma": 1}, SEED, KEY, scope="group", group_by="o_orderpriority")
    return rounded(od.select(KEY, "one", "first_row", "per_group", "group_first"), 5)


RANDOM_SCOPES = f"""
WITH f AS (SELECT arg_min(o_totalprice, {KEY}) AS p FROM orders), g AS (SELECT o_orderpriority AS c, arg_min(o_totalprice, {KEY}) AS p FROM orders GROUP BY 1)
SELECT {KEY}, round(5 + 2 * {normal_sql(SEED, 'one', "'global'")}, 5) AS one, round(f.p + {normal_sql(SEED, 'first_row', "'global'")}, 5) AS first_row,
  round(10 * {u_sql(SEED, 'per_group', 0, 'o_orderpriority')}, 5) AS per_group, round(g.p + {normal_sql(SEED, 'group_first', 'o_orderpriority')}, 5) AS group_first
FROM orders JOIN g ON o_orderpriority = g.c, f"""


def random_lookup_params(spark, d):
    context = {"base": {"1-URGENT": 100.0, "2-HIGH": 50.0}}
    od = _orders(spark, d, "o_orderpriority", "o_orderstatus", "o_totalprice")
    params = {
        "mu": {"lookup": "base", "key": "o_orderpriority", "default": 10},
        "sigma": {"mapping": {"F": 1, "O": 2}, "key": "o_orderstatus", "default": 3},
    }
    od = with_random(od, "x", "normal", params, SEED, KEY, context=context)
    od = with_random(od, "y", "exponential", {"scale": "o_totalprice / 1000 + K"}, SEED, KEY, context={"K": 2})
    return rounded(od.select(KEY, "x", "y"), 5)


RANDOM_LOOKUP = f"""
SELECT {KEY}, round(CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 50 ELSE 10 END
  + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END * {Z}, 5) AS x,
  round(-(o_totalprice / 1000 + 2) * ln({u_sql(SEED, 'y', 0, KEY)}), 5) AS y FROM orders"""


def random_missing(spark, d):
    specs = [{"name": "x", "dist": "normal", "params": {"mu": 50, "sigma": 20}, "post": {"clip_min": 20, "clip_max": 90, "round_decimals": 1, "missing_rate": 0.1}}]
    return add_columns(_orders(spark, d), specs, seed=SEED, key=KEY)


RANDOM_MISSING = f"""
SELECT {KEY}, CASE WHEN NOT {u_sql(SEED, 'x:missing', 0, KEY)} < 0.1 THEN {even_sql(f'greatest(CAST(20 AS DOUBLE), least(CAST(90 AS DOUBLE), 50 + 20 * {Z}))', 1)} END AS x
FROM orders"""

# family -> (parameters, SQL of the standard quantile of u)
FAMILY_SQL = {
    "uniform": ({}, "u"),
    "expon": ({}, "-ln(1 - u)"),
    "pareto": ({"b": 2.5}, "pow(1 - u, -1 / CAST(2.5 AS DOUBLE))"),
    "lomax": ({"c": 2}, "pow(1 - u, CAST(-0.5 AS DOUBLE)) - 1"),
    "genpareto": ({"c": 0.2}, "(pow(1 - u, CAST(-0.2 AS DOUBLE)) - 1) / CAST(0.2 AS DOUBLE)"),
    "logistic": ({}, "ln(u / (1 - u))"),
    "laplace": ({}, "CASE WHEN u < 0.5 THEN ln(2 * u) ELSE -ln(2 * (1 - u)) END"),
    "cauchy": ({}, "tan(pi() * (u - CAST(0.5 AS DOUBLE)))"),
    "gumbel_r": ({}, "-ln(-ln(u))"),
    "gumbel_l": ({}, "ln(-ln(1 - u))"),
    "rayleigh": ({}, "sqrt(-2 * ln(1 - u))"),
    "powerlaw": ({"a": 3}, "pow(u, 1 / CAST(3 AS DOUBLE))"),
    "loguniform": ({"a": 1, "b": 100}, "pow(CAST(100 AS DOUBLE), u)"),
    "fisk": ({"c": 4}, "pow(u / (1 - u), CAST(0.25 AS DOUBLE))"),
    "weibull_min": ({"c": 2}, "pow(-ln(1 - u), CAST(0.5 AS DOUBLE))"),
    "weibull_max": ({"c": 2}, "-pow(-ln(u), CAST(0.5 AS DOUBLE))"),
    "arcsine": ({}, "pow(sin(pi() / 2 * u), 2)"),
}


def random_families(spark, d):
    """One column per family with loc 1 and scale 2, drawn from the column's own uniforms."""
    specs = [{"name": n, "dist": f"scipy.{n}", "params": {**params, "loc": 1, "scale": 2}} for n, (params, _) in FAMILY_SQL.items()]
    specs += [
        {"name": "norm", "dist": "scipy.norm", "params": {"loc": 1, "scale": 2}},
        {"name": "halfnorm", "dist": "scipy.halfnorm", "params": {}},
        {"name": "geom", "dist": "scipy.geom", "params": {"p": 0.3}},
        {"name": "randint", "dist": "scipy.randint", "params": {"low": 3, "high": 9, "loc": 1}},
    ]
    return rounded(add_columns(_orders(spark, d), specs, seed=SEED, key=KEY), 4)


def _families_sql() -> str:
    parts = []
    for name, (_, sql) in FAMILY_SQL.items():
        u = u_sql(SEED, name, 0, KEY)
        parts.append(f"(SELECT round(1 + 2 * ({sql}), 4) FROM (SELECT {u} AS u)) AS \"{name}\"")
    parts.append(f"round(1 + 2 * {normal_sql(SEED, 'norm', KEY)}, 4) AS norm")
    parts.append(f"round(abs({normal_sql(SEED, 'halfnorm', KEY)}), 4) AS halfnorm")
    parts.append(f"CAST(greatest(1, ceil(ln(1 - {u_sql(SEED, 'geom', 0, KEY)}) / ln(1 - CAST(0.3 AS DOUBLE)))) AS BIGINT) AS geom")
    parts.append(f"CAST(1 + 3 + floor({u_sql(SEED, 'randint', 0, KEY)} * 6) AS BIGINT) AS randint")
    return f"SELECT {KEY}, {', '.join(parts)} FROM orders"


def random_large_counts(spark, d):
    """Counts whose parameters differ by row or are large: the batched inverse tables."""
    od = _orders(spark, d, "o_totalprice")
    od = with_random(od, "rows_lam", "poisson", {"lam": "o_totalprice / 10000"}, SEED, KEY)
    od = with_random(od, "big_lam", "poisson", {"lam": 400}, SEED, KEY)
    od = with_random(od, "big_n", "binomial", {"n": 500, "p": 0.3}, SEED, KEY)
    return od.drop("o_totalprice")


def custom_distribution(spark, d):
    register_distribution("two_sided", lambda draws, p: F.when(draws.u(0) < 0.5, -p["size"]).otherwise(p["size"]), ("size",))
    return with_random(_orders(spark, d), "x", "two_sided", {"size": 4}, SEED, KEY)


# Gamma draws in SQL: SplitMix64 on 128-bit integers gives every uniform a row may need; the first
# accepted attempt of the rejection method counts.

ATTEMPTS = 24
M64 = "CAST('18446744073709551616' AS UHUGEINT)"


def _mix(z: str, shift: int, factor: int | None) -> str:
    mixed = f"xor({z}, {z} >> {shift})"
    return f"({mixed} * CAST('{factor}' AS UHUGEINT)) % {M64}" if factor else mixed


def _gamma_ctes(tag: str, draw: int, shape: str) -> str:
    """CTE `g_<tag>`(key, g): the standard gamma of every order, from the draw's hash bits."""
    a = f"CAST({shape} AS DOUBLE)"
    start = (1, 17)[draw % 2]
    bits = f"CAST(('0x' || substr(md5('{SEED}|x|{draw // 2}|' || CAST({KEY} AS VARCHAR)), {start}, 13)) AS BIGINT)"
    return f"""
b0_{tag} AS (SELECT {KEY} AS key, CAST({bits} AS UHUGEINT) AS s, k FROM orders, (SELECT range AS k FROM range(1, {2 + 3 * ATTEMPTS}))),
b1_{tag} AS (SELECT key, k, (((s * CAST('{GOLDEN}' AS UHUGEINT)) % {M64}) + ((CAST(k AS UHUGEINT) * CAST('{SPACING}' AS UHUGEINT)) % {M64})) % {M64} AS z FROM b0_{tag}),
b2_{tag} AS (SELECT key, k, {_mix('z', 30, MIX1)} AS z FROM b1_{tag}),
b3_{tag} AS (SELECT key, k, {_mix('z', 27, MIX2)} AS z FROM b2_{tag}),
b4_{tag} AS (SELECT key, k, {_mix('z', 31, None)} AS z FROM b3_{tag}),
u_{tag} AS (SELECT key, k, (CAST(z >> 11 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(9007199254740992 AS DOUBLE) AS u FROM b4_{tag}),
t_{tag} AS (SELECT key, (k - 2) // 3 AS t, max(u) FILTER ((k - 2) % 3 = 0) AS u1, max(u) FILTER ((k - 2) % 3 = 1) AS u2, max(u) FILTER ((k - 2) % 3 = 2) AS u3
  FROM u_{tag} WHERE k >= 2 GROUP BY 1, 2),
x_{tag} AS (SELECT key, t, u3, d, sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) AS x, 1 / sqrt(9 * d) AS c
  FROM t_{tag}, (SELECT CASE WHEN {a} < 1 THEN {a} + 1 ELSE {a} END - 1 / CAST(3 AS DOUBLE) AS d)),
v_{tag} AS (SELECT key, t, u3, d, x, pow(1 + c * x, 3) AS v FROM x_{tag}),
w_{tag} AS (SELECT key, arg_min(d * v, t) AS g FROM v_{tag} WHERE v > 0 AND ln(u3) < 0.5 * x * x + d * (1 - CASE WHEN v > 0 THEN v ELSE 1 END + ln(CASE WHEN v > 0 THEN v ELSE 1 END)) GROUP BY 1),
g_{tag} AS (SELECT w_{tag}.key AS key, g * CASE WHEN {a} < 1 THEN pow(u, 1 / {a}) ELSE 1 END AS g FROM w_{tag} JOIN u_{tag} ON w_{tag}.key = u_{tag}.key AND k = 1)"""


GAMMA = f"WITH {_gamma_ctes('a', 0, '2.5')} SELECT key AS {KEY}, round(g * 2, 6) AS x FROM g_a"
GAMMA_SMALL = f"WITH {_gamma_ctes('a', 0, '0.5')} SELECT key AS {KEY}, round(g * 3, 6) AS x FROM g_a"
BETA = f"WITH {_gamma_ctes('a', 0, '2')}, {_gamma_ctes('b', 1, '5')} SELECT g_a.key AS {KEY}, round(g_a.g / (g_a.g + g_b.g), 6) AS x FROM g_a JOIN g_b ON g_a.key = g_b.key"
CHISQUARE = f"WITH {_gamma_ctes('a', 0, '2')} SELECT key AS {KEY}, round(g * 2, 6) AS x FROM g_a"
STUDENT_T = f"WITH {_gamma_ctes('a', 2, '3')} SELECT key AS {KEY}, round(1 + 2 * {normal_sql(SEED, 'x', 'key')} / sqrt(g * 2 / 6), 6) AS x FROM g_a"

# inverse tables: running sums of the probabilities, and how many of them lie under u
LARGE_COUNTS = f"""
WITH o AS (SELECT {KEY}, o_totalprice / 10000 AS lam, {u_sql(SEED, 'rows_lam', 0, KEY)} AS u1, {u_sql(SEED, 'big_lam', 0, KEY)} AS u2, {u_sql(SEED, 'big_n', 0, KEY)} AS u3 FROM orders),
k AS (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 200)),
r AS (SELECT {KEY}, u1, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY {KEY} ORDER BY k) AS upto FROM o, k),
a AS (SELECT {KEY}, count(*) FILTER (upto < u1) AS rows_lam FROM r GROUP BY 1),
p AS (SELECT list(upto) AS t FROM (SELECT sum(exp(-400 + k * ln(CAST(400 AS DOUBLE)) - lgamma(k + 1))) OVER (ORDER BY k) AS upto FROM (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 800)))),
n AS (SELECT list(upto) AS t FROM (SELECT sum(exp(lgamma(CAST(501 AS DOUBLE)) - lgamma(k + 1) - lgamma(501 - k) + k * ln(CAST(0.3 AS DOUBLE)) + (500 - k) * ln(CAST(0.7 AS DOUBLE)))) OVER (ORDER BY k) AS upto
  FROM (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 501))))
SELECT o.{KEY} AS {KEY}, rows_lam, CAST(len(list_filter(p.t, lambda c: c < u2)) AS BIGINT) AS big_lam, CAST(len(list_filter(n.t, lambda c: c < u3)) AS BIGINT) AS big_n
FROM o JOIN a ON o.{KEY} = a.{KEY}, p, n"""


def _binomial_sql(n, p, name="x"):
    """How many running sums of the probabilities lie under the uniform draw."""
    upto, terms = 0.0, []
    for k in range(n):
        upto += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        terms.append(f"CAST(CAST({upto!r} AS DOUBLE) < {u_sql(SEED, name, 0, KEY)} AS BIGINT)")
    return "(" + " + ".join(terms) + ")"


def random_binomial_column(spark, d):
    """The same draw with the number of trials as a literal and as a column."""
    od = _orders(spark, d).withColumn("trials", F.lit(5))
    literal = add_columns(od, [{"name": "a", "dist": "binomial", "params": {"n": 5, "p": 0.4}}], seed=SEED, key=KEY)
    column = add_columns(od, [{"name": "a", "dist": "binomial", "params": {"n": "trials", "p": 0.4}}], seed=SEED, key=KEY)
    return literal.select(KEY, "a").join(column.select(KEY, F.col("a").alias("b")), KEY)


def generated_profile(spark, d):
    """Statistics of a generated column, and the size of its preview."""
    od = add_columns(_orders(spark, d), [{"name": "x", "dist": "normal", "params": {"mu": 50, "sigma": 20}, "post": {"missing_rate": 0.2}}], seed=SEED, key=KEY)
    shown, stats = preview_with_profile(od, 200, KEY)
    return rounded(stats.withColumn("previewed", F.lit(shown.count()).cast("long")), 5)



# family -> (parameters, SQL of the value; {u} and {z} are its uniform and its normal draw)
SHAPE_SQL = {
    "lognorm": ({"s": 0.5, "scale": 2}, "2 * exp(CAST(0.5 AS DOUBLE) * {z})"),
    "triang": ({"c": 0.3}, "CASE WHEN {u} < CAST(0.3 AS DOUBLE) THEN sqrt({u} * CAST(0.3 AS DOUBLE)) ELSE 1 - sqrt((1 - {u}) * CAST(0.7 AS DOUBLE)) END"),
    "bernoulli": ({"p": 0.3}, "CAST({u} < CAST(0.3 AS DOUBLE) AS DOUBLE)"),
    "halfcauchy": ({}, "tan(pi() / 2 * {u})"),
    "halflogistic": ({}, "ln((1 + {u}) / (1 - {u}))"),
    "hypsecant": ({}, "ln(tan(pi() / 2 * {u}))"),
    "genlogistic": ({"c": 2}, "-ln(pow({u}, CAST(-0.5 AS DOUBLE)) - 1)"),
    "gompertz": ({"c": 3}, "ln(1 - ln(1 - {u}) / 3)"),
    "exponweib": ({"a": 2, "c": 4}, "pow(-ln(1 - sqrt({u})), CAST(0.25 AS DOUBLE))"),
    "burr": ({"c": 4, "d": 2}, "pow(pow({u}, CAST(-0.5 AS DOUBLE)) - 1, CAST(-0.25 AS DOUBLE))"),
    "invweibull": ({"c": 2}, "pow(-ln({u}), CAST(-0.5 AS DOUBLE))"),
}


def random_scipy_shapes(spark, d):
    """Families under their scipy names, each with loc 1."""
    specs = [{"name": f"x_{f}", "dist": f"scipy.{f}", "params": {"loc": 1, **p}} for f, (p, _) in SHAPE_SQL.items()]
    out = add_columns(_orders(spark, d), specs, seed=SEED, key=KEY)
    return rounded(out.select(KEY, *[F.col(f"x_{f}").cast("double").alias(f"x_{f}") for f in SHAPE_SQL]), 5)


def _shapes_sql() -> str:
    draws = {f: {"u": u_sql(SEED, f"x_{f}", 0, KEY), "z": normal_sql(SEED, f"x_{f}", KEY)} for f in SHAPE_SQL}
    values = [f"round(CAST(1 + ({sql.format(**draws[f])}) AS DOUBLE), 5) AS x_{f}" for f, (_, sql) in SHAPE_SQL.items()]
    return f"SELECT {KEY}, {', '.join(values)} FROM orders"


CHECKS = {
    "random_scipy_shapes": (random_scipy_shapes, _shapes_sql()),
    "random_uniform": (_draw("uniform", low=-1, high=3), _sql(f"-1 + 4 * {U}")),
    "random_normal": (_draw("normal", mu=10, sigma=3), _sql(f"10 + 3 * {Z}")),
    "random_categorical": (
        _draw("categorical", categories="red, green, blue", probs="0.2, 0.5, 0.3"),
        _sql(f"CASE WHEN {U} < 0.2 THEN 'red' WHEN {U} < 0.7 THEN 'green' ELSE 'blue' END", None),
    ),
    "random_bernoulli": (_draw("bernoulli", p=0.3), _sql(f"CAST({U} < CAST(0.3 AS DOUBLE) AS BIGINT)", None)),
    "random_exponential": (_draw("exponential", scale=4), _sql(f"-4 * ln({U})")),
    "random_lognormal": (_draw("lognormal", mean=1, sigma=0.5), _sql(f"exp(1 + CAST(0.5 AS DOUBLE) * {Z})")),
    "random_triangular": (
        _draw("triangular", left=0, mode=3, right=10),
        _sql(f"CASE WHEN {U} * 10 < 3 THEN sqrt({U} * 30) ELSE 10 - sqrt((1 - {U}) * 70) END"),
    ),
    "random_weibull": (_draw("weibull", a=1.5, scale=2), _sql(f"2 * pow(-ln({U}), 1 / CAST(1.5 AS DOUBLE))")),
    "random_binomial": (_draw("binomial", n=5, p=0.4), _sql(_binomial_sql(5, 0.4), None)),
    "random_binomial_column": (
        random_binomial_column,
        f"SELECT {KEY}, {_binomial_sql(5, 0.4, 'a')} AS a, {_binomial_sql(5, 0.4, 'a')} AS b FROM orders",
    ),
    "random_poisson": (_draw("poisson", lam=3), POISSON),
    "random_gamma": (_draw("gamma", shape=2.5, scale=2), GAMMA),
    "random_gamma_small_shape": (_draw("gamma", shape=0.5, scale=3), GAMMA_SMALL),
    "random_beta": (_draw("beta", a=2, b=5), BETA),
    "random_chisquare": (_draw("chisquare", df=4), CHISQUARE),
    "random_student_t": (_draw("student_t", df=6, loc=1, scale=2), STUDENT_T),
    "random_large_counts": (random_large_counts, LARGE_COUNTS),
    "generated_profile": (
        generated_profile,
        f"""WITH t AS (SELECT CASE WHEN NOT {u_sql(SEED, 'x:missing', 0, KEY)} < 0.2 THEN 50 + 20 * {Z} END AS x FROM orders)
        SELECT 'x' AS "column", 'float' AS dtype, count(*) AS rows, count(*) - count(x) AS null_count, round((count(*) - count(x)) / CAST(count(*) AS DOUBLE), 5) AS null_rate,
        round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, round(min(x), 5) AS min, round(max(x), 5) AS max, round(median(x), 5) AS median, CAST(200 AS BIGINT) AS previewed FROM t""",
    ),
    "random_families": (random_families, _families_sql()),
    "random_scopes": (random_scopes, RANDOM_SCOPES),
    "random_lookup_params": (random_lookup_params, RANDOM_LOOKUP),
    "random_missing": (random_missing, RANDOM_MISSING),
    "custom_distribution": (custom_distribution, _sql(f"CASE WHEN {U} < 0.5 THEN CAST(-4 AS DOUBLE) ELSE CAST(4 AS DOUBLE) END", None)),
}
