"""Random columns: reproducible, of the right shape, and checked."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulane.functions.distributions import DISTRIBUTIONS, register_distribution
from tabulane.plans import generate as G
from tabulane.sources.tables import table_checksum

N = 20_000
# name -> (parameters, mean, standard deviation)
MOMENTS = {
    "normal": ({"mu": 5, "sigma": 2}, 5, 2),
    "uniform": ({"low": -1, "high": 3}, 1, 4 / math.sqrt(12)),
    "bernoulli": ({"p": 0.3}, 0.3, math.sqrt(0.21)),
    "poisson": ({"lam": 4}, 4, 2),
    "exponential": ({"scale": 3}, 3, 3),
    "beta": ({"a": 2, "b": 5}, 2 / 7, math.sqrt(10 / 49 / 8)),
    "gamma": ({"shape": 0.7, "scale": 2}, 1.4, math.sqrt(0.7) * 2),
    "lognormal": ({"mean": 0, "sigma": 0.5}, math.exp(0.125), math.sqrt((math.exp(0.25) - 1) * math.exp(0.25))),
    "binomial": ({"n": 10, "p": 0.4}, 4, math.sqrt(2.4)),
    "triangular": ({"left": 0, "mode": 2, "right": 7}, 3, math.sqrt((4 + 49 - 14) / 18)),
    "weibull": ({"a": 2}, math.gamma(1.5), math.sqrt(math.gamma(2) - math.gamma(1.5) ** 2)),
    "chisquare": ({"df": 3}, 3, math.sqrt(6)),
    "student_t": ({"df": 10, "loc": 1, "scale": 2}, 1, 2 * math.sqrt(10 / 8)),
    "scipy.pareto": ({"b": 5, "scale": 2}, 2.5, 2 * math.sqrt(5 / 16 / 3)),
    "scipy.logistic": ({}, 0, math.pi / math.sqrt(3)),
    "scipy.laplace": ({}, 0, math.sqrt(2)),
    "scipy.gumbel_r": ({}, 0.5772, math.pi / math.sqrt(6)),
    "scipy.gumbel_l": ({}, -0.5772, math.pi / math.sqrt(6)),
    "scipy.rayleigh": ({}, math.sqrt(math.pi / 2), math.sqrt(2 - math.pi / 2)),
    "scipy.halfnorm": ({}, math.sqrt(2 / math.pi), math.sqrt(1 - 2 / math.pi)),
    "scipy.powerlaw": ({"a": 3}, 0.75, math.sqrt(3 / 80)),
    "scipy.lomax": ({"c": 5}, 0.25, math.sqrt(5 / 16 / 3)),
    "scipy.genpareto": ({"c": 0.1}, 1 / 0.9, math.sqrt(1 / 0.81 / 0.8)),
    "scipy.weibull_min": ({"c": 2}, math.gamma(1.5), math.sqrt(1 - math.gamma(1.5) ** 2)),
    "scipy.weibull_max": ({"c": 2}, -math.gamma(1.5), math.sqrt(1 - math.gamma(1.5) ** 2)),
    "scipy.arcsine": ({}, 0.5, math.sqrt(1 / 8)),
    "scipy.geom": ({"p": 0.4}, 2.5, math.sqrt(0.6) / 0.4),
    "scipy.randint": ({"low": 2, "high": 8}, 4.5, math.sqrt(35 / 12)),
    "scipy.expon": ({"loc": 1, "scale": 2}, 3, 2),
    "scipy.norm": ({"loc": 1, "scale": 2}, 1, 2),
    "scipy.uniform": ({"loc": 1, "scale": 2}, 2, 2 / math.sqrt(12)),
    "scipy.loguniform": ({"a": 1, "b": 10}, 9 / math.log(10), math.sqrt(99 / 2 / math.log(10) - (9 / math.log(10)) ** 2)),
    "scipy.fisk": ({"c": 6}, (math.pi / 6) / math.sin(math.pi / 6), None),
}


@pytest.fixture(scope="module")
def drawn(spark):
    df = spark.range(N).withColumnRenamed("id", "row_id")
    for name, (params, _, _) in MOMENTS.items():
        df = G.with_random(df, name.replace(".", "_"), name, params, seed=11)
    df = G.with_random(df, "big_poisson", "poisson", {"lam": 300}, seed=11)
    df = G.with_random(df, "row_poisson", "poisson", {"lam": "where(row_id < 10000, 3, 50)"}, seed=11)
    df = G.with_random(df, "big_binomial", "binomial", {"n": 400, "p": 0.25}, seed=11)
    return df.toPandas()


@pytest.mark.parametrize("name", MOMENTS)
def test_moments(drawn, name):
    _, mean, std = MOMENTS[name]
    x = drawn[name.replace(".", "_")].astype(float)
    assert not x.isna().any()
    if std is not None:
        assert abs(x.mean() - mean) < 5 * std / math.sqrt(N)
        assert x.std() == pytest.approx(std, rel=0.08)
    else:
        assert x.mean() == pytest.approx(mean, rel=0.03)


def test_large_counts(drawn):
    assert abs(drawn.big_poisson.mean() - 300) < 1 and drawn.big_poisson.std() == pytest.approx(math.sqrt(300), rel=0.05)
    assert abs(drawn.big_binomial.mean() - 100) < 0.5 and drawn.big_binomial.std() == pytest.approx(math.sqrt(75), rel=0.05)
    assert abs(drawn.row_poisson[:10000].mean() - 3) < 0.1 and abs(drawn.row_poisson[10000:].mean() - 50) < 0.5


def test_cauchy_and_table_poisson_agree_with_theory(spark, drawn):
    counts = drawn.poisson.value_counts(normalize=True)
    for k in range(8):
        assert abs(counts[k] - math.exp(-4) * 4**k / math.factorial(k)) < 0.015
    df = G.with_random(spark.range(N).withColumnRenamed("id", "row_id"), "c", "scipy.cauchy", {}, seed=2)
    assert df.stat.approxQuantile("c", [0.25, 0.75], 0.001) == pytest.approx([-1, 1], abs=0.08)


SPECS = [
    {"name": "b", "dist": "gamma", "params": {"shape": "a + 1", "scale": 1}},
    {"name": "a", "dist": "uniform", "params": {"low": 0, "high": 1}},
    {"name": "c", "formula": "a * 2 + b"},
    {"name": "d", "dist": "categorical", "params": {"categories": ["x", "y"], "probs": [0.5, 0.5]}},
    {"name": "e", "dist": "normal", "params": {"mu": "c", "sigma": 1}, "scope": "group", "group_by": "d"},
    {"name": "f", "dist": "poisson", "params": {"lam": "b * 3"}},
    {"name": "g", "dist": "normal", "params": {"mu": "b", "sigma": 1}, "scope": "global"},
    {"name": "h", "formula": "a * 10", "post": {"missing_rate": 0.05, "round_decimals": 3}},
]


def test_same_table_on_any_partitioning_and_order(spark):
    table = table_checksum(G.generate(spark, 3000, SPECS, seed=5)).first()
    assert table == table_checksum(G.generate(spark, 3000, SPECS[::-1], seed=5)).first()
    spread = G.add_columns(spark.range(3000).withColumnRenamed("id", "row_id").repartition(7), SPECS, seed=5).drop("row_id")
    assert table == table_checksum(spread).first()
    assert table != table_checksum(G.generate(spark, 3000, SPECS, seed=6)).first()


def test_cheaper_hash(spark, drawn):
    fast = G.generate(spark, 3000, SPECS, seed=5, hashing="xxhash64")
    assert table_checksum(fast).first() == table_checksum(G.generate(spark, 3000, SPECS[::-1], seed=5, hashing="xxhash64")).first()
    assert table_checksum(fast).first() != table_checksum(G.generate(spark, 3000, SPECS, seed=5)).first()
    df = spark.range(N).withColumnRenamed("id", "row_id")
    for name in ("normal", "gamma", "poisson", "binomial", "student_t"):
        df = G.with_random(df, name, name, MOMENTS[name][0], seed=3, hashing="xxhash64")
    pdf = df.toPandas()
    for name in ("normal", "gamma", "poisson", "binomial", "student_t"):
        _, mean, std = MOMENTS[name]
        assert abs(pdf[name].mean() - mean) < 5 * std / math.sqrt(N) and pdf[name].std() == pytest.approx(std, rel=0.08)
    assert abs(pdf.normal.corr(pdf.student_t)) < 0.04
    with pytest.raises(ValueError, match="unknown hash"):
        G.generate(spark, 5, SPECS, hashing="crc")


def test_draws_of_a_row_are_independent(spark):
    df = spark.range(N).withColumnRenamed("id", "row_id")
    df = G.with_random(df, "a", "uniform", {"low": 0, "high": 1}, seed=1)
    df = G.with_random(df, "b", "uniform", {"low": 0, "high": 1}, seed=1)
    df = G.with_random(df, "c", "beta", {"a": 2, "b": 2}, seed=1)
    pdf = df.toPandas()
    assert abs(np.corrcoef(pdf[["a", "b", "c"]].T) - np.eye(3)).max() < 0.04
    assert np.histogram(pdf.a, 20, (0, 1))[0].std() < 3 * math.sqrt(N / 20)


def test_scopes(spark):
    pdf = G.generate(spark, 500, SPECS, seed=5, keep_id=True).toPandas()
    assert pdf.groupby("d").e.nunique().tolist() == [1, 1] and pdf.g.nunique() == 1
    assert len(pdf) == 500 and 0 < pdf.h.isna().sum() < 60


def test_scope_needs_no_shuffle_for_fixed_parameters(spark):
    df = G.with_random(spark.range(10).withColumnRenamed("id", "row_id").withColumn("d", F.col("row_id") % 3), "x", "normal", {"mu": 0, "sigma": 1}, scope="group", group_by="d")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "dist, params",
    [("normal", {"mu": 0, "sigma": -1}), ("uniform", {"low": 2, "high": 1}), ("bernoulli", {"p": 1.5}), ("exponential", {"scale": 0}), ("normal", {"mu": 0}),
     ("categorical", {"categories": ["a"], "probs": [0.5]}), ("categorical", {"categories": [], "probs": []}), ("categorical", {"categories": [1], "probs": [1]}),
     ("categorical", {"categories": "a,b", "probs": "1.5,-0.5"}), ("triangular", {"left": 3, "mode": 2, "right": 5}), ("nope", {}), ("scipy.pareto", {}),
     ("binomial", {"n": 0, "p": 0.5}), ("beta", {"a": 0, "b": 1}), ("gamma", {"shape": 1, "scale": [1]})],
)
def test_bad_parameters(spark, dist, params):
    with pytest.raises(ValueError):
        G.with_random(spark.range(5).withColumnRenamed("id", "row_id"), "x", dist, params)


def test_bad_row_parameters_fail_the_query(spark):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    with pytest.raises(Exception, match="sigma >= 0"):
        G.with_random(df, "x", "normal", {"mu": 0, "sigma": "row_id - 2"}).collect()


def test_parameters_from_lookup_mapping_and_context(spark):
    df = spark.sql("SELECT 1 AS row_id, 'a' AS k UNION ALL SELECT 2, 'z'")
    params = {"low": {"lookup": "base", "key": "k", "default": 7}, "high": {"mapping": {"a": 101}, "key": "k", "default": 8}}
    got = {r["row_id"]: r["x"] for r in G.with_random(df, "x", "uniform", params, context={"base": {"a": 100}}).collect()}
    assert 100 < got[1] < 101 and 7 < got[2] < 8
    assert 5 < G.with_random(df, "x", "uniform", {"low": "K", "high": "K + 1"}, context={"K": 5}).first()["x"] < 6
    for bad in ({"lookup": "none", "key": "k"}, {"lookup": "base", "key": "q"}):
        with pytest.raises(ValueError):
            G.with_random(df, "x", "uniform", {"low": bad, "high": 1}, context={"base": {}})


def test_order_of_columns_and_cycles(spark):
    assert [s["name"] for s in G.in_order(SPECS)] == ["a", "b", "c", "d", "e", "f", "g", "h"]
    with pytest.raises(Exception):
        G.generate(spark, 5, [{"name": "a", "formula": "b"}, {"name": "b", "formula": "a"}])
    with pytest.raises(ValueError):
        G.generate(spark, 0, [])


def test_strict_formula(spark):
    specs = [{"name": "x", "formula": "1 / (row_id - 2)", "strict": True}]
    df = spark.range(5).withColumnRenamed("id", "row_id")
    with pytest.raises(Exception, match="division by zero"):
        G.add_columns(df, specs).collect()
    assert [r["x"] for r in G.add_columns(df, [{**specs[0], "strict": False}]).orderBy("row_id").collect()][2] is None


def test_register(spark):
    register_distribution("coin", lambda d, p: F.when(d.u() < 0.5, "head").otherwise("tail"))
    got = G.with_random(spark.range(200).withColumnRenamed("id", "row_id"), "x", "coin", {}).groupBy("x").count().collect()
    assert {r["x"] for r in got} == {"head", "tail"}
    del DISTRIBUTIONS["coin"]
