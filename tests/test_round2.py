"""One missing-value rule, answers that do not depend on sizes, and parameters that are not passed over."""

import time

import pytest
from pyspark.sql import functions as F

from tabulane.functions.formula import formula
from tabulane.operators import lookup as L
from tabulane.operators import modeling as M
from tabulane.operators import projection as P
from tabulane.operators import quality as Q
from tabulane.operators.percentiles import exact_percentiles
from tabulane.plans.generate import add_columns

NAN = float("nan")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (2, NAN, "a"), (3, None, "b"), (4, 2.0, "b")], "id long, x double, g string")


def test_nan_is_missing(odd):
    rules = [{"type": "not_null", "target": "x"}, {"type": "range", "target": "x", "max": 5}, {"type": "comparison", "target": "x", "operator": "<=", "other": "x"}]
    report = {r["type"]: r["failures"] for r in Q.constraint_report(odd, rules).collect()}
    assert report == {"all": 2, "not_null": 2}
    assert [r["id"] for r in P.sort_table(odd, "x", False, "id").collect()] == [4, 1, 2, 3]
    assert {r["id"]: r["top"] for r in L.group_value(odd, "g", F.max("x"), "top", row_key=["id"]).collect()} == {1: 1.0, 2: 1.0, 3: 2.0, 4: 2.0}


@pytest.mark.parametrize("more", [0, 300])
def test_lookup_does_not_depend_on_its_size(odd, more):
    table = {"a": "x", "b": 3, **{f"k{i}": i for i in range(more)}}
    found = L.lookup(odd, "g", table, "v").unionByName(L.lookup(odd.withColumn("g", F.lit("none")), "g", table, "v"))
    assert {r["v"] for r in found.collect()} == {"x", "3", "0"}


@pytest.mark.parametrize("n", [5, 64, 65])
def test_binomial_literal_equals_column(spark, n):
    keys = spark.range(500).withColumn("n", F.lit(n))
    one = add_columns(keys, [{"name": "a", "dist": "binomial", "params": {"n": n, "p": 0.4}}], seed=3, key="id")
    two = add_columns(keys, [{"name": "a", "dist": "binomial", "params": {"n": "n", "p": 0.4}}], seed=3, key="id")
    assert one.select("id", "a").exceptAll(two.select("id", "a")).count() == 0


def test_parameters_are_honoured_or_refused(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 7).alias("y"))
    found = M.MODELS["linear_regression"](df, "y", ["x"], {"fit_intercept": False}).coefficients()
    assert found["_intercept"] == 0 and found["x"] == pytest.approx(sum(i * (2 * i + 7) for i in range(50)) / sum(i * i for i in range(50)))
    for model in ("linear_regression", "decision_tree_regressor", "huber_regressor"):
        with pytest.raises(ValueError, match="not supported"):
            M.fit(df, "id", model, "y", ["x"], {"no_such_parameter": 5}, split_spec={"type": "none"})


def test_long_chains_stay_short(spark):
    df = spark.range(3).select(*[(F.col("id") - i).cast("double").alias(f"c{i}") for i in range(60)])
    start = time.time()
    found = df.select(formula(" or ".join(f"c{i}" for i in range(60)), df).alias("v")).collect()
    assert [r["v"] for r in found] == [-1.0, 1.0, 2.0]
    assert time.time() - start < 10


@pytest.fixture(scope="module")
def plane(spark):
    """y = 3a - 2b + 5 exactly, c has no part in it."""
    return spark.range(400).select(
        F.col("id").cast("string").alias("k"),
        (F.col("id") % 20).cast("double").alias("a"),
        F.pmod(F.col("id") * 7, F.lit(13)).cast("double").alias("b"),
        F.pmod(F.col("id") * 5, F.lit(11)).cast("double").alias("c"),
    ).withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 5)


def test_bayesian_ridge_finds_an_exact_plane(plane):
    found = M.fit(plane, "k", "bayesian_ridge", "y", ["a", "b", "c"], split_spec={"type": "none"}).model.coefficients()
    assert found == pytest.approx({"a": 3, "b": -2, "c": 0, "_intercept": 5}, abs=1e-4)


def test_matching_pursuit_takes_the_strongest_first(plane):
    one = M.fit(plane, "k", "orthogonal_matching_pursuit", "y", ["c", "a", "b"], split_spec={"type": "none"}).model
    assert one.coefficients()["a"] != 0 and one.coefficients()["b"] == one.coefficients()["c"] == 0
    most = M.fit(plane, "k", "orthogonal_matching_pursuit", "y", ["c", "a", "b"], {"tol": 1e-6}, {"type": "none"}).model
    assert most.coefficients() == pytest.approx({"c": 0, "a": 3, "b": -2, "_intercept": 5}, abs=1e-6)
    with pytest.raises(ValueError):
        M.fit(plane, "k", "orthogonal_matching_pursuit", "y", ["a"], {"n_nonzero_coefs": 2})


def test_percentiles_are_exact_with_merged_sketches(spark):
    rows = spark.range(0, 200_000, 1, 9).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"), (F.col("id") % 3).cast("double").alias("t"))
    rows = rows.withColumn("v", F.when(F.col("v") > 1000, F.col("v")))
    found = exact_percentiles(rows, {"v": F.col("v"), "t": F.col("t")}, [0.0, 0.37, 0.95, 1.0], few=50)
    wanted = rows.agg(*[F.percentile(c, F.array(*map(F.lit, [0.0, 0.37, 0.95, 1.0]))).alias(c) for c in ("v", "t")]).first()
    assert found["v"] == pytest.approx(wanted["v"], rel=1e-12) and found["t"] == wanted["t"]
