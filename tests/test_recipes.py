"""Steps, recipes and post-processing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulane.operators.postprocess import post_process
from tabulane.operators.projection import derive, select_columns
from tabulane.plans import recipes as R


def step(n, kind, out, **params):
    return {"step_id": f"s{n}", "type": kind, "output_column": out, "params": params, "order": n}


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"id": range(500), "income": rng.normal(50000, 10000, 500), "age": rng.integers(18, 65, 500)})
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("bins", [1, 2, 3, 7, 10])
@pytest.mark.parametrize("case", ["normal", "edges", "same", "tenths", "gaps"])
def test_bin_matches_pandas_cut(spark, bins, case):
    rng = np.random.default_rng(bins)
    values = {
        "normal": rng.normal(0, 100, 400),
        "edges": np.arange(0, 211).astype(float),
        "same": np.full(5, 3.0),
        "tenths": np.round(rng.uniform(0, 1, 400), 2) * 0.1 + 0.1,
        "gaps": np.where(rng.uniform(size=300) < 0.2, np.nan, rng.uniform(-5, 5, 300)),
    }[case]
    want = pd.cut(pd.Series(values), bins=bins, labels=False)
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "v": values}))
    got = R.apply_recipe(df, [step(1, "bin", "b", column="v", bins=bins)]).orderBy("i").toPandas()["b"]
    assert [None if pd.isna(x) else int(x) for x in got] == [None if pd.isna(x) else int(x) for x in want]


def test_bin_labels(people):
    out = R.apply_recipe(people, [step(1, "bin", "b", column="income", bins=3, labels="low, mid,high")])
    assert {r[0] for r in out.select("b").distinct().collect()} == {"low", "mid", "high"}
    with pytest.raises(ValueError, match="labels"):
        R.apply_recipe(people, [step(1, "bin", "b", column="income", bins=3, labels="a,b")])


def test_log_sqrt_exp_and_warnings(spark):
    df = spark.sql("SELECT * FROM VALUES (-1.0D), (0.0D), (4.0D), (800.0D), (CAST(NULL AS DOUBLE)) AS t(v)")
    steps = [step(1, "log", "l", column="v"), step(2, "sqrt", "s", column="v"), step(3, "exp", "e", column="v")]
    rows = R.apply_recipe(df, steps).collect()
    assert [r["l"] is None for r in rows] == [True, True, False, False, True]
    assert [r["s"] is None for r in rows] == [True, False, False, False, True]
    assert rows[3]["e"] == pytest.approx(np.exp(700)) and rows[4]["e"] is None
    warned = {r["step_id"]: r["warnings"] for r in R.recipe_warnings(df, steps).collect()}
    assert warned == {"s1": 2, "s2": 1, "s3": 1}


def test_chain_schema_lineage(spark, people):
    steps = [step(1, "formula", "double_income", expression="income * 2"), step(2, "log", "log_d", column="double_income"),
             step(3, "formula", "older", expression="age > 40")]
    out = R.apply_recipe(people, steps)
    assert out.columns == ["id", "income", "age", "double_income", "log_d", "older"]
    assert [f.dataType.simpleString() for f in R.recipe_schema(people, steps).fields[3:]] == ["double", "double", "boolean"]
    rows = R.lineage(spark, steps).collect()
    assert [(r["output_col"], r["inputs"]) for r in rows] == [("double_income", ["income"]), ("log_d", ["double_income"]), ("older", ["age"])]
    row = out.filter("id = 0").first()
    assert row["log_d"] == pytest.approx(np.log(row["income"] * 2))


def test_warnings_see_the_input_of_their_step(spark):
    df = spark.sql("SELECT -1.0D AS v")
    steps = [step(1, "log", "a", column="v"), step(2, "formula", "v", expression="v * -1"), step(3, "log", "b", column="v")]
    assert [r["warnings"] for r in R.recipe_warnings(df, steps).orderBy("step_id").collect()] == [1, 0]


def test_add_step_checks(people):
    steps = R.add_step(people, [], step(9, "formula", "x", expression="income + 1"))
    assert steps[0]["order"] == 1
    with pytest.raises(ValueError, match="already exists"):
        R.add_step(people, steps, step(2, "formula", "x", expression="age"))
    assert len(R.add_step(people, steps, step(2, "formula", "x", expression="age"), allow_overwrite=True)) == 2
    with pytest.raises(ValueError, match="nope"):
        R.add_step(people, steps, step(2, "log", "y", column="nope"))
    with pytest.raises(ValueError, match="unknown transform"):
        R.add_step(people, steps, step(2, "cube", "y", column="age"))


def test_overwrite_keeps_position(people):
    out = R.apply_recipe(people, [step(1, "formula", "income", expression="income / 1000")])
    assert out.columns == people.columns
    with pytest.raises(ValueError, match="allow_overwrite"):
        derive(people, "income", "age")


def test_delete_and_reorder(people):
    steps = [step(1, "formula", "a", expression="income"), step(2, "formula", "b", expression="a + 1"), step(3, "formula", "c", expression="b + 1"),
             step(4, "formula", "d", expression="age")]
    with pytest.raises(R.StepConflict) as conflict:
        R.delete_step(people, steps, "s1")
    assert conflict.value.step_ids == ["s2", "s3"] and conflict.value.columns == ["b", "c"]
    assert R.delete_step(people, steps, "s1", cascade=True).columns == ["id", "income", "age", "d"]
    assert R.delete_step(people, steps, "s3").columns == ["id", "income", "age", "a", "b", "d"]
    assert R.reorder_steps(people, steps, ["s4", "s1", "s2", "s3"]).columns[3:] == ["d", "a", "b", "c"]
    with pytest.raises(R.StepConflict, match="missing columns: a"):
        R.reorder_steps(people, steps, ["s2", "s1", "s3", "s4"])
    for bad in (["s1", "s2"], ["s1", "s1", "s2", "s3"], ["s1", "s2", "s3", "s9"]):
        with pytest.raises(ValueError, match="permutation"):
            R.reorder_steps(people, steps, bad)


def test_other_source_and_materialize(spark, people):
    steps = [step(1, "formula", "x", expression="income * 2")]
    assert R.apply_recipe(spark.range(3).withColumn("income", F.col("id") * 1.5), steps).count() == 3
    rows = R.materialize(people, steps, ["id", "x"], 10, ["id"]).collect()
    assert [r["id"] for r in rows] == list(range(10)) and rows[0].asDict().keys() == {"id", "x"}
    with pytest.raises(ValueError, match="columns not found"):
        R.materialize(people, steps, ["nope"])
    assert select_columns(people, "id, age").columns == ["id", "age"]


def test_recipe_reads_only_needed_columns(spark, data):
    li = spark.read.parquet(f"{data}/lineitem.parquet")
    out = R.materialize(li, [step(1, "formula", "net", expression="l_extendedprice * (1 - l_discount)"), step(2, "log", "u", column="l_tax")], ["net"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_quantity" not in plan


def test_post_process(spark):
    df = spark.sql("SELECT * FROM VALUES (1, -2.7D, 'a'), (2, 2.5D, 'b'), (3, 99.55D, 'c'), (4, CAST(NULL AS DOUBLE), NULL) AS t(row_id, v, s)")
    out = post_process(df, "v", clip_max=50, round_decimals=0, dtype="int").orderBy("row_id").collect()
    assert [r["v"] for r in out] == [-3, 2, 50, None]
    assert [r["v"] for r in post_process(df, "v", dtype="int").orderBy("row_id").collect()] == [-2, 2, 99, None]
    assert [r["v"] for r in post_process(df, "v", dtype="bool").orderBy("row_id").collect()] == [True, True, True, None]
    assert [r["s"] for r in post_process(df, "s", clip_min=0, dtype="int").orderBy("row_id").collect()] == ["a", "b", "c", None]
    assert all(r["v"] is None for r in post_process(df, "v", missing_rate=1.0).collect())
    for bad in ({"clip_min": 2, "clip_max": 1}, {"round_decimals": 11}, {"missing_rate": 1.5}, {"dtype": "decimal"}):
        with pytest.raises(ValueError):
            post_process(df, "v", **bad)
