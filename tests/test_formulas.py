"""Formula values, errors and missing-value rules."""

import math

import pytest
from pyspark.sql import functions as F

from tabulane.functions import scalars as S
from tabulane.functions.formula import FormulaError, formula, referenced_names

VALUES = [
    ("2 + 2", 4), ("10 - 3", 7), ("5 * 4", 20), ("20 / 4", 5), ("7 // 2", 3), ("7 % 3", 1), ("2 ** 3", 8),
    ("(2 + 3) * 4", 20), ("2 + 3 * 4", 14), ("100 / 10 / 2", 5), ("-7 // 2", -4), ("-7 % 3", 2), ("7 % -3", -2), ("-7.5 % 2", 0.5),
    ("x", 10), ("x + y", 15), ("x * y", 50), ("RATE", 0.15), ("BASE * RATE", 150), ("x2", 100),
    ("abs(-5)", 5), ("min(3, 7)", 3), ("max(3, 7, 9)", 9), ("round(3.7)", 4), ("round(2.5)", 2), ("round(-2.5)", -2), ("round(3.14159, 2)", 3.14),
    ("floor(3.7)", 3), ("floor(-3.2)", -4), ("ceil(3.2)", 4), ("sqrt(16)", 4), ("log(E)", 1), ("log(8, 2)", 3), ("log10(100)", 2), ("exp(0)", 1), ("pow(2, 3)", 8),
    ("sin(0)", 0), ("cos(0)", 1), ("tan(0)", 0), ("clamp(5, 0, 10)", 5), ("clamp(-5, 0, 10)", 0), ("clip(15, 0, 10)", 10),
    ("if_else(1 > 0, 10, 20)", 10), ("if_else(x < 3, 100, 0)", 0), ("where(x > 3, 100, 0)", 100),
    ("5 > 3", True), ("5 < 3", False), ("5 == 5", True), ("5 != 3", True), ("5 >= 5", True), ("1 < x <= 10", True), ("1 < x < 10", False),
    ("1 and 1", 1), ("1 and 0", 0), ("0 or 7", 7), ("not 0", True), ("TRUE and not FALSE", True),
    ("6 & 3", 2), ("6 | 3", 7), ("6 ^ 3", 5), ("~6", -7), ("1 << 4", 16), ("17 >> 2", 4),
    ("1 if x > 3 else 2", 1), ("base[site]", 12000), ("base[site] * 1.5", 18000), ("names[level]", "first"), ("'a' + 'b'", "ab"), ("'a' == 1", False),
    ('node("n1") * 2', 20), ("coalesce(gap, 3)", 3), ("isnull(gap)", True), ("isnan(gap)", True), ("PI", math.pi), ("TRUE + 1", 2),
    ("1 / 0", None), ("1 // 0", None), ("1 % 0", None), ("sqrt(-1)", None), ("log(0)", None), ("log(-1)", None), ("min(gap, 1)", None), ("gap + 1", None),
    ("if_else(gap > 1, 1, 2)", 2),
]


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql("SELECT 10 AS x, 5.0D AS y, 'south' AS site, 1 AS level, CAST(NULL AS DOUBLE) AS gap, 100 AS x2")


CONTEXT = {"RATE": 0.15, "BASE": 1000, "x2": 50, "base": {"north": 8000, "south": 12000}, "names": {"1": "first", "2": "second"}}


def test_values(row):
    cols = [formula(text, row, CONTEXT, {"n1": "x"}).alias(f"c{i}") for i, (text, _) in enumerate(VALUES)]
    got = row.select(*cols).first()
    for value, (text, want) in zip(got, VALUES):
        if isinstance(want, (bool, str)) or want is None:
            assert value == want and type(value) is type(want), text
        else:
            assert value == pytest.approx(want, abs=1e-9), text


@pytest.mark.parametrize(
    "text",
    ["nothing_here", "2 +", "(2 + 3", "open('f')", "__import__('os')", "x.real", "[1, 2]", "lambda: 1", "eval('1')", "min(1)", "x[0]", "1 + 'a'",
     "x < 'a'", "round(x, y)", "abs(x=1)", "1" * 1001, "+".join(["x"] * 300), "2.5 & 1", "(x for x in y)"],
)
def test_refused(row, text):
    with pytest.raises(FormulaError):
        formula(text, row, CONTEXT)


@pytest.mark.parametrize("text", ["1 / (x - 10)", "x // (x - 10)", "x % (x - 10)", "sqrt(-x)", "log(x - 10)", "log10(-x)"])
def test_strict_fails(row, text):
    with pytest.raises(Exception, match="division by zero|square root|logarithm"):
        row.select(formula(text, row, strict=True)).collect()


def test_missing_lookup_key_names_table_and_key(row):
    with pytest.raises(Exception, match="base.*nowhere"):
        row.withColumn("site", F.lit("nowhere")).select(formula("base[site]", row, CONTEXT)).collect()


def test_hint_for_unknown_name(row):
    with pytest.raises(FormulaError, match="closest: site"):
        formula("sitte + 1", row)


def test_column_named_like_a_function(spark):
    df = spark.sql("SELECT 4.0D AS sqrt")
    assert df.select(formula("sqrt(sqrt) + sqrt", df)).first()[0] == 6.0


def test_referenced_names():
    assert referenced_names("log(income) + age * 2 + base[site] + node('k')", {"k": "kk"}) == ["age", "base", "income", "kk", "site"]


def test_nan_is_missing(spark):
    df = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS v")
    assert df.select(formula("v + 1", df), formula("isnan(v)", df), formula("coalesce(v, 5)", df)).first()[:] == (None, True, 5.0)


def test_big_whole_numbers_stay_exact(spark):
    df = spark.sql("SELECT 9007199254740993L AS a, 1.0e300D AS b")
    got = df.select(formula("a + 2", df), formula("a % 10", df), S.floor(F.col("b"))).first()
    assert got[:] == (9007199254740995, 3, 1.0e300)


def test_caps_of_elements_hold_for_steps_only(spark):
    from tabulane.operators.projection import derive
    from tabulane.plans.recipes import apply_recipe

    df = spark.range(1).selectExpr("id AS x")
    long, wide = "+".join(["x"] * 80) + "+7", "max(" + ",".join(str(i) for i in range(60)) + ")"
    assert derive(derive(df, "y", long), "z", wide).first()[1:] == (7, 59)
    with pytest.raises(ValueError, match="200 elements"):
        apply_recipe(df, [{"step_id": "s1", "type": "formula", "output_column": "y", "order": 1, "params": {"expression": long}}]).collect()
