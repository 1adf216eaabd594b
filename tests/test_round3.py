"""Nested formulas, exact splits, digests of large files, sums without Python, log-gamma free of loops."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulane.functions.formula import formula
from tabulane.operators import projection as P
from tabulane.operators.products import pair_sums
from tabulane.sources import tables as S

from tests.conftest import column


def clip(x, low, high):
    return max(low, min(high, x))


@pytest.mark.parametrize("step", ["clip({} + 1, {i}, 90 - {i})", "({} * 3 + {i}) % 17", "({} * 5 - {i}) // 2", "max({} - {i}, min(9 - {i}, {i} * 2))", "floor(({} + 1) / 2)", "1 < {} + {i} < 30"])
def test_nested_formulas_stay_small(spark, step):
    df = spark.createDataFrame([(float(x),) for x in range(-40, 40)], "x double")
    text = "x"
    for i in range(12):
        text = step.replace("{i}", str(i)).replace("{}", f"({text})" if "<" not in step else f"where({text}, 3, x)" if i else "x")
    known = {"clip": clip, "max": max, "min": min, "floor": math.floor, "where": lambda c, a, b: a if c else b}
    wanted = [eval(text, {**known, "x": x}) for x in column(df, "x")]
    start = time.time()
    got = column(df.select(formula(text, df, max_nodes=None).alias("y")), "y")
    assert got == wanted
    assert time.time() - start < 20  # without binding it never ends; some 2 seconds alone on the machine


def test_nested_formula_keeps_missing_values_and_refusals(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (5.0,)], "x double")
    text = "clip(((x % 7) % 5) // 2 / x, 0, 9)"
    assert column(df.select(formula(text, df).alias("y")), "y") == [None, None, None, 0.0]
    with pytest.raises(Exception, match="division by zero"):
        df.select(formula(text, df, strict=True)).collect()
    # a division that `and` does not reach is not computed
    guarded = "where(x > 1, (((x % 7) % 6) % 3) / x, 0)"
    assert column(df.filter("x in (0, 5)").select(formula(guarded, df, strict=True).alias("y")), "y") == [0.0, 0.4]


@pytest.mark.parametrize("n, size", [(1, 0.5), (7, 0.01), (1000, 0.2), (1000, 0.999), (1003, 0.37)])
def test_split_has_the_exact_size(spark, n, size):
    df = spark.range(n).withColumn("digit", F.lit("clash")).withColumn("_bits", F.lit(1))
    train, test = P.split_exact(df, "id", size, 3)
    a, b = set(column(train, "id")), set(column(test, "id"))
    assert len(b) == math.ceil(n * size) and not a & b and len(a | b) == n
    again = P.split_exact(df.repartition(7), "id", size, 3)[1]
    assert set(column(again, "id")) == b and again.columns == df.columns


def test_split_of_odd_tables(spark):
    empty = spark.range(0)
    assert [t.count() for t in P.split_exact(empty, "id")] == [0, 0]
    nulls = spark.createDataFrame([(None, 1), (None, 2), (3, 3), (4, 4)], "k int, v int")
    train, test = P.split_exact(nulls, "k", 0.5)
    assert sorted(column(train, "v") + column(test, "v")) == [1, 2, 3, 4] and test.count() >= 2
    assert len({frozenset(column(t, "v")) & {1, 2} for t in (train, test)} - {frozenset()}) == 1  # rows of one key stay together
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            P.split_exact(nulls, "k", bad)


def test_threshold_is_exact_among_near_hashes(spark):
    bits = [5, 5, 6, 7, 7, 7, 1 << 40, (1 << 52) - 1]
    df = spark.createDataFrame([(b,) for b in bits], "_bits long")
    for wanted in range(1, len(bits) + 1):
        last = P.exact_threshold(df, wanted)
        at_least = next(b for b in bits if sum(x <= b for x in bits) >= wanted)
        assert sum(x <= last for x in bits) == sum(x <= at_least for x in bits)


def test_digests_in_pieces(spark, tmp_path):
    contents = {"empty.bin": b"", "small.bin": b"abc", "exact.bin": bytes(range(64)), "big one.bin": np.random.default_rng(1).bytes(1_000_001)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    wanted = sorted((len(c), hashlib.sha256(c).hexdigest()) for c in contents.values() if c)  # empty files are passed over
    for whole, piece in ((S.WHOLE_FILE, S.PIECE), (3, 64), (-1, 7 << 10)):
        got = S.file_digests(spark, str(tmp_path), whole, piece)
        assert sorted((r["bytes"], r["sha256"]) for r in got.collect()) == wanted


def test_sums_of_few_columns_agree_with_the_matrix_way(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4)) * [1, 10, 0.1, 1000]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(5)
    values, shift = [F.col(c) for c in "abcd"], [0.5, 1.0, 0.0, -3.0]
    for few, many in zip(pair_sums(df, values, shift, complete=True), pair_sums(df, values, shift)):
        np.testing.assert_allclose(few, many, rtol=1e-9)
    none = pair_sums(df.limit(0), values, shift, complete=True)
    assert all((part == 0).all() for part in none)
