"""Projection, ranking, skewed joins, lookups, profiles, constraints and key figures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulane.operators import kpi as K
from tabulane.operators import lookup as L
from tabulane.operators import profile as A
from tabulane.operators import projection as P
from tabulane.operators import quality as Q
from tabulane.operators.percentiles import exact_percentiles
from tabulane.operators.ranking import with_rank
from tabulane.operators.skew import _place, _salts, dimension_join, hot_hashes, is_small, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are missing."""
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 500)
    return spark.range(6000).select("id", k.cast("long").alias("k"), (F.col("id") % 97).cast("double").alias("v"))


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_join(spark, skewed, how):
    side = spark.range(0, 600, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    side = side.unionByName(side.filter("k < 20"))  # repeated keys on the other side too
    if how in ("left_semi", "left_anti"):
        side = side.select("k")
    assert plain(salted_join(skewed, side, ["k"], how)) == plain(skewed.join(side, ["k"], how))


def test_hot_keys_are_few(skewed):
    hot = hot_hashes(skewed, ["k"])
    want = {r[0] for r in skewed.filter("k = 7 OR k IS NULL").select(F.xxhash64("k")).collect()}
    assert want <= set(hot) and len(hot) <= 1000
    assert hot_hashes(skewed.select("id"), ["id"]) == {}


def test_large_dimension_is_not_broadcast(spark, skewed, monkeypatch):
    side = spark.range(500).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("w"))
    small = dimension_join(skewed, side, ["k"])
    monkeypatch.setattr("tabulane.operators.skew.is_small", lambda df: False)
    large = dimension_join(skewed, side, ["k"])
    assert "_salt" in large._jdf.queryExecution().analyzed().toString()
    assert plain(small) == plain(large)


def test_small_means_few_rows_and_few_bytes(spark):
    texts = spark.range(50).select("id", F.expr("repeat('x', 1000)").alias("t"), F.array(F.lit("yy")).alias("a"))
    assert is_small(texts) and not is_small(texts, max_bytes=40_000) and not is_small(texts, max_rows=49)
    assert is_small(spark.range(10)) and not is_small(spark.range(10), max_bytes=100)


def test_join_chain_with_a_hot_key(spark, skewed, monkeypatch):
    monkeypatch.setattr("tabulane.operators.skew.is_small", lambda df: False)
    one = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 9).alias("g"))
    two = spark.range(9).select(F.col("id").alias("g"), F.concat(F.lit("g"), F.col("id")).alias("name"))
    assert plain(L.join_chain(skewed, [(one, ["k"]), (two, ["g"])])) == plain(skewed.join(one, "k").join(two, "g"))


def test_rank_is_the_sorted_position(spark):
    df = spark.range(5000).select(F.expr("(id * 7919) % 5003").alias("a"), "id")
    got = {r["id"]: r["_rank"] for r in with_rank(df, [F.col("a").desc(), F.col("id")]).collect()}
    pdf = df.toPandas().sort_values(["a", "id"], ascending=[False, True])
    assert got == {i: n for n, i in enumerate(pdf["id"])}


def test_thin_and_pages(spark, monkeypatch):
    df = spark.range(2500)
    assert [r[0] for r in P.thin(df, [F.col("id")], 1000).collect()] == list(range(0, 2500, 3))
    assert P.thin(df, [F.col("id")], 2500).count() == 2500
    rows, total = P.page(df, [F.col("id").desc()], 5, 3)
    assert [r[0] for r in rows.collect()] == [2494, 2493, 2492] and total == 2500
    monkeypatch.setattr(P, "TOP_ROWS", 10)
    deep, _ = P.page(df, [F.col("id").desc()], 2000, 3)
    assert [r[0] for r in deep.collect()] == [499, 498, 497]


def test_sort_puts_missing_last(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 5), (2, NULL), (3, 1) AS t(id, v)")
    assert [r["id"] for r in P.sort_table(df, "v").collect()] == [3, 1, 2]
    assert [r["id"] for r in P.sort_table(df, "v", ascending=False).collect()] == [1, 3, 2]


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(4000)
    train, test = P.split(df, "id", 0.25, 3)
    _, again = P.split(df.repartition(13), "id", 0.25, 3)
    assert train.count() + test.count() == 4000 and abs(test.count() - 1000) < 100
    assert plain(test) == plain(again)
    assert P.split(df, "id", kind="none") == (df, df)
    with pytest.raises(ValueError):
        P.split(df, "id", 1.5)


def test_complete_cases(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 2.0D), (NULL, 1.0D), (3, CAST('NaN' AS DOUBLE)) AS t(a, b)")
    assert P.complete_cases(df, ["a", "b"]).count() == 1
    assert P.completeness(df, ["a", "b"]).first()[:] == (1, 2)
    with pytest.raises(ValueError, match="no rows left"):
        P.complete_cases(df.filter("a IS NULL"), ["a"], check=True)


def test_trailing_window_limits(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t, 1 AS u")
    assert P.trailing_window(df, "t", 24, "2024-01-02T00:00:00", u=1).count() == 1
    assert P.trailing_window(df, "t", 23, "2024-01-02T00:00:00").count() == 0
    with pytest.raises(ValueError):
        P.trailing_window(df, "t", 2161, "2024-01-02T00:00:00")


def test_lookups(spark):
    df = spark.sql("SELECT * FROM VALUES ('first', true), ('second', false), ('x', NULL), (NULL, true) AS t(level, flag)")
    table = {"first": 3000, "second": 6000}
    assert [r["v"] for r in L.lookup(df, "level", table, "v", default=999).collect()] == [3000, 6000, 999, 999]
    assert [r["v"] for r in L.lookup(df, "flag", {"True": "yes", "False": "no"}, "v", default="?").collect()] == ["yes", "no", "?", "yes"]
    with pytest.raises(Exception, match="pay.*key x"):
        L.lookup(df, "level", table, "v", on_missing="error", name="pay").collect()
    large = {str(i): i for i in range(1000)}
    numbers = spark.range(1500)
    assert [r["v"] for r in L.lookup(numbers, "id", large, "v", default=-1).orderBy("id").collect()] == [i if i < 1000 else -1 for i in range(1500)]
    with pytest.raises(Exception, match="no entry"):
        L.lookup(numbers, "id", large, "v", on_missing="error").collect()


def test_group_value_on_hot_groups(skewed):
    got = {(r["k"], r["m"]) for r in L.group_value(skewed, "k", F.sum("v"), "m").select("k", "m").distinct().collect()}
    want = {(r["k"], r["m"]) for r in skewed.filter("k IS NOT NULL").groupBy("k").agg(F.sum("v").alias("m")).collect()}
    assert got - {(None, None)} == want


@pytest.mark.parametrize("few", [1, 5, 50, 10**6])
def test_exact_percentiles(spark, few):
    rng = np.random.default_rng(few)
    frame = pd.DataFrame({"a": rng.normal(size=3000), "hot": np.where(rng.uniform(size=3000) < 0.4, 5.0, rng.uniform(0, 10, 3000)),
                          "flat": np.full(3000, 2.0), "gaps": np.where(rng.uniform(size=3000) < 0.3, np.nan, rng.exponential(size=3000))})
    df = spark.createDataFrame(frame).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = exact_percentiles(df, {c: F.col(c) for c in df.columns}, probs, few=few)
    for c in frame.columns:
        assert got[c] == pytest.approx(list(frame[c].quantile(probs)), abs=1e-12)
    assert got["none"] == [None] * 6


def test_profile(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, np.nan, 4.0], "c": ["a", "a", None, "b"], "f": [True, False, True, True], "n": [1, 2, 3, 4]})
    df = spark.createDataFrame(pdf).withColumn("c", F.col("c"))
    rows = {r["column"]: r for r in A.profile(df).collect()}
    assert rows["x"]["mean"] == pytest.approx(7 / 3) and rows["x"]["std"] == pytest.approx(pdf.x.std()) and rows["x"]["median"] == 2.0
    assert rows["x"]["null_count"] == 1 and rows["x"]["null_rate"] == 0.25
    assert [rows[c]["dtype"] for c in ("x", "c", "f", "n")] == ["float", "string", "bool", "int"]
    cats = {(r["column"], r["category"]): (r["n"], round(r["rate"], 6)) for r in A.profile_categories(df).collect()}
    assert cats == {("c", "a"): (2, 0.666667), ("c", "b"): (1, 0.333333), ("f", "true"): (3, 0.75), ("f", "false"): (1, 0.25)}
    empty = A.profile(df.filter("n > 10")).collect()
    assert all(r["null_rate"] == 0 and r["mean"] is None for r in empty)


def test_correlations(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)) + 1e6, columns=list("abcd"))
    pdf["e"] = 1e9 + pdf.a * 3
    pdf["flat"] = 5.0
    pdf.loc[pdf.index % 7 == 0, "b"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "c"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {(r["col_x"], r["col_y"]): (r["r"], r["n"]) for r in A.correlation_matrix(df).collect()}
    want = pdf.corr()
    assert len(got) == 36
    for x in pdf.columns:
        for y in pdf.columns:
            r, n = got[x, y]
            assert n == len(pdf[[x, y]].dropna())
            assert r == pytest.approx(0.0 if "flat" in (x, y) else want.loc[x, y], abs=1e-7)
    assert A.correlation(df, "a", "flat").first()["r"] == 0.0
    assert A.correlation(df, "b", "c").first()["r"] == pytest.approx(want.loc["b", "c"], abs=1e-9)


def test_histograms(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0D, 'a'), (5.0D, 'a'), (10.0D, NULL), (9.99D, 'b'), (NULL, 'b') AS t(v, c)")
    rows = {(r["bin"], r["category"]): (r["n"], r["total"]) for r in A.histogram(df, "v", 10, by="c").collect()}
    assert len(rows) == 30 and rows[0, "a"] == (1, 1) and rows[5, "a"] == (1, 1) and rows[9, "Unknown"] == (1, 2) and rows[9, "b"] == (1, 2) and rows[3, "a"] == (0, 0)
    one = A.histogram(spark.sql("SELECT 3.0D AS v UNION ALL SELECT 3.0D"), "v").collect()
    assert [r[:] for r in one] == [(0, 2.5, 3.5, "All", 2, 2)]
    assert A.histogram(df.filter("v > 100"), "v").count() == 0
    stats = {r["category"]: (r["n"], r["mean"], r["std"]) for r in A.group_stats(df, "v", "c").collect()}
    assert stats["a"] == (2, 2.5, 2.5)


def test_detect_types(spark):
    df = spark.range(300).select("id", (F.col("id") / 3).alias("f"), (F.col("id") * 2.0).alias("w"), F.expr("cast(id % 3 as string)").alias("cat"),
                                 F.expr("cast(id as string)").alias("txt"), (F.col("id") > 3).alias("b"), F.lit(None).cast("double").alias("nil"))
    got = {r["column"]: r["dtype"] for r in A.detect_types(df, "id").collect()}
    assert got == {"id": "int", "f": "float", "w": "int", "cat": "category", "txt": "string", "b": "bool", "nil": "string"}


def test_scores(spark):
    y, p = np.array([3.0, -0.5, 2.0, 7.0]), np.array([2.5, 0.0, 2.0, 8.0])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    m = {r["metric"]: r["value"] for r in A.regression_metrics(df, "y", "p").collect()}
    e = y - p
    want = {"r2": 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), "mae": 0.5, "rmse": np.sqrt(0.375), "mse": 0.375,
            "explained_variance": 1 - e.var() / y.var(), "median_ae": 0.5, "max_error": 1.0, "mape": np.mean(abs(e) / abs(y))}
    assert m == pytest.approx(want)
    zero = spark.createDataFrame(pd.DataFrame({"y": [0.0, 1.0], "p": [0.5, 1.0]}))
    assert "mape" not in {r["metric"] for r in A.regression_metrics(zero, "y", "p").collect()}
    flat = spark.createDataFrame(pd.DataFrame({"y": [2.0, 2.0], "p": [2.0, 2.0]}))
    assert {r["metric"]: r["value"] for r in A.regression_metrics(flat, "y", "p").collect()}["r2"] == 1.0
    assert [r["_residual"] for r in A.residuals(df.withColumn("p", F.when(F.col("p") > 1, F.col("p"))), "y", "p").orderBy("y").collect()] == [0.0, 0.5, -1.0]


def test_constraints(spark, skewed):
    rules = [{"type": "unique", "target": "k"}, {"type": "range", "target": "v", "min": 3, "max": 90}, {"type": "not_null", "target": "k"},
             {"type": "comparison", "target": "k", "operator": "<", "other": "id"}]
    pdf = skewed.toPandas().sort_values("id")
    ok = pd.DataFrame({"u": ~(pdf.k.notna() & pdf.duplicated("k")), "r": pdf.v.between(3, 90), "n": pdf.k.notna(), "c": pdf.k.isna() | (pdf.k < pdf.id)})
    report = {(r["type"], r["target"]): r for r in Q.constraint_report(skewed, rules, "id").collect()}
    assert report["all", ""]["pass_rate"] == pytest.approx(ok.all(axis=1).mean())
    assert [report[t, c]["failures"] for t, c in (("unique", "k"), ("range", "v"), ("not_null", "k"), ("comparison", "k"))] == [int((~ok[x]).sum()) for x in "urnc"]
    clean, bad = Q.quarantine(skewed, rules, "id")
    assert clean.count() == ok.all(axis=1).sum() and clean.count() + bad.count() == 6000
    assert bad.filter("id = 3").first()["_reasons"] == ["unique(k)", "k < id"]
    none = Q.constraint_report(skewed, []).collect()
    assert [(r["type"], r["pass_rate"]) for r in none] == [("all", 1.0)]
    with pytest.raises(ValueError):
        Q.check(skewed, [{"type": "comparison", "target": "k", "operator": "!=", "other": "id"}])
    with pytest.raises(ValueError):
        Q.check(skewed, [{"type": "unique", "target": "k"}])
    with pytest.raises(ValueError):
        Q.check(skewed, [{"type": "not_null", "target": "zzz"}])


EVENTS = "event_type string, path_id string, latency_ms int, metadata string, created_at timestamp"


def events(spark, rows):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, 12)
    return spark.createDataFrame([(*r, at) for r in rows], EVENTS)


def test_kpi_batch(spark):
    df = events(spark, [("click", "p1", None, None), ("click", "p1", None, "{}"), ("flow_started", "p1", None, None), ("flow_completed", "p1", None, None),
                        ("feedback_latency", None, 200, None), ("visible_actions_snapshot", None, None, '{"count": 5}')])
    k = {r["kpi"]: r["value"] for r in K.kpi_snapshot(df, "2024-01-02T00:00:00").collect()}
    assert (k["avg_clicks_happy_path"], k["completion_rate_pct"], k["p95_feedback_latency_ms"], k["visible_primary_actions"]) == (2.0, 100.0, 200.0, 5.0)
    failed = {r["kpi"] for r in K.kpi_gate(K.kpi_snapshot(df, "2024-01-02T00:00:00"), phase="phase4").filter("NOT passed").collect()}
    assert failed == {"familiar_pattern_coverage_pct", "progress_feedback_coverage_pct"}


def test_kpi_empty_and_typed_metadata(spark):
    empty = K.kpi_snapshot(events(spark, []), "2024-01-02T00:00:00").collect()
    assert len(empty) == 8 and all(r["value"] == 0.0 for r in empty)
    df = events(spark, [("visible_actions_snapshot", None, None, '{"count": "9"}'), ("visible_actions_snapshot", None, None, '{"count": 4.9}'),
                        ("feedback_latency", None, 900, '{"user_initiated": false}'), ("feedback_latency", None, 100, '{"user_initiated": "false"}'),
                        ("feedback_latency", None, 300, '{"user_initiated": true}'), ("x", None, None, '{"familiar_pattern": true, "pointer_travel_px": 10}'),
                        ("x", None, None, '{"familiar_pattern": 0, "pointer_travel_px": "7"}'), ("click", "", None, None), ("flow_started", "p", None, None),
                        ("progress_feedback", None, None, None), ("progress_feedback", None, None, None)])
    k = {r["kpi"]: r["value"] for r in K.kpi_snapshot(df, "2024-01-02T00:00:00").collect()}
    assert k["visible_primary_actions"] == 4.0 and k["p95_feedback_latency_ms"] == pytest.approx(290.0)
    assert k["familiar_pattern_coverage_pct"] == 50.0 and k["avg_pointer_travel_px"] == 10.0
    assert k["avg_clicks_happy_path"] == 0.0 and k["progress_feedback_coverage_pct"] == 100.0


def test_equal_rows_of_a_hot_key_are_spread(spark, tmp_path):
    path = str(tmp_path / "hot")
    spark.range(20_000, numPartitions=2).select(F.lit(1).cast("long").alias("k")).write.parquet(path)
    hot = spark.read.parquet(path)
    side = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    joined = salted_join(hot, side, ["k"])
    assert joined.count() == 20_000 and joined.filter("w = 10").count() == 20_000
    places = _place(hot)
    salts = _salts({hot.select(F.xxhash64("k")).first()[0]: 1.0}, F.xxhash64("k"), 8)
    assert hot.select(F.pmod(F.xxhash64(*places), salts)).distinct().count() == 8


def test_repeated_lookup_key_fails(spark):
    df = spark.createDataFrame([(1,)], "k int")
    table = spark.createDataFrame([("1", 1.0), ("1", 2.0)], "key string, value double")
    with pytest.raises(Exception, match="repeated entry"):
        L.lookup(df, "k", table, "v").collect()


def test_correlation_of_many_columns(spark):
    wide = spark.range(50).select(*[((F.col("id") * (i + 3)) % 17).cast("double").alias(f"c{i}") for i in range(200)])
    rows = wide.toPandas()  # 50 rows
    got = {(r["col_x"], r["col_y"]): r["r"] for r in A.correlation_matrix(wide).collect()}
    want = rows.corr()
    assert len(got) == 40_000
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a in ("c0", "c7", "c199") for b in ("c1", "c7", "c151"))


@pytest.mark.parametrize("key", [None, ["id"]])
def test_pages_with_and_without_a_key(spark, key):
    df = spark.range(2500).select("id", (F.col("id") * 2).alias("v"))
    rows, total = P.page(df, [F.col("v").desc()], 1500, 3, key=key)
    assert [tuple(r) for r in rows.select("id", "v").collect()] == [(999, 1998), (998, 1996), (997, 1994)] and total == 2500
    assert [r["id"] for r in P.thin(df, [F.col("v")], 1000, key=key).collect()] == list(range(0, 2500, 3))
    assert P.page(df.limit(0), [F.col("v")], 0, 5, key=key)[1] == 0 and P.thin(df.limit(0), [F.col("v")], key=key).count() == 0


def test_unique_counts_rows_that_share_a_key(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (4, "b"), (5, "c"), (5, "d"), (None, "e"), (6, "e"), (None, "f"), (None, "f"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    found = Q.check(df, [{"type": "unique", "target": "v"}], "k").collect()
    passed = sorted(((r["k"], r["v"]) for r in found if r["_ok_0"]), key=repr)
    assert passed == sorted([(3, "b"), (5, "c"), (5, "d"), (6, "e"), (7, None), (7, None)], key=repr)
    whole = Q.constraint_report(df, [{"type": "unique", "target": "v"}], "k").filter("type = 'unique'").first()
    assert whole["failures"] == len(rows) - 6
    wide = Q.check(df.withColumn("j", F.col("k")), [{"type": "unique", "target": "v"}], ["k", "j"]).filter("_ok_0").count()
    assert wide == 6
