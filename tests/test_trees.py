"""Own trees, forests and boosting against plain Python on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulane.operators import modeling as M
from tabulane.operators import trees as T

ALL = {"type": "none"}


def table(spark, n=400, seed=1, missing=False):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 12, n).astype(float), rng.normal(size=n).round(1), rng.integers(0, 3, n).astype(float)
    y = 3 * (a > 4) + 2 * (a > 8) * (c == 1) + b * (c == 2) + rng.normal(size=n) * 0.3
    if missing:
        a[rng.random(n) < 0.2] = np.nan
    rows = [(i, None if np.isnan(x) else float(x), float(z), float(w), float(t)) for i, (x, z, w, t) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(3), np.column_stack([a, b, c]), y


def best(x, y, least):
    """(gain, feature, cut) of the best split of some rows, the first of equals."""
    found = (1e-12, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
            if gain > found[0] * (1 + 1e-12) + 1e-12:
                found = (gain, f, cut)
    return found


def plain_tree(x, y, depth=None, leaves=None, split=2, least=1, decrease=0.0):
    """Predictions of a tree grown leaf by leaf, always the leaf of the largest gain next."""
    groups = [(np.arange(len(y)), 0)]
    while leaves is None or len(groups) < leaves:
        options = []
        for k, (rows, level) in enumerate(groups):
            if len(rows) >= split and (depth is None or level < depth):
                gain, f, cut = best(x[rows], y[rows], least)
                if f is not None and gain >= decrease * len(y):
                    options.append((gain, k, f, cut))
        if not options:
            break
        _, k, f, cut = max(options, key=lambda o: o[0])
        rows, level = groups.pop(k)
        left = x[rows, f] <= cut
        groups += [(rows[left], level + 1), (rows[~left], level + 1)]
    out = np.zeros(len(y))
    for rows, _ in groups:
        out[rows] = y[rows].mean()
    return out, len(groups)


def predictions(fitted, df):
    return np.array([r[0] for r in M.predict(fitted, df).orderBy("id").select(M.PREDICTION).collect()], dtype=float)


@pytest.mark.parametrize(
    "params, plain",
    [
        ({"max_depth": 3}, {"depth": 3}),
        ({"max_depth": 8, "max_leaf_nodes": 5}, {"depth": 8, "leaves": 5}),
        ({"max_depth": 8, "max_leaf_nodes": 12, "min_samples_leaf": 7}, {"depth": 8, "leaves": 12, "least": 7}),
        ({"max_depth": 6, "min_samples_split": 60}, {"depth": 6, "split": 60}),
        ({"max_depth": 6, "min_samples_split": 0.1}, {"depth": 6, "split": 40}),
        ({"max_depth": 6, "min_impurity_decrease": 0.02}, {"depth": 6, "decrease": 0.02}),
    ],
)
def test_tree_grows_best_first(spark, params, plain):
    df, x, y = table(spark)
    fitted = M.fit(df, "id", "decision_tree_regressor", "y", ["a", "b", "c"], params, ALL)
    expected, leaves = plain_tree(x, y, **plain)
    assert fitted.diagnostics["n_leaves"] == leaves
    assert np.allclose(predictions(fitted, df), expected, atol=1e-9)


def test_passes_of_few_nodes_give_the_same_tree(spark, monkeypatch):
    df, _, _ = table(spark)
    whole = M.fit(df, "id", "decision_tree_regressor", "y", ["a", "b", "c"], {"max_depth": 6}, ALL).model.model.splits()
    monkeypatch.setattr(T, "CELLS", 1)
    split = M.fit(df, "id", "decision_tree_regressor", "y", ["a", "b", "c"], {"max_depth": 6}, ALL).model.model.splits()
    assert [s[:5] for s in whole] == [s[:5] for s in split]
    assert np.allclose([s[5:] for s in whole], [s[5:] for s in split])


def test_importance_and_shape(spark):
    df, x, y = table(spark)
    fitted = M.fit(df, "id", "decision_tree_regressor", "y", ["a", "b", "c"], {"max_depth": 1}, ALL)
    assert fitted.diagnostics["tree_depth"] == 1 and fitted.model.coefficients()["a_importance"] == 1.0
    flat = M.fit(df.withColumn("y", F.lit(2.0)), "id", "decision_tree_regressor", "y", ["a"], {}, ALL)
    assert flat.diagnostics["n_leaves"] == 1 and set(predictions(flat, df)) == {2.0}
    gaps = df.withColumn("a", F.when(F.col("id") > 5, F.col("a")))
    assert M.predict(fitted, gaps).filter(F.col(M.PREDICTION).isNull()).count() == 6  # a tree of complete rows scores complete rows


def test_forest_is_the_mean_of_its_trees(spark):
    df, x, y = table(spark)
    same = M.fit(df, "id", "random_forest_regressor", "y", ["a", "b", "c"], {"n_estimators": 4, "max_depth": 3, "bootstrap": False}, ALL)
    assert np.allclose(predictions(same, df), plain_tree(x, y, depth=3)[0])
    drawn = M.fit(df, "id", "random_forest_regressor", "y", ["a", "b", "c"], {"n_estimators": 12, "max_depth": 4, "max_features": 2, "max_leaf_nodes": 6}, ALL)
    shapes = {tuple(s[1:4] for s in drawn.model.model.splits() if s[0] == t) for t in range(12)}
    assert len(shapes) > 3 and all(sum(s[2] is None for s in drawn.model.model.splits() if s[0] == t) <= 6 for t in range(12))
    assert drawn.metrics["r2"] > 0.7 and drawn.diagnostics["n_estimators_fitted"] == 12
    assert sum(drawn.model.coefficients().values()) == pytest.approx(1.0)


def plain_boosting(x, y, rounds, rate, depth, least):
    """Boosting by trying, for every cut, both sides for missing values."""
    p = np.full(len(y), y.mean())
    for _ in range(rounds):
        rest, groups = y - p, [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in groups:
                found = (1e-12, None)
                for f in range(x.shape[1]):
                    v, gone = x[rows, f], np.isnan(x[rows, f])
                    values = np.unique(v[~gone])
                    cuts = [*((values[:-1] + values[1:]) / 2), *([np.inf] if gone.any() else [])]
                    for side in (False, True) if gone.any() else (False,):
                        for cut in cuts:
                            left = np.where(gone, side, v <= cut)
                            n = left.sum()
                            if min(n, len(rows) - n) < max(1, least):
                                continue
                            gain = rest[rows[left]].sum() ** 2 / n + rest[rows[~left]].sum() ** 2 / (len(rows) - n) - rest[rows].sum() ** 2 / len(rows)
                            if gain > found[0] * (1 + 1e-12) + 1e-12:
                                found = (gain, left)
                after += [rows] if found[1] is None else [rows[found[1]], rows[~found[1]]]
            groups = after
        for rows in groups:
            p[rows] += rate * rest[rows].mean()
    return p


def test_boosting_learns_where_missing_values_go(spark, monkeypatch):
    df, x, y = table(spark, missing=True)
    monkeypatch.setattr(T, "REFRESH", 3)  # predictions are written down in between
    params = {"max_iter": 7, "max_depth": 2, "learning_rate": 0.3, "min_samples_leaf": 10, "early_stopping": False}
    fitted = M.fit(df, "id", "hist_gradient_boosting_regressor", "y", ["a", "b", "c"], params, ALL)
    assert np.allclose(predictions(fitted, df), plain_boosting(x, y, 7, 0.3, 2, 10), atol=1e-9)
    assert fitted.diagnostics["n_iterations"] == 7


def test_boosting_stops_early(spark):
    rng = np.random.default_rng(3)
    noise = spark.createDataFrame([(i, float(rng.integers(0, 30)), float(rng.normal())) for i in range(600)], "id int, a double, y double")
    params = {"max_iter": 60, "early_stopping": True, "n_iter_no_change": 3, "validation_fraction": 0.3, "min_samples_leaf": 2}
    assert M.fit(noise, "id", "hist_gradient_boosting_regressor", "y", ["a"], params, ALL).diagnostics["n_iterations"] < 30


def test_many_values_fall_into_quantile_bins(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") * 0.5).alias("a"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") < 9000, 1.0).otherwise(3.0).alias("y"))
    edges = T.bin_edges(df, ["a", "none"], 64)
    assert 60 <= len(edges[0]) <= 64 and len(edges[1]) == 0 and np.all(np.diff(edges[0]) > 0)
    fitted = M.fit(df.drop("none"), "id", "decision_tree_regressor", "y", ["a"], {"max_depth": 4, "max_bins": 64}, ALL)
    assert fitted.metrics["r2"] > 0.95


def test_refusals(spark):
    df, _, _ = table(spark, 50)
    for model, params in [
        ("decision_tree_regressor", {"max_leaf_nodes": 1}),
        ("decision_tree_regressor", {"max_features": 9}),
        ("random_forest_regressor", {"max_features": "half"}),
        ("decision_tree_regressor", {"splitter": "random"}),
    ]:
        with pytest.raises(ValueError):
            M.fit(df, "id", model, "y", ["a", "b"], params, ALL)
    with pytest.raises(ValueError):
        M.fit(df.limit(0), "id", "hist_gradient_boosting_regressor", "y", ["a"], {}, ALL)
