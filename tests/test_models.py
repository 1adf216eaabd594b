"""Regression fits against closed forms, and the fit flow."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulane.operators import modeling as M
from tabulane.operators.angles import Factor, angle_path

N = 600


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(42)
    age, income, spending = rng.normal(30, 10, N), rng.normal(50000, 15000, N), rng.normal(2000, 500, N)
    y = 3 * age + 0.01 * income - 0.2 * spending + 1e6 + rng.normal(0, 5, N)
    return pd.DataFrame({"id": range(N), "age": age, "income": income, "spending": spending, "y": y, "churned": rng.integers(0, 2, N)})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


FEATURES = ["age", "income", "spending"]
ALL = {"type": "none"}


def test_least_squares_is_exact(df, frame):
    fit = M.fit(df, "id", "linear_regression", "y", FEATURES, split_spec=ALL)
    x = np.column_stack([frame[FEATURES], np.ones(N)])
    want = np.linalg.lstsq(x, frame.y, rcond=None)[0]
    got = fit.model.coefficients()
    assert [got[f] for f in [*FEATURES, "_intercept"]] == pytest.approx(list(want), rel=1e-8)
    assert fit.metrics["r2"] == pytest.approx(fit.metrics["test_r2"]) and fit.metrics["r2"] > 0.99
    assert fit.diagnostics["residuals_mean"] == pytest.approx(0, abs=1e-6)


def test_ridge_normal_equations(df, frame):
    alpha = 1000.0
    got = M.fit(df, "id", "ridge", "y", FEATURES, {"alpha": alpha}, ALL).model.coefficients()
    x, y = frame[FEATURES] - frame[FEATURES].mean(), frame.y - frame.y.mean()
    want = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ y)
    assert [got[f] for f in FEATURES] == pytest.approx(list(want), rel=1e-7)


@pytest.mark.parametrize("model, params, l1, l2", [("lasso", {"alpha": 20.0}, 20.0, 0.0), ("elastic_net", {"alpha": 8.0, "l1_ratio": 0.25}, 2.0, 6.0)])
def test_penalised_fits_meet_their_optimality_conditions(df, frame, model, params, l1, l2):
    fit = M.fit(df, "id", model, "y", FEATURES, params, ALL)
    w = np.array([fit.model.coefficients()[f] for f in FEATURES])
    x, y = frame[FEATURES] - frame[FEATURES].mean(), frame.y - frame.y.mean()
    gradient = np.array(x.T @ (x @ w - y)) / N + l2 * w
    for g, wi, scale in zip(gradient, w, x.std()):
        if wi != 0:
            assert g + l1 * np.sign(wi) == pytest.approx(0, abs=1e-5 * scale)
        else:
            assert abs(g) <= l1 + 1e-6
    assert fit.diagnostics["n_iterations"] >= 1


def test_repeated_feature_gets_the_shortest_solution(df):
    twice = df.withColumn("again", F.col("age"))
    got = M.fit(twice, "id", "linear_regression", "y", ["age", "again"], split_spec=ALL).model.coefficients()
    assert got["age"] == pytest.approx(got["again"])


@pytest.mark.parametrize("model, params", [("decision_tree_regressor", {"max_depth": 4}), ("random_forest_regressor", {"n_estimators": 5, "max_depth": 4}),
                                           ("gradient_boosting_regressor", {"n_estimators": 5}), ("hist_gradient_boosting_regressor", {"max_iter": 3}), ("huber_regressor", {})])
def test_mllib_models(spark, df, model, params):
    fit = M.fit(df, "id", model, "y", FEATURES, params)
    assert set(fit.metrics) >= {"r2", "mae", "rmse", "mse", "explained_variance", "median_ae", "max_error", "mape", "test_r2", "test_mae", "test_rmse"}
    assert fit.metrics["r2"] > 0.3
    terms = {r["term"] for r in fit.coefficients_frame(spark).collect()}
    assert terms == ({*FEATURES, "_intercept"} if model == "huber_regressor" else {f"{f}_importance" for f in FEATURES})
    gaps = df.withColumn("age", F.when(F.col("id") % 2 == 0, F.col("age")))
    scored = M.predict(fit, gaps)
    assert scored.count() == N and scored.filter("_prediction IS NULL").count() == N // 2 and "_features" not in scored.columns


def test_huber_minimises_its_loss(spark):
    """The fitted weights beat every nearby point on sum(scale + huber(z) * scale) + alpha * w'w."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=N), rng.normal(size=N)
    y = 2 * a - b + 4 + rng.normal(0, 0.3, N) + np.where(rng.uniform(size=N) < 0.1, 15.0, 0.0)
    data = spark.createDataFrame(pd.DataFrame({"id": range(N), "a": a, "b": b, "y": y}))
    fit = M.fit(data, "id", "huber_regressor", "y", ["a", "b"], {"tol": 1e-10, "max_iter": 500, "alpha": 5.0}, ALL)
    got = fit.model.coefficients()
    at = np.array([got["a"], got["b"], got["_intercept"], fit.model.model.scale])

    def loss(p):
        z = np.abs(y - p[0] * a - p[1] * b - p[2]) / p[3]
        return np.sum(p[3] + np.where(z < 1.35, z**2, 2 * 1.35 * z - 1.35**2) * p[3]) + 5.0 * (p[0] ** 2 + p[1] ** 2)

    for i in range(4):
        for step in (-0.01, 0.01, -0.001, 0.001):
            assert loss(at) <= loss(at + step * np.eye(4)[i])
    assert got["_intercept"] == pytest.approx(4, abs=0.2)


def test_flow_checks_and_split(df):
    with pytest.raises(ValueError, match="unknown model"):
        M.fit(df, "id", "nope", "y", FEATURES)
    with pytest.raises(ValueError, match="columns not found"):
        M.fit(df, "id", "ridge", "y", ["zzz"])
    with pytest.raises(ValueError, match="columns not found"):
        M.fit(df, "id", "ridge", "zzz", FEATURES)
    with pytest.raises(ValueError, match="no rows left"):
        M.fit(df.withColumn("age", F.lit(None).cast("double")), "id", "ridge", "y", FEATURES)
    one = M.fit(df, "id", "linear_regression", "y", FEATURES)
    same = M.fit(df.repartition(5), "id", "linear_regression", "y", FEATURES)
    assert one.metrics == pytest.approx(same.metrics, rel=1e-6)
    other = M.fit(df, "id", "linear_regression", "y", FEATURES, split_spec={"test_size": 0.5, "random_state": 1})
    assert other.metrics["test_r2"] != one.metrics["test_r2"]


def test_predict_limit(df):
    fit = M.fit(df, "id", "linear_regression", "y", ["age"])
    assert [r["id"] for r in M.predict(fit, df, 5, ["id"]).collect()] == [0, 1, 2, 3, 4]


def test_many_features_take_several_scans(spark, frame):
    rng = np.random.default_rng(0)
    wide = frame[["id"]].copy()
    for i in range(14):
        wide[f"x{i}"] = rng.normal(size=N)
    wide["y"] = sum((i + 1) * wide[f"x{i}"] for i in range(14))
    got = M.fit(spark.createDataFrame(wide), "id", "linear_regression", "y", [f"x{i}" for i in range(14)]).model.coefficients()
    assert [got[f"x{i}"] for i in range(14)] == pytest.approx(range(1, 15))


def test_lasso_path_meets_its_conditions_and_counts_its_turns():
    """On random problems, constant and repeated columns among them: products at alpha for the weights that are not zero, none above it."""
    rng, turned_back = np.random.default_rng(0), 0
    for trial in range(120):
        p, n = rng.integers(1, 9), 40
        x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p))
        y = x @ rng.normal(size=p) + rng.normal(size=n) * 3
        if trial % 5 == 0 and p > 1:
            x[:, -1] = 2 * x[:, 0]
        if trial % 7 == 0:
            x[:, 0] = 0
        xx, xy = x.T @ x, x.T @ y
        top = np.abs(xy).max()
        for share in (0.9, 0.3, 0.05, 0.0):
            knots = angle_path(xx, xy, True, 500, share * top)
            w, rest = knots[-1].weights, xy - xx @ knots[-1].weights
            assert np.abs(rest).max() <= share * top + 1e-7 * top
            on = np.abs(w) > 1e-10
            assert rest[on] == pytest.approx(np.sign(w[on]) * share * top, abs=1e-7 * top)
        turned_back += len(knots) - 1 > p
        least = angle_path(xx, xy, False, 500)
        assert np.abs(xy - xx @ least[-1].weights).max() <= 1e-7 * top and len(least) - 1 <= p
        assert np.count_nonzero(angle_path(xx, xy, False, 1)[-1].weights) <= 1
    assert turned_back > 10  # features left and came back


def test_factor_follows_entries_and_exits():
    x = np.random.default_rng(1).normal(size=(20, 6))
    g, f, active = x.T @ x, Factor(), []
    for j in range(6):
        assert f.enter(g[active, j], g[j, j])
        active.append(j)
    assert not f.enter(g[active, 0], g[0, 0])
    for k in (2, 0, 3):
        f.leave(k)
        active.pop(k)
        assert f.low @ f.low.T == pytest.approx(g[np.ix_(active, active)]) and (np.triu(f.low, 1) == 0).all()


def test_angle_models(df, frame):
    get = lambda model, **params: M.fit(df, "id", model, "y", FEATURES, params, ALL)
    want = get("lasso", alpha=20.0).model.coefficients()
    assert get("lasso_lars", alpha=20.0).model.coefficients() == pytest.approx(want, rel=1e-6, abs=1e-6)
    assert get("lars").model.coefficients() == pytest.approx(get("linear_regression").model.coefficients(), rel=1e-6)
    one = get("lars", n_nonzero_coefs=1)
    assert sum(w != 0 for t, w in one.model.coefficients().items() if t != "_intercept") == 1 and one.diagnostics["n_iterations"] == 1
    assert get("lasso_lars", alpha=1e12).model.coefficients() == pytest.approx({**dict.fromkeys(FEATURES, 0.0), "_intercept": frame.y.mean()})
    with pytest.raises(ValueError):
        get("lars", alpha=1.0)
    knots = M.angle_knots(df, "y", FEATURES).groupBy("knot").agg(F.max("alpha").alias("alpha")).orderBy("knot").collect()
    assert [k["knot"] for k in knots] == [0, 1, 2, 3] and knots[-1]["alpha"] == 0 and sorted(knots, key=lambda k: -k["alpha"]) == knots


def test_huber_is_not_moved_by_outliers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 9))
    y = x @ np.arange(1.0, 10.0) + 3 + rng.normal(size=500) * 0.1
    y[rng.permutation(500)[:120]] += 100
    data = spark.createDataFrame(pd.DataFrame({"id": range(500), **{f"x{i}": x[:, i] for i in range(9)}, "y": y}))
    fit = M.fit(data, "id", "huber_regressor", "y", [f"x{i}" for i in range(9)], {"alpha": 0.0, "max_iter": 400}, ALL)
    assert [fit.model.coefficients()[f"x{i}"] for i in range(9)] == pytest.approx(list(np.arange(1.0, 10.0)), abs=0.1)
    assert fit.diagnostics["n_outliers"] >= 120
    exact = M.fit(data.withColumn("y", F.col("x0") * 2 + 1), "id", "huber_regressor", "y", ["x0"], {}, ALL)
    assert exact.model.coefficients() == pytest.approx({"x0": 2.0, "_intercept": 1.0})
    with pytest.raises(ValueError):
        M.fit(data, "id", "huber_regressor", "y", ["x0"], {"epsilon": 0.5}, ALL)
