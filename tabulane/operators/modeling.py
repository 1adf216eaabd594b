"""Regression on a table: fits whose cost is a Spark aggregate or an MLlib job."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable, Protocol

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulane.operators import trees as T
from tabulane.operators.angles import Knot, angle_path
from tabulane.operators.products import pair_sums
from tabulane.operators.profile import regression_metrics, residual_stats
from tabulane.operators.projection import complete_cases, present, require_columns, split_flag
from tabulane.session import shared_dir

PREDICTION = "_prediction"


class Regressor(Protocol):
    """What a fitted model offers."""

    def predict(self, df: DataFrame) -> DataFrame: ...

    def coefficients(self) -> dict[str, float]: ...

    def details(self) -> dict[str, float]: ...


def _mask(df: DataFrame, features: list[str], value: Column) -> DataFrame:
    """Add the prediction; rows with a missing feature keep NULL."""
    return df.withColumn(PREDICTION, F.when(present(df, features), value))


# linear models ------------------------------------------------------------------------------


@dataclass
class Moments:
    """Row count, means and centred sums of products of some columns."""

    n: int
    mean: np.ndarray
    cross: np.ndarray


def moments(df: DataFrame, cols: list[str]) -> Moments:
    """Two passes: means, then sums of products of centred values (no cancellation at any size).

    Only the p means and p*(p+1)/2 sums reach the driver.
    """
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    sums = [f(c).alias(f"{name}{i}") for i, c in enumerate(x) for name, f in (("m", F.avg), ("n", F.count))]
    first = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    if not first["n"]:
        raise ValueError("no rows to fit on")
    mean = [first[f"m{i}"] for i in range(len(cols))]
    complete = all(first[f"n{i}"] == first["n"] for i in range(len(cols)))
    return Moments(first["n"], np.array(mean), pair_sums(df, x, mean, complete).p)


@dataclass
class LinearModel:
    features: list[str]
    weights: np.ndarray
    intercept: float
    iterations: int | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        value = F.lit(float(self.intercept))
        for name, w in zip(self.features, self.weights):
            value = value + F.col(f"`{name}`").cast("double") * F.lit(float(w))
        return _mask(df, self.features, value)

    def coefficients(self) -> dict[str, float]:
        return {**{f: float(w) for f, w in zip(self.features, self.weights)}, "_intercept": float(self.intercept)}

    def details(self) -> dict[str, float]:
        return {} if self.iterations is None else {"n_iterations": float(self.iterations)}


@dataclass
class HuberModel(LinearModel):
    """A linear model with the scale of its residuals and the number of rows beyond epsilon scales."""

    scale: float = 0.0
    outliers: float = 0.0

    @property
    def model(self) -> HuberModel:
        """Itself: where other fits wrap a model, callers read `model.scale`."""
        return self

    def details(self) -> dict[str, float]:
        return {**super().details(), "scale": self.scale, "n_outliers": self.outliers}


def _descend(xx: np.ndarray, xy: np.ndarray, l1: float, l2: float, rounds: int, tol: float) -> tuple[np.ndarray, int]:
    """Minimise w'xx w/2 - xy'w + l1*|w| + l2*w'w/2, one coordinate at a time."""
    w = np.zeros(len(xy))
    for done in range(1, rounds + 1):
        moved = 0.0
        for j in range(len(w)):
            if xx[j, j] + l2 == 0:
                continue
            rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (xx[j, j] + l2)
            moved, w[j] = max(moved, abs(new - w[j]) * np.sqrt(xx[j, j])), new
        if moved <= tol:
            break
    return w, done


# Parameters that change how a fit runs, but not its result.
NO_EFFECT = {"n_jobs", "copy_X", "verbose", "warm_start", "random_state", "precompute", "solver", "selection"}


def _known_only(params: dict, known: set[str]) -> None:
    """Refuse a parameter that would be passed over."""
    unknown = sorted(k for k, v in params.items() if v is not None and k not in known | NO_EFFECT)
    if unknown:
        raise ValueError(f"parameters not supported by this model: {unknown}; known are {sorted(known)}")


def _linear(kind: str) -> Callable[[DataFrame, str, list[str], dict], LinearModel]:
    def fit(df: DataFrame, target: str, features: list[str], params: dict) -> LinearModel:
        _known_only(params, {"alpha", "l1_ratio", "max_iter", "tol", "fit_intercept"})
        m = moments(df, [*features, target])
        centred = params.get("fit_intercept") is not False
        cross = m.cross if centred else m.cross + m.n * np.outer(m.mean, m.mean)
        xx, xy = cross[:-1, :-1], cross[:-1, -1]
        alpha, ratio, iterations = float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5)), None
        if kind == "ols":
            # unit diagonal first: columns of very different size stay well conditioned
            size = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
            w = np.linalg.lstsq(xx / np.outer(size, size), xy / size, rcond=None)[0] / size
        elif kind == "ridge":
            w = np.linalg.solve(xx + alpha * np.eye(len(features)), xy)
        else:
            l1 = alpha if kind == "lasso" else alpha * ratio
            l2 = 0.0 if kind == "lasso" else alpha * (1 - ratio)
            scale = np.sqrt(cross[-1, -1] / m.n)
            tol = 1e-10 * (scale if scale > 0 else 1.0)
            w, iterations = _descend(xx / m.n, xy / m.n, l1, l2, int(params.get("max_iter", 100_000)), tol)
        return LinearModel(list(features), w, float(m.mean[-1] - m.mean[:-1] @ w) if centred else 0.0, iterations)

    return fit


def _fit_moments(df: DataFrame, target: str, features: list[str], params: dict) -> tuple[Moments, np.ndarray, bool]:
    """Moments, sums of products (centred where an intercept is fitted), whether one is fitted."""
    m = moments(df, [*features, target])
    centred = params.get("fit_intercept") is not False
    return m, m.cross if centred else m.cross + m.n * np.outer(m.mean, m.mean), centred


def _bayesian_ridge(df: DataFrame, target: str, features: list[str], params: dict) -> LinearModel:
    """Ridge whose noise and weight precisions are re-estimated from the evidence until the weights settle.

    Everything but the moments is p x p work: one eigen decomposition, then a few vector sums per round.
    """
    priors = ("alpha_1", "alpha_2", "lambda_1", "lambda_2")
    _known_only(params, {"max_iter", "n_iter", "tol", "alpha_init", "lambda_init", "fit_intercept", *priors})
    a1, a2, l1, l2 = (float(params.get(k, 1e-6)) for k in priors)
    rounds, tol = int(params.get("max_iter") or params.get("n_iter") or 300), float(params.get("tol", 1e-3))
    m, cross, centred = _fit_moments(df, target, features, params)
    xy, yy = cross[:-1, -1], cross[-1, -1]
    values, vectors = np.linalg.eigh(cross[:-1, :-1])
    values = np.maximum(values, 0.0)
    turned = vectors.T @ xy
    spread = m.cross[-1, -1] / m.n  # variance of the target
    noise = float(params.get("alpha_init") or 1 / (spread + np.finfo(float).eps))
    weight = float(params.get("lambda_init") or 1.0)

    def solved() -> np.ndarray:
        return turned / (values + weight / noise)

    before = None
    for done in range(1, rounds + 1):
        w = solved()
        errors = max(yy - 2 * w @ turned + values @ np.square(w), 0.0)
        known = float(np.sum(noise * values / (weight + noise * values)))  # number of well determined weights
        weight, noise = (known + 2 * l1) / (w @ w + 2 * l2), (m.n - known + 2 * a1) / (errors + 2 * a2)
        if before is not None and np.abs(vectors @ (w - before)).sum() < tol:
            break
        before = w
    w = vectors @ solved()
    return LinearModel(list(features), w, float(m.mean[-1] - m.mean[:-1] @ w) if centred else 0.0, done)


def _matching_pursuit(df: DataFrame, target: str, features: list[str], params: dict) -> LinearModel:
    """Features enter one at a time, the one with the largest product with what is still unexplained; each time all weights are refitted.

    Stops at `n_nonzero_coefs` features (default: a tenth of them, at least one), or, where `tol` is given, once the summed squared
    error is at most that.
    """
    _known_only(params, {"n_nonzero_coefs", "tol", "fit_intercept"})
    m, cross, centred = _fit_moments(df, target, features, params)
    xx, xy, yy = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1]
    p, tol = len(features), params.get("tol")
    most = p if tol is not None else int(params.get("n_nonzero_coefs") or max(1, p // 10))
    if not 0 < most <= p:
        raise ValueError(f"n_nonzero_coefs has to lie between 1 and {p}")
    w, taken = np.zeros(p), []
    while len(taken) < most and (tol is None or yy - w @ xy > float(tol)):
        rest = np.abs(xy - xx @ w)
        rest[taken] = -1.0
        best = int(np.argmax(rest))
        if rest[best] <= 1e-12 * np.sqrt(xx[best, best] * yy):
            break  # nothing left to explain
        taken.append(best)
        w[taken] = np.linalg.lstsq(xx[np.ix_(taken, taken)], xy[taken], rcond=None)[0]
    return LinearModel(list(features), w, float(m.mean[-1] - m.mean[:-1] @ w) if centred else 0.0, len(taken))


def _turns(params: dict, default: int) -> int:
    most = default if params.get(name := "n_nonzero_coefs") is None and params.get(name := "max_iter") is None else int(params[name])
    if most < 1:
        raise ValueError(f"{name} has to be at least 1")
    return most


def _angles(lasso: bool) -> Callable[[DataFrame, str, list[str], dict], LinearModel]:
    """Least angles: the path after `n_nonzero_coefs` turns. Lasso: the path where the largest product per row is `alpha`, at most `max_iter` turns."""

    def fit(df: DataFrame, target: str, features: list[str], params: dict) -> LinearModel:
        _known_only(params, {"fit_intercept", *(("alpha", "max_iter") if lasso else ("n_nonzero_coefs",))})
        m, cross, centred = _fit_moments(df, target, features, params)
        least = float(params.get("alpha", 1.0)) * m.n if lasso else 0.0
        knots = angle_path(cross[:-1, :-1], cross[:-1, -1], lasso, _turns(params, 500), least)
        w = knots[-1].weights
        return LinearModel(list(features), w, float(m.mean[-1] - m.mean[:-1] @ w) if centred else 0.0, len(knots) - 1)

    return fit


def angle_knots(df: DataFrame, target: str, features: list[str], lasso: bool = False, fit_intercept: bool = True, most: int = 500) -> DataFrame:
    """(knot from 0, alpha, term, weight): the whole path of least angles, or of the lasso, over the complete rows of `df`.

    alpha is the largest product per row of a feature with the residual; at knot 0 all weights are 0, at the last one alpha is 0 unless `most` ends it.
    """
    require_columns(df, [target, *features])
    m, cross, _ = _fit_moments(complete_cases(df, [target, *features]), target, features, {"fit_intercept": fit_intercept})
    knots: list[Knot] = angle_path(cross[:-1, :-1], cross[:-1, -1], lasso, most)
    rows = [(i, k.product / m.n, f, float(w)) for i, k in enumerate(knots) for f, w in zip(features, k.weights)]
    return df.sparkSession.createDataFrame(rows, "knot int, alpha double, term string, weight double")


def _huber(df: DataFrame, target: str, features: list[str], params: dict) -> HuberModel:
    """Weights and scale that minimise the sum of scale + huber(residual / scale) * scale, plus alpha * w'w.

    Starts at least squares. A round is one aggregate: rows beyond epsilon scales count less the farther they are, the weighted sums of products give
    the next weights, the clipped residuals the next scale. Neither can raise the loss. Ends when nothing moves by more than `tol` scales.
    """
    _known_only(params, {"epsilon", "alpha", "max_iter", "tol", "fit_intercept"})
    epsilon, alpha = float(params.get("epsilon", 1.35)), float(params.get("alpha", 0.0001))
    rounds, tol = int(params.get("max_iter", 100)), float(params.get("tol", 1e-6))
    if epsilon < 1 or alpha < 0:
        raise ValueError("epsilon has to be at least 1 and alpha at least 0")
    m, cross, centred = _fit_moments(df, target, features, params)
    mean = m.mean if centred else np.zeros(len(m.mean))
    p = len(features)
    spread = np.sqrt(np.diag(cross) / m.n)
    # the intercept's column of ones comes first
    block = np.zeros((p + 1, p + 1))
    block[0, 0], block[1:, 1:] = m.n, cross[:-1, :-1]
    w = _weighted(block, np.concatenate([[0.0], cross[:-1, -1]]), np.zeros(p + 1), centred)
    scale = float(np.sqrt(max(cross[-1, -1] - w[1:] @ cross[:-1, -1], 0.0) / m.n))
    values = df.select(*[(F.col(f"`{c}`").cast("double") - F.lit(float(x))).alias(f"v{i}") for i, (c, x) in enumerate(zip([*features, target], mean))])
    done, outliers = 0, 0.0
    while done < rounds and scale > 1e-12 * spread[-1]:
        done += 1
        fitted = F.lit(float(w[0]))
        for i in range(p):
            fitted = fitted + F.col(f"v{i}") * F.lit(float(w[i + 1]))
        bound = F.lit(epsilon * scale)
        rows = values.withColumn("_rest", F.abs(F.col(f"v{p}") - fitted))
        rows = rows.withColumn("_root", F.when(F.col("_rest") <= bound, F.lit(1.0)).otherwise(F.sqrt(bound / F.col("_rest"))))
        # columns times the root of their row's weight: their products are the weighted sums
        columns = [F.col("_root"), *[F.col(f"v{i}") * F.col("_root") for i in range(p + 1)], F.least("_rest", bound), (F.col("_rest") > bound).cast("double")]
        sums = pair_sums(rows, columns, [0.0] * len(columns), complete=True).p
        block = sums[: p + 1, : p + 1]
        new = _weighted(block, sums[: p + 1, p + 1], np.concatenate([[0.0], np.full(p, alpha * scale)]), centred)
        new_scale, outliers = float(np.sqrt(sums[p + 2, p + 2] / m.n)), float(sums[p + 3, p + 3])
        moved = max(np.abs((new - w) * np.concatenate([[1.0], spread[:-1]])).max(), abs(new_scale - scale))
        w, scale = new, new_scale
        if moved <= tol * scale:
            break
    intercept = float(w[0] + mean[-1] - mean[:-1] @ w[1:]) if centred else 0.0
    return HuberModel(list(features), w[1:], intercept, done, scale, outliers)


def _weighted(block: np.ndarray, right: np.ndarray, penalty: np.ndarray, with_ones: bool) -> np.ndarray:
    """Weights of (block + penalty) w = right; without an intercept the first row takes no part. Columns of very different size are scaled first."""
    at = slice(0 if with_ones else 1, None)
    full = (block + np.diag(penalty))[at, at]
    size = np.sqrt(np.where(np.diag(full) > 0, np.diag(full), 1.0))
    w = np.zeros(len(right))
    w[at] = np.linalg.lstsq(full / np.outer(size, size), right[at] / size, rcond=None)[0] / size
    return w


# MLlib models -------------------------------------------------------------------------------


@dataclass
class MLModel:
    features: list[str]
    model: Any

    def predict(self, df: DataFrame) -> DataFrame:
        # rows with a missing feature pass through as NaN vectors and are masked afterwards
        columns = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, c in enumerate(self.features)]
        wide = df.select("*", *columns)
        names = [f"_f{i}" for i in range(len(columns))]
        vectors = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep").transform(wide)
        scored = self.model.transform(vectors)
        return _mask(scored, self.features, F.col("_raw")).drop("_features", "_raw", *names)

    def coefficients(self) -> dict[str, float]:
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
            return {f"{f}_importance": float(v) for f, v in zip(self.features, values)}
        return {
            **{f: float(v) for f, v in zip(self.features, self.model.coefficients.toArray())},
            "_intercept": float(self.model.intercept),
        }

    def details(self) -> dict[str, float]:
        found: dict[str, float] = {}
        if hasattr(self.model, "depth"):
            found["tree_depth"] = float(self.model.depth)
            found["n_leaves"] = float((self.model.numNodes + 1) // 2)
        if hasattr(self.model, "getNumTrees"):
            found["n_estimators_fitted"] = float(self.model.getNumTrees)
        if getattr(self.model, "hasSummary", False):
            found["n_iterations"] = float(self.model.summary.totalIterations)
        return found


# Parameter names of the model catalogue and what MLlib calls them.
BOOST = {
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "min_impurity_decrease": "minInfoGain",
    "max_bins": "maxBins",
    "random_state": "seed",
    "n_estimators": "maxIter",
    "max_iter": "maxIter",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
}


def _mllib(estimator, names: dict[str, str], **defaults) -> Callable[[DataFrame, str, list[str], dict], MLModel]:
    def fit(df: DataFrame, target: str, features: list[str], params: dict) -> MLModel:
        _known_only(params, set(names))
        shared_dir(df.sparkSession)
        given = {names[k]: v for k, v in params.items() if k in names and v is not None}
        if "featureSubsetStrategy" in given:
            given["featureSubsetStrategy"] = str(given["featureSubsetStrategy"])
        settings = dict(featuresCol="_features", labelCol=target, predictionCol="_raw")
        return MLModel(list(features), estimator(**settings, **{**defaults, **given}).fit(_vectors(df, target, features)))

    return fit


def _vectors(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in dict.fromkeys([*features, target])])
    return VectorAssembler(inputCols=features, outputCol="_features").transform(numbers)


# own trees ----------------------------------------------------------------------------------


@dataclass
class TreeModel:
    features: list[str]
    model: T.Ensemble

    def predict(self, df: DataFrame) -> DataFrame:
        # a missing value is scored where the fit met missing values of that feature
        needed = [f for f in self.features if f not in self.model.learned_missing]
        value = self.model.value(df)
        return _mask(df, needed, value) if needed else df.withColumn(PREDICTION, value)

    def coefficients(self) -> dict[str, float]:
        return self.model.coefficients()

    def details(self) -> dict[str, float]:
        return self.model.details()


def _rows_of(share: float | int | None, default: int, count: Callable[[], int]) -> float:
    """A number of rows, given as one or as a share (a float below 1) of all of them."""
    if share is None:
        return default
    return share if isinstance(share, int) or share >= 1 else int(np.ceil(share * count()))


def _feature_count(given: str | int | float | None, p: int) -> int | None:
    if given in (None, "all", "auto"):
        return None
    if isinstance(given, str):
        if given not in ("sqrt", "log2", "onethird"):
            raise ValueError(f"max_features has to be sqrt, log2, onethird, all or a number, not {given!r}")
        return max(1, int({"sqrt": np.sqrt(p), "log2": np.log2(p), "onethird": np.ceil(p / 3)}[given]))
    most = int(given) if isinstance(given, int) else int(given * p)
    if not 0 < most <= p:
        raise ValueError(f"max_features has to pick between 1 and {p} features")
    return most


TREE_LIMITS = {"max_depth", "min_samples_split", "min_samples_leaf", "max_leaf_nodes", "min_impurity_decrease", "max_features", "max_bins"}


def _limits(df: DataFrame, features: list[str], params: dict, **defaults) -> T.Limits:
    given = {**defaults, **{k: v for k, v in params.items() if v is not None}}
    leaves = given.get("max_leaf_nodes")
    if leaves is not None and leaves < 2:
        raise ValueError("max_leaf_nodes has to be at least 2")
    return T.Limits(
        max_depth=given.get("max_depth"),
        min_samples_split=_rows_of(given.get("min_samples_split"), 2, df.count),
        min_samples_leaf=_rows_of(given.get("min_samples_leaf"), 1, df.count),
        max_leaf_nodes=leaves,
        min_impurity_decrease=float(given.get("min_impurity_decrease", 0.0)),
        l2=float(given.get("l2_regularization", 0.0)),
        max_features=_feature_count(given.get("max_features"), len(features)),
    )


def _tree(df: DataFrame, target: str, features: list[str], params: dict) -> TreeModel:
    """One regression tree, grown best-first; depth at most 5 unless given."""
    _known_only(params, TREE_LIMITS)
    limits = _limits(df, features, params, max_depth=5)
    seed = int(params.get("random_state") or 42)
    return TreeModel(list(features), T.fit_trees(df, target, features, limits, seed=seed, max_bins=int(params.get("max_bins") or T.MAX_BINS)))


def _forest(df: DataFrame, target: str, features: list[str], params: dict) -> TreeModel:
    """Trees over resampled rows, averaged; all of them share the passes over the rows."""
    _known_only(params, TREE_LIMITS | {"n_estimators", "bootstrap", "max_samples"})
    limits = _limits(df, features, params, max_depth=5)
    return TreeModel(
        list(features),
        T.fit_trees(
            df, target, features, limits,
            trees=int(params.get("n_estimators") or 100), bootstrap=params.get("bootstrap") is not False, share=float(params.get("max_samples") or 1.0),
            seed=int(params.get("random_state") or 42), max_bins=int(params.get("max_bins") or T.MAX_BINS),
        ),
    )


def _hist_boosting(df: DataFrame, target: str, features: list[str], params: dict) -> TreeModel:
    """Boosting over histograms; rows with missing features are learned from and scored.

    `early_stopping` "auto" holds rows out above 10,000 rows.
    """
    known = {"learning_rate", "max_iter", "n_estimators", "l2_regularization", "early_stopping", "validation_fraction", "n_iter_no_change", "tol", "subsample"}
    _known_only(params, TREE_LIMITS | known)
    early = params.get("early_stopping", "auto")
    if early in (None, "auto"):
        early = df.count() > 10_000
    stopping = T.Stopping(
        int(params.get("n_iter_no_change") or 10) if early else None, float(params.get("validation_fraction") or 0.1), float(params.get("tol", 1e-7))
    )
    limits = _limits(df, features, params, max_leaf_nodes=31, min_samples_leaf=20)
    rounds, rate = int(params.get("max_iter") or params.get("n_estimators") or 100), float(params.get("learning_rate") or 0.1)
    return TreeModel(
        list(features),
        T.fit_boosting(
            df, target, features, limits, rounds, rate, float(params.get("subsample") or 1.0), stopping,
            int(params.get("random_state") or 42), int(params.get("max_bins") or T.MAX_BINS),
        ),
    )


MISSING_FEATURES = {"hist_gradient_boosting_regressor"}  # models that learn from rows with missing features

MODELS: dict[str, Callable[[DataFrame, str, list[str], dict], Regressor]] = {
    "linear_regression": _linear("ols"),
    "ridge": _linear("ridge"),
    "lasso": _linear("lasso"),
    "elastic_net": _linear("elastic_net"),
    "lars": _angles(False),
    "lasso_lars": _angles(True),
    "bayesian_ridge": _bayesian_ridge,
    "orthogonal_matching_pursuit": _matching_pursuit,
    "decision_tree_regressor": _tree,
    "random_forest_regressor": _forest,
    "gradient_boosting_regressor": _mllib(GBTRegressor, BOOST, maxIter=100, maxDepth=3, stepSize=0.1, seed=42),
    "hist_gradient_boosting_regressor": _hist_boosting,
    "huber_regressor": _huber,
}


def register_model(name: str, fit: Callable[[DataFrame, str, list[str], dict], Regressor]) -> None:
    """Make `fit(train, target, features, params) -> Regressor` available as model `name`."""
    MODELS[name] = fit


# the fit flow -------------------------------------------------------------------------------


@dataclass
class Fit:
    """A fitted model with its scores."""

    model_type: str
    target: str
    features: list[str]
    model: Regressor
    metrics: dict[str, float]
    diagnostics: dict[str, float]
    params: dict = field(default_factory=dict)

    def _frame(self, spark: SparkSession, values: dict[str, float], first: str) -> DataFrame:
        rows = [(k, None if v is None else float(v)) for k, v in values.items()]
        return spark.createDataFrame(rows, f"{first} string, value double")

    def metrics_frame(self, spark: SparkSession) -> DataFrame:
        return self._frame(spark, self.metrics, "metric")

    def coefficients_frame(self, spark: SparkSession) -> DataFrame:
        return self._frame(spark, self.model.coefficients(), "term")

    def diagnostics_frame(self, spark: SparkSession) -> DataFrame:
        return self._frame(spark, self.diagnostics, "metric")


def _values(frame: DataFrame) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in frame.collect()}  # a handful of scores


def fit(
    df: DataFrame,
    key: str,
    model: str,
    target: str,
    features: list[str],
    params: dict | None = None,
    split_spec: dict | None = None,
) -> Fit:
    """Complete rows, split by key, fit, scores on both parts, diagnostics on the test part.

    Models of MISSING_FEATURES keep rows that miss features, as long as the target is there.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model type: {model}")
    if not target:
        raise ValueError("a target column is required")
    require_columns(df, [target])
    require_columns(df, features)
    spec = {"type": "random", "test_size": 0.2, "random_state": 42, **(split_spec or {})}
    cols = list(dict.fromkeys([target, *features]))
    whole = complete_cases(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([key, *cols])]), [target] if model in MISSING_FEATURES else cols)
    flag = split_flag(F.col(key), spec["test_size"], spec["random_state"]) if spec["type"] == "random" else F.lit(None).cast("boolean")
    # fits and scores pass over the rows several times: keep just the numbers they need, spilling to disk
    rows = whole.select(*[F.col(f"`{c}`") for c in cols], flag.alias("_is_test")).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [rows]
    try:
        if rows.isEmpty():
            raise ValueError(f"no rows left after dropping missing values in {cols}")
        train = rows.filter(F.coalesce(~F.col("_is_test"), F.lit(True))).drop("_is_test")
        test = rows.filter(F.coalesce("_is_test", F.lit(True))).drop("_is_test")
        fitted = MODELS[model](train, target, features, params or {})
        on_train, on_test = (
            fitted.predict(part).select(F.col(f"`{target}`"), PREDICTION).persist(StorageLevel.MEMORY_AND_DISK) for part in (train, test)
        )
        kept += [on_train, on_test]
        metrics = _values(regression_metrics(on_train, target, PREDICTION))
        scores = _values(regression_metrics(on_test, target, PREDICTION, ["r2", "mae", "rmse"]))
        metrics.update({f"test_{k}": v for k, v in scores.items()})
        diagnostics = {**_values(residual_stats(on_test, target, PREDICTION)), **fitted.details()}
    finally:
        for part in kept:
            part.unpersist()
    return Fit(model, target, list(features), fitted, metrics, diagnostics, params or {})


def predict(fit_or_model: Fit | Regressor, df: DataFrame, n: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """All rows with `_prediction` (NULL where a feature is missing), or the first n."""
    model = fit_or_model.model if isinstance(fit_or_model, Fit) else fit_or_model
    result = model.predict(df)
    if n is None:
        return result
    return (result.orderBy(*order_by) if order_by else result).limit(n)
