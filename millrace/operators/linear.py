"""Linear models: least squares, ridge, lasso, elastic net, logistic, and linear discriminants."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..dataset import Dataset
from ..functions import linalg
from ..functions.expressions import argmax, dot, log_sigmoid, number, pick, sigmoid, softmax
from ..plans.aggregates import class_moments, moments, sum_over, tall_qr
from .base import Classifier, Estimator, Predictor, check_iterations, check_regularization, check_tolerance


@dataclass(frozen=True)
class ConvergenceReport:
    iterations: int
    max_parameter_change: float
    tolerance: float


@dataclass(frozen=True)
class LinearModel(Predictor):
    """A fitted linear predictor."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    report: ConvergenceReport | None = None

    def prediction(self, xs: list[Column]) -> Column:
        return dot(xs, self.coefficients, self.intercept)


def _centred(data: Dataset, fit_intercept: bool) -> tuple[int, list[Column], Column, np.ndarray, float]:
    """Rows, columns and target less their means (if there is an intercept), and the means."""
    n = data.validate(finite_target=True)
    xs, y = data.xs, data.y.cast("double")
    if not fit_intercept:
        return n, xs, y, np.zeros(len(xs)), 0.0
    row = data.df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], F.avg(y).alias("my")).first()
    mean = np.array(list(row)[:-1])
    return n, [x - number(m) for x, m in zip(xs, mean)], y - number(row["my"]), mean, row["my"]


def _model(data: Dataset, w: np.ndarray, mean: np.ndarray, y_mean: float, report: ConvergenceReport | None = None) -> LinearModel:
    return LinearModel(data.features, tuple(w.tolist()), float(y_mean - mean @ w), report)


@dataclass(frozen=True)
class LinearRegression(Estimator):
    """Least squares by a QR factor that tasks reduce their rows to; needs full rank and as many rows as parameters."""

    fit_intercept: bool = True

    def fit(self, data: Dataset) -> LinearModel:
        n = data.validate(finite_target=True)
        need = data.n_features + self.fit_intercept
        if n < need:
            raise errors.InsufficientSamples(required=need, actual=n)
        design = [F.lit(1.0)] * self.fit_intercept + data.xs
        r = tall_qr(data.df, [*design, data.y.cast("double")])
        r = np.vstack([r, np.zeros((max(0, need + 1 - len(r)), need + 1))])
        w = linalg.solve_least_squares(r[:, :-1], r[:, -1], n)
        return LinearModel(data.features, tuple(w[self.fit_intercept :].tolist()), float(w[0]) if self.fit_intercept else 0.0)


@dataclass(frozen=True)
class RidgeRegression(Estimator):
    """Least squares plus alpha times the squared length of the coefficients; the intercept is not penalised."""

    alpha: float = 1.0
    fit_intercept: bool = True

    def __post_init__(self):
        check_regularization(self.alpha)

    def fit(self, data: Dataset) -> LinearModel:
        if self.alpha == 0:
            return LinearRegression(self.fit_intercept).fit(data)
        n, xs, y, mean, y_mean = _centred(data, self.fit_intercept)
        r = tall_qr(data.df, [*xs, y])
        return _model(data, linalg.solve_ridge(r[:, :-1], r[:, -1], self.alpha, n), mean, y_mean)


@dataclass(frozen=True)
class ElasticNetRegression(Estimator):
    """Mean squared error / 2 plus alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w'w), by coordinate descent on moments."""

    alpha: float = 1.0
    l1_ratio: float = 0.5
    fit_intercept: bool = True
    max_iterations: int = 1000
    tolerance: float = 1e-4

    def __post_init__(self):
        check_regularization(self.alpha)
        if not 0 <= self.l1_ratio <= 1:
            raise errors.InvalidL1Ratio(value=self.l1_ratio)
        check_iterations(self.max_iterations)
        check_tolerance(self.tolerance)

    def fit(self, data: Dataset) -> LinearModel:
        data.validate(finite_target=True)
        p = data.n_features
        _, mean, cov = moments(data.df, [*data.xs, data.y])
        if not self.fit_intercept:
            cov, mean = cov + np.outer(mean, mean), np.zeros(p + 1)
        w, iterations, moved = linalg.coordinate_descent(cov[:p, :p], cov[:p, p], self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio), self.max_iterations, self.tolerance)
        return _model(data, w, mean[:p], mean[p], ConvergenceReport(iterations, moved, self.tolerance))


def LassoRegression(alpha: float = 1.0, fit_intercept: bool = True, max_iterations: int = 1000, tolerance: float = 1e-4) -> ElasticNetRegression:  # noqa: N802
    """The elastic net with the absolute penalty alone."""
    return ElasticNetRegression(alpha, 1.0, fit_intercept, max_iterations, tolerance)


# --- logistic --------------------------------------------------------------------------------------

#: The least weight of a row in a Newton step.
WEIGHT_FLOOR = 1e-12


def _newton(data: Dataset, positives: list[Column], alpha: float, fit_intercept: bool, max_iterations: int, tolerance: float) -> list[tuple[np.ndarray, ConvergenceReport]]:
    """One penalised logistic fit for each column of positives (0 or 1), all in the same passes over the rows.

    Each pass sums the weighted cross-products of the fits that have not converged.
    """
    p, k = data.n_features, len(positives)
    q = p + fit_intercept
    frame = data.df.select(*[x.alias(f"x{i}") for i, x in enumerate(data.xs)], *[c.cast("double").alias(f"p{i}") for i, c in enumerate(positives)]).persist()
    try:
        columns = [F.col(c) for c in frame.columns]
        shares = frame.agg(*[F.avg(f"p{i}") for i in range(k)]).first()
        theta = np.zeros((k, q))
        if fit_intercept:
            theta[:, 0] = [math.log(s / (1 - s)) for s in shares]
        done: list[ConvergenceReport | None] = [None] * k
        penalty = np.full(q, alpha)
        if fit_intercept:
            penalty[0] = 0.0
        for it in range(1, max_iterations + 1):
            active = [j for j in range(k) if done[j] is None]
            now = theta[active].copy()

            def kernel(m: np.ndarray) -> np.ndarray:
                x = np.column_stack([np.ones(len(m)), m[:, :p]]) if fit_intercept else m[:, :p]
                out = []
                for t, j in zip(now, active):
                    s = x @ t
                    e = np.exp(-np.abs(s))
                    mu = np.where(s >= 0, 1 / (1 + e), e / (1 + e))
                    w = np.maximum(mu * (1 - mu), WEIGHT_FLOOR)
                    out += [((x * w[:, None]).T @ x).ravel(), x.T @ (w * s + m[:, p + j] - mu)]
                return np.concatenate(out)

            sums = sum_over(frame, columns, kernel, len(active) * (q * q + q))
            if not np.isfinite(sums).all():
                raise errors.NonFinitePrediction(row=None)
            for a, j in enumerate(active):
                part = sums[a * (q * q + q) : (a + 1) * (q * q + q)]
                new = linalg.solve_symmetric(part[: q * q].reshape(q, q) + np.diag(penalty), part[q * q :])
                moved = float(np.abs(new - theta[j]).max())
                theta[j] = new
                if moved <= tolerance * max(1.0, float(np.abs(new).max())):
                    done[j] = ConvergenceReport(it, moved, tolerance)
            if None not in done:
                return list(zip(theta, done))
        raise errors.OptimizationDidNotConverge(iterations=max_iterations)
    finally:
        frame.unpersist()


@dataclass(frozen=True)
class _Logistic(Estimator):
    alpha: float = 1.0
    fit_intercept: bool = True
    max_iterations: int = 100
    tolerance: float = 1e-10

    def __post_init__(self):
        check_regularization(self.alpha)
        check_iterations(self.max_iterations)
        check_tolerance(self.tolerance)

    def _solve(self, data: Dataset, classes: list) -> list[tuple[np.ndarray, float, ConvergenceReport]]:
        made = _newton(data, [(data.y == F.lit(c)).cast("double") for c in classes], self.alpha, self.fit_intercept, self.max_iterations, self.tolerance)
        return [(t[self.fit_intercept :], float(t[0]) if self.fit_intercept else 0.0, r) for t, r in made]


@dataclass(frozen=True)
class LogisticRegression(_Logistic):
    """Two classes, the second of the sorted ones positive: sum of log losses plus alpha / 2 times the squared coefficients."""

    def fit(self, data: Dataset) -> "LogisticModel":
        data.validate()
        classes = data.classes()
        if len(classes) != 2:
            raise errors.ExpectedBinaryTargets(classes=len(classes))
        ((w, b, report),) = self._solve(data, classes[1:])
        return LogisticModel(data.features, classes, tuple(w.tolist()), b, report)


@dataclass(frozen=True)
class LogisticModel(Classifier):
    features: tuple[str, ...]
    classes: list
    coefficients: tuple[float, ...]
    intercept: float
    report: ConvergenceReport

    def score(self, xs: list[Column]) -> Column:
        return dot(xs, self.coefficients, self.intercept)

    def probability(self, xs: list[Column]) -> Column:
        p = sigmoid(self.score(xs))
        return F.array(1 - p, p)

    def prediction(self, xs: list[Column]) -> Column:
        return F.when(sigmoid(self.score(xs)) >= 0.5, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))

    def decision_function(self, data: Dataset | DataFrame, output: str = "decision") -> DataFrame:
        df, xs = self.inputs(data)
        return df.withColumn(output, self.score(xs))

    def predict_positive_probabilities(self, data: Dataset | DataFrame, output: str = "probability") -> DataFrame:
        df, xs = self.inputs(data)
        return df.withColumn(output, sigmoid(self.score(xs)))


@dataclass(frozen=True)
class MulticlassLogisticRegression(_Logistic):
    """Three classes or more: one fit for each against the rest; probabilities are the fits' shares, taken in logarithms."""

    def fit(self, data: Dataset) -> "MulticlassLogisticModel":
        data.validate()
        classes = data.classes()
        if len(classes) < 3:
            raise errors.ExpectedMulticlassTargets(classes=len(classes))
        made = self._solve(data, classes)
        return MulticlassLogisticModel(data.features, classes, tuple(tuple(w.tolist()) for w, _, _ in made), tuple(b for _, b, _ in made), tuple(r for _, _, r in made))


@dataclass(frozen=True)
class MulticlassLogisticModel(Classifier):
    features: tuple[str, ...]
    classes: list
    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    convergence_reports: tuple[ConvergenceReport, ...]

    def probability(self, xs: list[Column]) -> Column:
        return softmax(F.array(*[log_sigmoid(dot(xs, w, b)) for w, b in zip(self.coefficients, self.intercepts)]))

    def decision_function(self, data: Dataset | DataFrame, output: str = "decision") -> DataFrame:
        df, xs = self.inputs(data)
        return df.withColumn(output, F.array(*[dot(xs, w, b) for w, b in zip(self.coefficients, self.intercepts)]))


# --- discriminants ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class LinearDiscriminantAnalysis(Estimator):
    """Linear scores from class means and the pooled covariance within classes, divided by the number of rows."""

    def fit(self, data: Dataset) -> "DiscriminantModel":
        n = data.validate()
        groups = class_moments(data.df, data.y, data.xs, covariances=True)
        pooled = sum(g[0] * g[2] for g in groups.values()) / n
        weights, biases = [], []
        for count, mean, _ in groups.values():
            w = linalg.solve_symmetric(pooled, mean)
            weights.append(tuple(w.tolist()))
            biases.append(float(math.log(count / n) - 0.5 * mean @ w))
        return DiscriminantModel(data.features, list(groups), tuple(weights), tuple(biases))


@dataclass(frozen=True)
class DiscriminantModel(Classifier):
    features: tuple[str, ...]
    classes: list
    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def scores(self, xs: list[Column]) -> Column:
        return F.array(*[dot(xs, w, b) for w, b in zip(self.coefficients, self.intercepts)])

    def probability(self, xs: list[Column]) -> Column:
        return softmax(self.scores(xs))

    def prediction(self, xs: list[Column]) -> Column:
        return pick(self.classes, argmax(self.scores(xs)))

    def decision_function(self, data: Dataset | DataFrame, output: str = "decision") -> DataFrame:
        df, xs = self.inputs(data)
        return df.withColumn(output, self.scores(xs))
