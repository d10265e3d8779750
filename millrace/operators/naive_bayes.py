"""Naive Bayes: fitted by one aggregate per class, applied as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import errors
from ..dataset import Dataset
from ..functions.expressions import LOG_2PI, dot, number, softmax, total
from ..plans.aggregates import class_moments
from .base import Classifier, Estimator

#: The least variance of a feature within a class.
VARIANCE_FLOOR = 1e-12


@dataclass(frozen=True)
class NaiveBayesModel(Classifier):
    """Common part: probabilities from joint log likelihoods."""

    features: tuple[str, ...]
    classes: list
    log_prior: tuple[float, ...]

    def joint(self, xs: list[Column]) -> list[Column]:
        raise NotImplementedError

    def probability(self, xs: list[Column]) -> Column:
        return softmax(F.array(*self.joint(xs)))


@dataclass(frozen=True)
class GaussianModel(NaiveBayesModel):
    means: tuple[tuple[float, ...], ...] = ()
    variances: tuple[tuple[float, ...], ...] = ()

    def joint(self, xs: list[Column]) -> list[Column]:
        out = []
        for prior, mean, var in zip(self.log_prior, self.means, self.variances):
            constant = prior - 0.5 * sum(LOG_2PI + math.log(v) for v in var)
            out.append(number(constant) - total([(x - number(m)) * (x - number(m)) / number(2 * v) for x, m, v in zip(xs, mean, var)]))
        return out


@dataclass(frozen=True)
class GaussianNaiveBayes(Estimator):
    """Normal densities; a share of the largest variance of a feature is added to all variances."""

    var_smoothing: float = 1e-9

    def __post_init__(self):
        if not math.isfinite(self.var_smoothing) or self.var_smoothing < 0:
            raise errors.InvalidVarianceSmoothing(value=self.var_smoothing)

    def fit(self, data: Dataset) -> GaussianModel:
        n = data.validate()
        groups = class_moments(data.df, data.y, data.xs)
        row = data.df.agg(*[F.var_pop(x) for x in data.xs]).first()
        extra = self.var_smoothing * max(row)
        return GaussianModel(
            data.features,
            list(groups),
            tuple(math.log(g[0] / n) for g in groups.values()),
            tuple(tuple(g[1].tolist()) for g in groups.values()),
            tuple(tuple(np.maximum(np.diag(g[2]) + extra, VARIANCE_FLOOR).tolist()) for g in groups.values()),
        )


def _check_alpha(alpha: float) -> None:
    if not math.isfinite(alpha) or alpha < 0:
        raise errors.InvalidAlpha(value=alpha)


def _log(x: float) -> float:
    return math.log(x) if x > 0 else -math.inf


def _prior(counts: list[int], fit_prior: bool) -> tuple[float, ...]:
    return tuple(math.log(c / sum(counts)) if fit_prior else -math.log(len(counts)) for c in counts)


@dataclass(frozen=True)
class MultinomialModel(NaiveBayesModel):
    feature_log_probabilities: tuple[tuple[float, ...], ...] = ()

    def joint(self, xs: list[Column]) -> list[Column]:
        checked = [F.when(x >= 0, x).otherwise(F.raise_error(F.lit("NegativeFeature")).cast("double")) for x in xs]
        return [dot(checked, w, b) for b, w in zip(self.log_prior, self.feature_log_probabilities)]


@dataclass(frozen=True)
class MultinomialNaiveBayes(Estimator):
    """Smoothed shares of each feature in a class's total; features must not be negative."""

    alpha: float = 1.0
    fit_prior: bool = True

    def __post_init__(self):
        _check_alpha(self.alpha)

    def fit(self, data: Dataset) -> MultinomialModel:
        data.validate(non_negative=True)
        rows = data.df.groupBy(data.y.alias("label")).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(data.xs)]).orderBy("label").collect()
        p = data.n_features
        shares = []
        for r in rows:
            whole = sum(r[f"s{i}"] for i in range(p)) + self.alpha * p
            shares.append(tuple(_log(r[f"s{i}"] + self.alpha) - _log(whole) for i in range(p)))
        return MultinomialModel(data.features, [r["label"] for r in rows], _prior([r["n"] for r in rows], self.fit_prior), tuple(shares))


@dataclass(frozen=True)
class BernoulliModel(NaiveBayesModel):
    present: tuple[tuple[float, ...], ...] = ()
    absent: tuple[tuple[float, ...], ...] = ()
    binarize: float | None = 0.0

    def joint(self, xs: list[Column]) -> list[Column]:
        bits = xs if self.binarize is None else [F.when(x > number(self.binarize), 1.0).otherwise(0.0) for x in xs]
        return [dot(bits, [a - b for a, b in zip(on, off)], prior + sum(off)) for prior, on, off in zip(self.log_prior, self.present, self.absent)]


@dataclass(frozen=True)
class BernoulliNaiveBayes(Estimator):
    """Smoothed shares of rows in which a feature is on; features above `binarize` are (None: they are 0 or 1 as they are)."""

    alpha: float = 1.0
    fit_prior: bool = True
    binarize: float | None = 0.0

    def __post_init__(self):
        _check_alpha(self.alpha)

    def fit(self, data: Dataset) -> BernoulliModel:
        data.validate()
        bits = data.xs if self.binarize is None else [F.when(x > number(self.binarize), 1.0).otherwise(0.0) for x in data.xs]
        rows = data.df.groupBy(data.y.alias("label")).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(bits)]).orderBy("label").collect()
        on, off = [], []
        for r in rows:
            shares = [(r[f"s{i}"] + self.alpha) / (r["n"] + 2 * self.alpha) for i in range(data.n_features)]
            on.append(tuple(_log(s) for s in shares))
            off.append(tuple(_log(1 - s) for s in shares))
        return BernoulliModel(data.features, [r["label"] for r in rows], _prior([r["n"] for r in rows], self.fit_prior), tuple(on), tuple(off), self.binarize)
