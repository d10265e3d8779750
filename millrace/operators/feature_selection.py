"""Selection of feature columns by variance or by a score against the target."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from .. import errors
from ..dataset import Dataset, check_width, col
from ..plans.aggregates import class_moments
from .base import Transformer, TransformerEstimator


def _select(data: Dataset, keep: list[int]) -> Dataset:
    names = [data.features[j] for j in keep]
    others = [c for c in data.df.columns if c not in data.features]
    return data.with_df(data.df.select(*map(col, others), *map(col, names)), tuple(names))


@dataclass(frozen=True)
class VarianceThreshold(TransformerEstimator):
    """Keep the columns whose population variance is above the threshold."""

    threshold: float = 0.0

    def __post_init__(self):
        if not math.isfinite(self.threshold) or self.threshold < 0:
            raise errors.InvalidVarianceThreshold(value=self.threshold)

    def fit(self, data: Dataset) -> "FittedSelector":
        data.validate()
        row = data.df.agg(*[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(data.xs)]).first()
        return FittedSelector(data.features, tuple(row), tuple(j for j, v in enumerate(row) if v > self.threshold))


@dataclass(frozen=True)
class FittedSelector(Transformer):
    features: tuple[str, ...]
    scores: tuple[float, ...]
    selected: tuple[int, ...]

    @property
    def variances(self) -> tuple[float, ...]:
        return self.scores

    def transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.features))
        return _select(data, list(self.selected))


def _ratio(a: float, b: float) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.float64(a) / np.float64(b))


def f_classif(data: Dataset) -> list[float]:
    """One-way ANOVA F of each feature against the target's classes; no spread within classes gives inf or NaN."""
    n = data.validate()
    groups = class_moments(data.df, data.y, data.xs)
    if len(groups) < 2:
        raise errors.InsufficientClasses(required=2, actual=len(groups))
    counts = np.array([g[0] for g in groups.values()], float)
    means = np.array([g[1] for g in groups.values()])
    within = (counts[:, None] * np.array([np.diag(g[2]) for g in groups.values()])).sum(0)
    overall = (counts[:, None] * means).sum(0) / n
    between = (counts[:, None] * (means - overall) ** 2).sum(0)
    return [_ratio(_ratio(b, len(groups) - 1), _ratio(w, n - len(groups))) for b, w in zip(between, within)]


def f_regression(data: Dataset) -> list[float]:
    """F of each feature's correlation with a numeric target; a constant column gives NaN, a perfect one inf."""
    n = data.validate()
    y = data.y.cast("double")
    parts = [F.var_pop(y).alias("vy")]
    for i, x in enumerate(data.xs):
        parts += [F.var_pop(x).alias(f"v{i}"), F.covar_pop(x, y).alias(f"c{i}")]
    row = data.df.agg(*parts).first()
    out = []
    for i in range(data.n_features):
        r2 = _ratio(row[f"c{i}"] ** 2, row[f"v{i}"] * row["vy"])
        out.append(_ratio(r2 * (n - 2), 1 - r2) if r2 != 1 else math.inf)
    return out


@dataclass(frozen=True)
class SelectKBest:
    """Keep the k columns of the highest scores: NaN counts lowest, of equal scores the first column wins."""

    k: int

    def fit(self, data: Dataset, scorer: Callable[[Dataset], list[float]]) -> FittedSelector:
        scores = scorer(data)
        check_width(scores, data.n_features)
        order = sorted(range(len(scores)), key=lambda j: (math.isnan(scores[j]), -scores[j] if not math.isnan(scores[j]) else 0.0, j))
        return FittedSelector(data.features, tuple(scores), tuple(sorted(order[: self.k])))
