"""Principal components from one aggregate of second moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


from .. import errors
from ..dataset import Dataset, check_width, col
from ..functions.expressions import dot, number, total
from ..functions.linalg import symmetric_eigen
from ..plans.aggregates import moments
from .base import Transformer, TransformerEstimator


@dataclass(frozen=True)
class PrincipalComponentAnalysis(TransformerEstimator):
    """Directions of the largest variance, divided by n - 1; each has its largest loading positive."""

    n_components: int | None = None

    def __post_init__(self):
        if self.n_components is not None and self.n_components < 1:
            raise errors.InvalidComponentCount(value=self.n_components)

    def fit(self, data: Dataset) -> "FittedPca":
        n = data.validate()
        if n < 2:
            raise errors.InsufficientSamples(required=2, actual=n)
        most = min(data.n_features, n - 1)
        k = self.n_components or most
        if k > most:
            raise errors.TooManyComponents(maximum=most, requested=k)
        _, mean, cov = moments(data.df, data.xs)
        values, vectors = symmetric_eigen(cov * n / (n - 1))
        values = np.maximum(values, 0)
        whole = values.sum()
        return FittedPca(data.features, tuple(mean.tolist()), tuple(tuple(v.tolist()) for v in vectors[:k]), tuple(values[:k].tolist()), tuple((values[:k] / whole if whole > 0 else np.zeros(k)).tolist()))


@dataclass(frozen=True)
class FittedPca(Transformer):
    features: tuple[str, ...]
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained_variance: tuple[float, ...]
    explained_variance_ratio: tuple[float, ...]

    def transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.mean))
        made = [dot([x - number(m) for x, m in zip(data.xs, self.mean)], c).alias(f"pc{i + 1}") for i, c in enumerate(self.components)]
        others = [c for c in data.df.columns if c not in data.features]
        names = tuple(f"pc{i + 1}" for i in range(len(self.components)))
        return data.with_df(data.df.select(*map(col, others), *made), names)

    def inverse_transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.components))
        made = [(total([x * number(c[j]) for x, c in zip(data.xs, self.components)]) + number(m)).alias(f) for j, (f, m) in enumerate(zip(self.features, self.mean))]
        others = [c for c in data.df.columns if c not in data.features]
        return data.with_df(data.df.select(*map(col, others), *made), self.features)


