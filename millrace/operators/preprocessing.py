"""Scalers, encoders, imputer and polynomial expansion: fitted by aggregates, applied as projections."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..dataset import Dataset, check_width, col
from ..functions.expressions import finite, number
from ..plans.aggregates import medians
from .base import Transformer, TransformerEstimator


def _project(data: Dataset, columns: list[Column], names: list[str] | None = None) -> Dataset:
    """data with its features replaced by columns, under their own names or new ones; other columns stay."""
    names = list(data.features) if names is None else names
    others = [c for c in data.df.columns if c not in data.features and c not in names]
    return data.with_df(data.df.select(*map(col, others), *[c.alias(n) for c, n in zip(columns, names)]), tuple(names))


# --- scalers ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class StandardScaler(TransformerEstimator):
    """Centre by the mean and scale by the population deviation, each if wanted; a constant column is not scaled."""

    with_mean: bool = True
    with_std: bool = True

    def fit(self, data: Dataset) -> "FittedStandardScaler":
        data.validate()
        row = data.df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(data.xs)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(data.xs)]).first()
        p = data.n_features
        return FittedStandardScaler(
            data.features,
            tuple(row[f"m{i}"] if self.with_mean else 0.0 for i in range(p)),
            tuple((row[f"s{i}"] or 1.0) if self.with_std else 1.0 for i in range(p)),
        )


@dataclass(frozen=True)
class FittedStandardScaler(Transformer):
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.mean))
        return _project(data, [(x - number(m)) / number(s) for x, m, s in zip(data.xs, self.mean, self.scale)])

    def inverse_transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.mean))
        return _project(data, [x * number(s) + number(m) for x, m, s in zip(data.xs, self.mean, self.scale)])


@dataclass(frozen=True)
class MinMaxScaler(TransformerEstimator):
    """Map each column's range to low..high; a constant column goes to low.  Values beyond are not clipped."""

    low: float = 0.0
    high: float = 1.0

    def __post_init__(self):
        if not (math.isfinite(self.low) and math.isfinite(self.high) and self.low < self.high):
            raise errors.InvalidFeatureRange(low=self.low, high=self.high)

    def fit(self, data: Dataset) -> "FittedMinMaxScaler":
        data.validate()
        row = data.df.agg(*[F.min(x).alias(f"a{i}") for i, x in enumerate(data.xs)], *[F.max(x).alias(f"b{i}") for i, x in enumerate(data.xs)]).first()
        p = data.n_features
        return FittedMinMaxScaler(data.features, tuple(row[f"a{i}"] for i in range(p)), tuple(row[f"b{i}"] for i in range(p)), (self.low, self.high))


@dataclass(frozen=True)
class FittedMinMaxScaler(Transformer):
    features: tuple[str, ...]
    data_min: tuple[float, ...]
    data_max: tuple[float, ...]
    feature_range: tuple[float, float]

    def _affine(self) -> list[tuple[float, float]]:
        low, high = self.feature_range
        out = []
        for a, b in zip(self.data_min, self.data_max):
            scale = (high - low) / ((b - a) or 1.0)
            out.append((scale, low - a * scale))
        return out

    def transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.data_min))
        return _project(data, [x * number(s) + number(o) for x, (s, o) in zip(data.xs, self._affine())])

    def inverse_transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.data_min))
        return _project(data, [(x - number(o)) / number(s) for x, (s, o) in zip(data.xs, self._affine())])


# --- encoders --------------------------------------------------------------------------------------


def _sorted_classes(df: DataFrame, label: str) -> list:
    """Distinct labels in order; as many rows as classes come to the driver."""
    found = [r[0] for r in df.select(col(label).alias("c")).where("c is not null").distinct().orderBy("c").collect()]
    if not found:
        raise errors.EmptyTargets()
    return found


def _place(label: Column, classes: list) -> Column:
    """Rank of a label among the classes from 0; null if it is none of them."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(at > 0, (at - 1).cast("int"))


def _or_unknown(made: Column, known: Column, what: str) -> Column:
    return F.when(known, made).otherwise(F.raise_error(F.lit(what)))


@dataclass(frozen=True)
class LabelEncoder:
    """Labels to their ranks among the sorted distinct labels."""

    def fit(self, df: DataFrame, label: str) -> "FittedLabelEncoder":
        return FittedLabelEncoder(_sorted_classes(df, label))


@dataclass(frozen=True)
class FittedLabelEncoder:
    classes: list

    def transform(self, df: DataFrame, label: str, output: str = "code") -> DataFrame:
        """df with the codes; a label that was not there when fitting is an error when it is read."""
        code = _place(col(label), self.classes)
        return df.withColumn(output, _or_unknown(code, code.isNotNull(), "UnknownLabel").cast("int"))

    def inverse_transform(self, df: DataFrame, code: str, output: str = "label") -> DataFrame:
        ok = (col(code) >= 0) & (col(code) < len(self.classes))
        label = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.when(ok, col(code).cast("int") + 1).otherwise(1))
        return df.withColumn(output, F.when(ok, label).otherwise(F.raise_error(F.lit("InvalidClassIndex"))))


@dataclass(frozen=True)
class OneHotEncoder:
    """One column of 0 and 1 for each sorted class, without the first one if drop_first."""

    drop_first: bool = False

    def fit(self, df: DataFrame, label: str) -> "FittedOneHotEncoder":
        return FittedOneHotEncoder(_sorted_classes(df, label), self.drop_first)


@dataclass(frozen=True)
class FittedOneHotEncoder:
    classes: list
    drop_first: bool

    @property
    def output_classes(self) -> list:
        return self.classes[1:] if self.drop_first else self.classes

    def transform(self, df: DataFrame, label: str, prefix: str = "is") -> DataFrame:
        known = _place(col(label), self.classes).isNotNull()
        made = [_or_unknown(F.when(col(label) == F.lit(c), 1.0).otherwise(0.0), known, "UnknownLabel").cast("double").alias(f"{prefix}_{c}") for c in self.output_classes]
        return df.select("*", *made)


# --- imputer ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SimpleImputer(TransformerEstimator):
    """Fill NaN and null by the column's mean, median (exact, the midpoint of an even count) or a constant."""

    strategy: str = "mean"
    value: float | None = None

    def __post_init__(self):
        if self.strategy not in ("mean", "median", "constant"):
            raise ValueError(self.strategy)
        if self.strategy == "constant" and (self.value is None or not math.isfinite(self.value)):
            raise errors.InvalidImputationConstant(value=self.value)

    @staticmethod
    def mean() -> "SimpleImputer":
        return SimpleImputer("mean")

    @staticmethod
    def median() -> "SimpleImputer":
        return SimpleImputer("median")

    @staticmethod
    def constant(value: float) -> "SimpleImputer":
        return SimpleImputer("constant", value)

    def fit(self, data: Dataset) -> "FittedSimpleImputer":
        data.validate(allow_nan=True)
        if self.strategy == "constant":
            return FittedSimpleImputer(data.features, (float(self.value),) * data.n_features)
        present = [F.when(~F.isnan(x), x) for x in data.xs]
        row = medians(data.df, present) if self.strategy == "median" else data.df.agg(*[F.avg(x) for x in present]).first()
        for i, c in enumerate(data.features):
            if row[i] is None:
                raise errors.AllValuesMissing(column=c)
            if not math.isfinite(row[i]):
                raise errors.NonFiniteImputationStatistic(column=c)
        return FittedSimpleImputer(data.features, tuple(row))


@dataclass(frozen=True)
class FittedSimpleImputer(Transformer):
    features: tuple[str, ...]
    fill_values: tuple[float, ...]

    def transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.fill_values))
        return _project(data, [F.coalesce(F.nanvl(x, number(v)), number(v)) for x, v in zip(data.xs, self.fill_values)])


# --- polynomial expansion --------------------------------------------------------------------------


@dataclass(frozen=True)
class PolynomialFeatures(TransformerEstimator):
    """Products of features by degree and, within a degree, in order of the columns' places."""

    degree: int = 2
    include_bias: bool = True
    interaction_only: bool = False

    def __post_init__(self):
        if self.degree < 1:
            raise errors.InvalidDegree(value=self.degree)

    def fit(self, data: Dataset) -> "FittedPolynomialFeatures":
        data.validate()
        how = combinations if self.interaction_only else combinations_with_replacement
        terms = [()] if self.include_bias else []
        for d in range(1, self.degree + 1):
            terms += how(range(data.n_features), d)
        return FittedPolynomialFeatures(data.features, tuple(terms))


@dataclass(frozen=True)
class FittedPolynomialFeatures(Transformer):
    features: tuple[str, ...]
    combinations: tuple[tuple[int, ...], ...] = field(default=())

    @property
    def output_names(self) -> list[str]:
        return ["_".join(self.features[j] for j in t) or "one" for t in self.combinations]

    def transform(self, data: Dataset) -> Dataset:
        check_width(data.features, len(self.features))
        made = []
        for t in self.combinations:
            product = number(1.0)
            for k, j in enumerate(t):
                product = data.xs[j] if k == 0 else product * data.xs[j]
            made.append(F.when(finite(product), product).otherwise(F.raise_error(F.lit("NonFinitePrediction")).cast("double")) if len(t) > 1 else product)
        return _project(data, made, [f"poly_{n}" for n in self.output_names])
