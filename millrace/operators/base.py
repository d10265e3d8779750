"""What operators have in common: estimators that fit, transformers, predictors, and checks of parameters."""

from __future__ import annotations

import math
import re
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..dataset import Dataset, check_width
from ..functions.expressions import finite


class Estimator(ABC):
    """Something that can be fitted to a dataset.  Subclasses work in cross-validation and searches."""

    @abstractmethod
    def fit(self, data: Dataset):
        """A fitted model, which does not change any more."""


class TransformerEstimator(ABC):
    """A step of a pipeline; it learns from features alone."""

    @abstractmethod
    def fit(self, data: Dataset) -> "Transformer": ...


class Transformer(ABC):
    """A fitted step: new feature columns from old ones, as a projection."""

    @abstractmethod
    def transform(self, data: Dataset) -> Dataset: ...


class Predictor(ABC):
    """A fitted model whose predictions are column expressions, on batches and streams alike."""

    features: tuple[str, ...]

    @abstractmethod
    def prediction(self, xs: list[Column]) -> Column: ...

    def inputs(self, data: Dataset | DataFrame) -> tuple[DataFrame, list[Column]]:
        df = data.df if isinstance(data, Dataset) else data
        names = data.features if isinstance(data, Dataset) else self.features
        check_width(names, len(self.features))
        return df, [F.col(f"`{c}`").cast("double") for c in names]

    def predict(self, data: Dataset | DataFrame, output: str = "prediction", checked: bool = False) -> DataFrame:
        """data with a column of predictions.  checked=True fails for a row whose prediction is not finite, when it is read."""
        df, xs = self.inputs(data)
        made = self.prediction(xs)
        if checked:
            made = F.when(finite(made), made).otherwise(F.raise_error(F.lit("NonFinitePrediction")).cast("double"))
        return df.withColumn(output, made)


class Classifier(Predictor):
    """Adds probabilities, an array in the order of the classes."""

    classes: list

    @abstractmethod
    def probability(self, xs: list[Column]) -> Column: ...

    def prediction(self, xs: list[Column]) -> Column:
        from ..functions.expressions import argmax, pick

        return pick(self.classes, argmax(self.probability(xs)))

    def predict_probabilities(self, data: Dataset | DataFrame, output: str = "probability") -> DataFrame:
        df, xs = self.inputs(data)
        return df.withColumn(output, self.probability(xs))


def check_regularization(value: float) -> None:
    if not math.isfinite(value) or value < 0:
        raise errors.InvalidRegularization(value=value)


def check_iterations(value: int) -> None:
    if value < 1:
        raise errors.InvalidMaxIterations(value=value)


def check_tolerance(value: float) -> None:
    if not math.isfinite(value) or value <= 0:
        raise errors.InvalidTolerance(value=value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where they are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/millrace"
