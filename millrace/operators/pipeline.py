"""Pipelines: steps fitted in order, each on what the steps before made, and an estimator at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..dataset import Dataset
from .base import Estimator, Transformer, TransformerEstimator


@dataclass(frozen=True)
class Pipeline(TransformerEstimator):
    steps: tuple[TransformerEstimator, ...] = ()

    def then(self, step: TransformerEstimator) -> "Pipeline":
        return Pipeline((*self.steps, step))

    def __len__(self) -> int:
        return len(self.steps)

    def with_estimator(self, estimator: Estimator) -> "PipelineEstimator":
        return PipelineEstimator(self, estimator)

    def fit(self, data: Dataset) -> "FittedPipeline":
        # missing values may reach a first step that fills them
        data.validate(allow_nan=bool(self.steps))
        fitted = []
        for step in self.steps:
            fitted.append(step.fit(data))
            data = fitted[-1].transform(data)
        return FittedPipeline(tuple(fitted))


@dataclass(frozen=True)
class FittedPipeline(Transformer):
    steps: tuple[Transformer, ...]

    def __len__(self) -> int:
        return len(self.steps)

    def transform(self, data: Dataset) -> Dataset:
        for step in self.steps:
            data = step.transform(data)
        return data


@dataclass(frozen=True)
class PipelineEstimator(Estimator):
    pipeline: Pipeline
    estimator: Estimator

    def fit(self, data: Dataset) -> "FittedPipelineEstimator":
        steps = self.pipeline.fit(data)
        return FittedPipelineEstimator(steps, self.estimator.fit(steps.transform(data)))


@dataclass(frozen=True)
class FittedPipelineEstimator:
    steps: FittedPipeline
    model: object

    def predict(self, data: Dataset, output: str = "prediction") -> DataFrame:
        return self.model.predict(self.steps.transform(data), output)

    def predict_probabilities(self, data: Dataset, output: str = "probability") -> DataFrame:
        return self.model.predict_probabilities(self.steps.transform(data), output)
