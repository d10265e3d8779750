"""Fitted models on streams: predictions and transforms are projections, so they apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators.base import Predictor, Transformer


def score_stream(stream: DataFrame, model: Predictor, steps: tuple[Transformer, ...] = (), features: tuple[str, ...] | None = None, output: str = "prediction") -> DataFrame:
    """A stream with a column of predictions, after the given steps."""
    data = Dataset(stream, features or model.features)
    for step in steps:
        data = step.transform(data)
    return model.predict(data, output)


def windowed_error(scored: DataFrame, time: str, actual: str, predicted: str = "prediction", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows, mean squared and mean absolute error of a scored stream by time window; rows later than `late` are dropped."""
    d = F.col(actual).cast("double") - F.col(predicted)
    return (
        scored.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"))
        .agg(F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))
        .select(F.col("w.start").alias("window_start"), "n", "mse", "mae")
    )
