"""Column expressions that fitted models are made of."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(parts: Sequence[Column]) -> Column:
    """Sum of columns, added as a balanced tree so that the expression stays shallow."""
    parts = list(parts)
    if not parts:
        return F.lit(0.0)
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def number(x: float) -> Column:
    return F.lit(float(x))


def dot(xs: Sequence[Column], weights: Sequence[float], bias: float = 0.0) -> Column:
    return total([x * number(w) for x, w in zip(xs, weights)]) + number(bias)


def sigmoid(s: Column) -> Column:
    """1 / (1 + e^-s) without overflow."""
    return F.when(s >= 0, 1 / (1 + F.exp(-s))).otherwise(F.exp(s) / (1 + F.exp(s)))


def log_sigmoid(s: Column) -> Column:
    return F.when(s >= 0, -F.log1p(F.exp(-s))).otherwise(s - F.log1p(F.exp(s)))


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(scores: Column) -> Column:
    """Probabilities from an array of log weights, shifted by their maximum."""

    def shifted(s: Column) -> Column:
        return let(F.transform(s, lambda v: F.exp(v - F.array_max(s))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))

    return let(scores, shifted)


def argmax(values: Column) -> Column:
    """Place of an array's largest value, from 1; the first of equal ones."""
    return let(values, lambda v: F.array_position(v, F.array_max(v)))


def pick(classes: Sequence, place: Column) -> Column:
    """The class at a place, from 1."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), place.cast("int"))


def squared_distance(xs: Sequence[Column], centre: Sequence[float]) -> Column:
    return total([(x - number(c)) * (x - number(c)) for x, c in zip(xs, centre)])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


LOG_2PI = math.log(2 * math.pi)
