"""Splits, folds, cross-validation, parameter searches and curves.

Rows are put in order by row_id, or shuffled by the md5 of row_id and a seed: the same order wherever
it is computed, on any number of partitions.  Ranks come from a range-partitioned sort with offsets.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from ..dataset import Dataset, col
from .base import Estimator

MAXIMIZE, MINIMIZE = "maximize", "minimize"


# --- order -----------------------------------------------------------------------------------------


def order_key(data: Dataset, shuffle: bool, seed: int) -> list[Column]:
    """What rows are ordered by: their ids, or a hash of them and the seed."""
    if not shuffle:
        return [col(c) for c in data.row_id]
    return [F.md5(F.concat_ws("-", *[col(c).cast("string") for c in data.row_id], F.lit(str(seed)))), *map(col, data.row_id)]


def ranked(df: DataFrame, order: list[Column], output: str) -> DataFrame:
    """df with each row's place in the order, from 0.

    Rows are sorted in ranges; one count a range is summed up, so no task ranks all rows.
    """
    part, row = f"_{output}_part", f"_{output}_row"
    named = df.withColumns({f"_{output}_{i}": c for i, c in enumerate(order)})
    keys = [f"_{output}_{i}" for i in range(len(order))]
    dealt = named.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = dealt.persist()
    sizes = held.groupBy(part).count()
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(f"{row}_base"))
    return held.join(F.broadcast(bases), part).withColumn(output, F.col(row) + F.col(f"{row}_base")).drop(part, row, f"{row}_base", *keys)


# --- splits ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SplitOptions:
    test_fraction: float = 0.2
    seed: int = 42
    shuffle: bool = True

    def __post_init__(self):
        if not (math.isfinite(self.test_fraction) and 0 < self.test_fraction < 1):
            raise errors.InvalidTestFraction(value=self.test_fraction)


def train_test_split(data: Dataset, options: SplitOptions = SplitOptions()) -> tuple[Dataset, Dataset]:
    """The first rows of the order to train on, and the last ceil(n * fraction) to test on."""
    n = data.n_samples()
    if n < 2:
        raise errors.InsufficientSamples(required=2, actual=n)
    n_test = math.ceil(n * options.test_fraction)
    if n_test >= n:
        raise errors.InsufficientSamples(required=n_test + 1, actual=n)
    df = ranked(data.df, order_key(data, options.shuffle, options.seed), "_place")
    return data.with_df(df.where(F.col("_place") < n - n_test).drop("_place")), data.with_df(df.where(F.col("_place") >= n - n_test).drop("_place"))


@dataclass(frozen=True)
class _Folds:
    n_splits: int = 5
    shuffle: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.n_splits < 2:
            raise errors.InvalidFoldCount(value=self.n_splits)

    def _check(self, n: int) -> None:
        if n < self.n_splits:
            raise errors.InsufficientSamples(required=self.n_splits, actual=n)


@dataclass(frozen=True)
class KFold(_Folds):
    """Test folds are neighbouring stretches of the order; the first n % k have a row more."""

    def split(self, data: Dataset, output: str = "fold") -> DataFrame:
        n = data.n_samples()
        self._check(n)
        size, more = divmod(n, self.n_splits)
        df = ranked(data.df, order_key(data, self.shuffle, self.seed), "_place")
        place, edge = F.col("_place"), more * (size + 1)
        fold = F.when(place < edge, F.floor(place / (size + 1))).otherwise(more + F.floor((place - edge) / size))
        return df.withColumn(output, fold.cast("int")).drop("_place")


@dataclass(frozen=True)
class StratifiedKFold(_Folds):
    """Rows of each class, classes in order, are dealt to the folds in turn; dealing goes on where it stopped."""

    def split(self, data: Dataset, output: str = "fold") -> DataFrame:
        self._check(data.n_samples())
        df = ranked(data.df, [data.y, *order_key(data, self.shuffle, self.seed)], "_place")
        return df.withColumn(output, (F.col("_place") % self.n_splits).cast("int")).drop("_place")


# --- cross-validation ------------------------------------------------------------------------------

Scorer = Callable[[DataFrame, str, str], float]


@dataclass(frozen=True)
class CrossValidationScores:
    scores: tuple[float, ...]

    @property
    def mean(self) -> float:
        return sum(s / len(self.scores) for s in self.scores)

    @property
    def standard_deviation(self) -> float:
        return math.sqrt(sum((s - self.mean) ** 2 / len(self.scores) for s in self.scores))


def _fold_numbers(df: DataFrame, fold: str) -> list[int]:
    rows = df.groupBy(col(fold)).count().orderBy(fold).collect()
    numbers = [r[0] for r in rows]
    if len(numbers) < 2:
        raise errors.InvalidFoldCount(value=len(numbers))
    if None in numbers or numbers != list(range(len(numbers))):
        raise errors.InvalidFoldPartition(fold=next(i for i, v in enumerate([*numbers, None]) if v != i))
    return numbers


def _run(tasks: Sequence[Callable[[], Any]], parallel: int) -> list:
    """Results in order; the first failure in order is raised.  Spark runs the tasks' jobs side by side."""
    if parallel <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(parallel) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def _score(estimator: Estimator, train: Dataset, test: Dataset, scorer: Scorer) -> float:
    return scorer(estimator.fit(train).predict(test, "prediction"), test.target, "prediction")


def cross_validate(estimator: Estimator, data: Dataset, scorer: Scorer, fold: str = "fold", parallel: int = 1) -> CrossValidationScores:
    """One score for each fold: fitted on the other rows, predicted for its own.  data.df has the fold column."""

    def one(k: int) -> float:
        train, test = (data.with_df(data.df.where(c)) for c in (col(fold) != k, col(fold) == k))
        value = _score(estimator, train, test, scorer)
        if not math.isfinite(value):
            raise errors.NonFiniteCrossValidationScore(fold=k)
        return value

    return CrossValidationScores(tuple(_run([lambda k=k: one(k) for k in _fold_numbers(data.df, fold)], parallel)))


def cross_validate_parallel(estimator: Estimator, data: Dataset, scorer: Scorer, fold: str = "fold", parallel: int = 4) -> CrossValidationScores:
    return cross_validate(estimator, data, scorer, fold, parallel)


# --- parameter grids -------------------------------------------------------------------------------

MAX_COMBINATIONS = 2**63 - 1


@dataclass(frozen=True)
class ParameterGrid:
    """Values of named parameters; combinations go through names in order, the last one fastest."""

    parameters: tuple[tuple[str, tuple], ...] = ()

    def with_parameter(self, name: str, values: Iterable) -> "ParameterGrid":
        values = tuple(values)
        if not name.strip():
            raise errors.InvalidParameterName()
        if any(name == n for n, _ in self.parameters):
            raise errors.DuplicateParameter(name=name)
        if not values:
            raise errors.EmptyParameterValues(name=name)
        for i, v in enumerate(values):
            if isinstance(v, float) and not math.isfinite(v):
                raise errors.NonFiniteParameterValue(name=name, index=i)
        return ParameterGrid(tuple(sorted((*self.parameters, (name, values)))))

    def combination_count(self) -> int:
        n = math.prod(len(v) for _, v in self.parameters)
        if n > MAX_COMBINATIONS:
            raise errors.ParameterGridTooLarge()
        return n

    def combinations(self) -> list[dict[str, Any]]:
        self.combination_count()
        names = [n for n, _ in self.parameters]
        return [dict(zip(names, c)) for c in itertools.product(*[v for _, v in self.parameters])]

    def sample_combinations(self, n: int, seed: int = 42) -> list[dict[str, Any]]:
        """n independent draws of every parameter, with replacement."""
        if n < 1:
            raise errors.InvalidSearchIterations(value=n)
        draw = random.Random(seed)
        return [{name: values[draw.randrange(len(values))] for name, values in self.parameters} for _ in range(n)]


@dataclass(frozen=True)
class GridSearchEntry:
    parameters: dict[str, Any]
    scores: CrossValidationScores
    rank: int

    @property
    def mean_score(self) -> float:
        return self.scores.mean


@dataclass(frozen=True)
class GridSearchResult:
    """Entries from the best down; equal means keep the candidates' order and share a rank."""

    entries: tuple[GridSearchEntry, ...]

    @property
    def best(self) -> GridSearchEntry:
        return self.entries[0]

    def __len__(self) -> int:
        return len(self.entries)


def _alike(a: dict[str, Any], b: dict[str, Any]) -> bool:
    return all(v is b[n] or (isinstance(v, (int, float, str)) and type(v) is type(b[n]) and v == b[n]) for n, v in a.items())


def _search(candidates: list[dict[str, Any]], factory, data: Dataset, scorer: Scorer, direction: str, fold: str, parallel: int) -> GridSearchResult:
    """Equal candidates are scored once: sums of two runs can differ in their last digits, which would part their ranks."""
    first = [next(j for j, other in enumerate(candidates) if _alike(c, other)) for c in candidates]
    tried = sorted(set(first))
    scores = dict(zip(tried, _run([lambda c=candidates[i]: cross_validate(factory(c), data, scorer, fold) for i in tried], parallel)))
    found = [scores[i] for i in first]
    sign = -1 if direction == MAXIMIZE else 1
    order = sorted(range(len(found)), key=lambda i: sign * found[i].mean)
    entries, rank = [], 0
    for place, i in enumerate(order):
        if not place or found[i].mean != found[order[place - 1]].mean:
            rank = place + 1
        entries.append(GridSearchEntry(candidates[i], found[i], rank))
    return GridSearchResult(tuple(entries))


def grid_search(grid: ParameterGrid, factory: Callable[[dict], Estimator], data: Dataset, scorer: Scorer, direction: str = MAXIMIZE, fold: str = "fold", parallel: int = 1) -> GridSearchResult:
    """Cross-validate every combination of the grid."""
    return _search(grid.combinations(), factory, data, scorer, direction, fold, parallel)


def grid_search_parallel(grid: ParameterGrid, factory, data: Dataset, scorer: Scorer, direction: str = MAXIMIZE, fold: str = "fold", parallel: int = 4) -> GridSearchResult:
    return grid_search(grid, factory, data, scorer, direction, fold, parallel)


def randomized_search(grid: ParameterGrid, n_iter: int, seed: int, factory, data: Dataset, scorer: Scorer, direction: str = MAXIMIZE, fold: str = "fold", parallel: int = 1) -> GridSearchResult:
    """Cross-validate n_iter drawn combinations."""
    return _search(grid.sample_combinations(n_iter, seed), factory, data, scorer, direction, fold, parallel)


def randomized_search_parallel(grid: ParameterGrid, n_iter: int, seed: int, factory, data: Dataset, scorer: Scorer, direction: str = MAXIMIZE, fold: str = "fold", parallel: int = 4) -> GridSearchResult:
    return randomized_search(grid, n_iter, seed, factory, data, scorer, direction, fold, parallel)


# --- curves ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CurveScores:
    """Scores on training rows and on test rows, points by folds."""

    train_scores: np.ndarray
    test_scores: np.ndarray

    @property
    def train_scores_mean(self) -> list[float]:
        return self.train_scores.mean(1).tolist()

    @property
    def test_scores_mean(self) -> list[float]:
        return self.test_scores.mean(1).tolist()


def _curve(points: list, folds: list[int], one: Callable[[Any, int], tuple[float, float]], parallel: int) -> CurveScores:
    made = _run([lambda p=p, k=k: one(p, k) for p in points for k in folds], parallel)
    both = np.array(made, float).reshape(len(points), len(folds), 2)
    return CurveScores(both[:, :, 0], both[:, :, 1])


def learning_curve(estimator: Estimator, sizes: Sequence[int | float], data: Dataset, scorer: Scorer, fold: str = "fold", parallel: int = 1) -> CurveScores:
    """Scores of fits on the first rows, by row_id, of each fold's training rows.

    A size is a number of rows, or, as a float of at most 1, a share of them (rounded down).
    """
    if not sizes:
        raise errors.EmptyCurvePoints()
    folds = _fold_numbers(data.df, fold)

    def one(size: int | float, k: int) -> tuple[float, float]:
        train, test = data.df.where(col(fold) != k), data.with_df(data.df.where(col(fold) == k))
        n = train.count()
        size = math.floor(size * n) if isinstance(size, float) else size
        if size > n or size < 1:
            raise errors.InsufficientSamples(required=size, actual=n)
        part = data.with_df(ranked(train, order_key(data, False, 0), "_place").where(F.col("_place") < size).drop("_place"))
        model = estimator.fit(part)
        return tuple(scorer(model.predict(d, "prediction"), data.target, "prediction") for d in (part, test))

    return _curve(list(sizes), folds, one, parallel)


def validation_curve(values: Sequence, factory: Callable[[Any], Estimator], data: Dataset, scorer: Scorer, fold: str = "fold", parallel: int = 1) -> CurveScores:
    """Scores of fits with each value of a parameter."""
    if not values:
        raise errors.EmptyCurvePoints()

    def one(value: Any, k: int) -> tuple[float, float]:
        train, test = (data.with_df(data.df.where(c)) for c in (col(fold) != k, col(fold) == k))
        model = factory(value).fit(train)
        return tuple(scorer(model.predict(d, "prediction"), data.target, "prediction") for d in (train, test))

    return _curve(list(values), _fold_numbers(data.df, fold), one, parallel)
