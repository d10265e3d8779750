"""Permutation importance: how much worse a score gets when one column is shuffled."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from .. import errors
from ..dataset import Dataset, col
from .model_selection import MAXIMIZE, Scorer, _run, order_key, ranked


@dataclass(frozen=True)
class PermutationImportance:
    """Importances, features by repeats."""

    importances: np.ndarray

    @property
    def importances_mean(self) -> list[float]:
        return self.importances.mean(1).tolist()

    @property
    def importances_std(self) -> list[float]:
        return self.importances.std(1).tolist()


def permutation_importance(model, data: Dataset, scorer: Scorer, direction: str = MAXIMIZE, n_repeats: int = 5, seed: int = 42, parallel: int = 1) -> PermutationImportance:
    """The score less that with a feature's values dealt anew to the rows (or the other way round to minimise).

    Values change places by their ranks in the order of a hash of row, feature, repeat and seed.
    """
    if n_repeats < 1:
        raise errors.InvalidRepeatCount(value=n_repeats)
    data.validate()
    base = scorer(model.predict(data, "prediction"), data.target, "prediction")
    placed = ranked(data.df, order_key(data, False, 0), "_place")

    def one(j: int, r: int) -> float:
        name = data.features[j]
        dealt = ranked(data.df.select(*map(col, data.row_id), col(name).alias("_value")), order_key(data, True, hash((seed, j, r)) % (1 << 31)), "_place").select("_place", "_value")
        moved = placed.join(dealt, "_place").withColumn(name, F.col("_value")).drop("_place", "_value")
        value = scorer(model.predict(data.with_df(moved), "prediction"), data.target, "prediction")
        return base - value if direction == MAXIMIZE else value - base

    made = _run([lambda j=j, r=r: one(j, r) for j in range(data.n_features) for r in range(n_repeats)], parallel)
    return PermutationImportance(np.array(made).reshape(data.n_features, n_repeats))
