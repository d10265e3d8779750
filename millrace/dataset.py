"""Data of the engine: a DataFrame with named feature columns, perhaps a target, and an order of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import errors


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Dataset:
    """Feature columns, all cast to double, a target of any type, and columns that identify and order the rows.

    Rules about positions (folds, ties, first offenders) are rules about the order of row_id.  A null
    feature is a missing value, as NaN is.
    """

    df: DataFrame
    features: tuple[str, ...]
    target: str | None = None
    row_id: tuple[str, ...] = ()

    def __init__(self, df: DataFrame, features, target: str | None = None, row_id=()):
        ids = (row_id,) if isinstance(row_id, str) else tuple(row_id)
        object.__setattr__(self, "df", df)
        object.__setattr__(self, "features", tuple(features))
        object.__setattr__(self, "target", target)
        object.__setattr__(self, "row_id", ids)

    def with_df(self, df: DataFrame, features=None) -> "Dataset":
        return Dataset(df, self.features if features is None else features, self.target, self.row_id)

    @property
    def xs(self) -> list[Column]:
        return [col(c).cast("double") for c in self.features]

    @property
    def y(self) -> Column:
        return col(self.target)

    @property
    def row(self) -> Column:
        """What tells a row: its id, or null if there is none."""
        if not self.row_id:
            return F.lit(None).cast("string")
        return col(self.row_id[0]) if len(self.row_id) == 1 else F.struct(*map(col, self.row_id))

    @property
    def n_features(self) -> int:
        return len(self.features)

    def n_samples(self) -> int:
        return self.df.count()

    def shape(self) -> tuple[int, int]:
        return self.n_samples(), self.n_features

    def into_parts(self) -> tuple[DataFrame, DataFrame | None]:
        """Features, and the target, each as a DataFrame."""
        return self.df.select(*map(col, self.features)), self.df.select(self.y) if self.target else None

    def validate(self, allow_nan: bool = False, finite_target: bool = False, non_negative: bool = False) -> int:
        """Check shape and values in one aggregate; return the number of rows.

        The error names the first offending cell, by row and then by column.
        """
        if not self.features:
            raise errors.EmptyFeatures()
        tests = []
        for j, x in enumerate(self.xs):
            infinite = F.abs(x) == float("inf")
            bad = infinite if allow_nan else x.isNull() | F.isnan(x) | infinite
            tests.append(F.when(bad, F.struct(self.row.alias("row"), F.lit(j).alias("j"))))
        checks = [F.count("*").alias("n"), F.min(F.coalesce(*tests)).alias("bad")]
        if finite_target:
            t = self.y.cast("double")
            checks.append(F.min(F.when(t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")), F.struct(self.row.alias("row")))).alias("target"))
        if non_negative:
            checks.append(F.min(F.coalesce(*[F.when(x < 0, F.struct(self.row.alias("row"), F.lit(j).alias("j"))) for j, x in enumerate(self.xs)])).alias("low"))
        found = self.df.agg(*checks).first()
        if not found["n"]:
            raise errors.EmptySamples()
        if found["bad"] is not None:
            kind = errors.InfiniteFeature if allow_nan else errors.NonFiniteFeature
            raise kind(row=found["bad"]["row"], column=self.features[found["bad"]["j"]])
        if finite_target and found["target"] is not None:
            raise errors.NonFiniteActualTarget(row=found["target"]["row"])
        if non_negative and found["low"] is not None:
            raise errors.NegativeFeature(row=found["low"]["row"], column=self.features[found["low"]["j"]])
        return found["n"]

    def classes(self) -> list:
        """The target's distinct values in order: as many rows as there are classes."""
        return [r[0] for r in self.df.select(self.y.alias("c")).where("c is not null").distinct().orderBy("c").collect()]


def check_width(features, expected: int) -> None:
    if len(features) != expected:
        raise errors.MismatchedFeatureCount(expected=expected, actual=len(features))


__all__ = ["Dataset", "check_width", "col"]
