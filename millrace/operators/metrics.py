"""Metrics of regression, classification and probabilities, each one aggregate or a small group-by.

Functions take a DataFrame and the names of its columns.  Those that give several numbers return a
DataFrame; the others a float.  With row_id, the column or columns that identify and order the rows,
errors name the first offending row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from ..dataset import col
from ..functions.expressions import finite

#: Probabilities are kept this far from 0 and 1 in log losses.
EPSILON = 2.220446049250313e-16


def _finished(metric: str, value: float | None) -> float:
    if value is None or not math.isfinite(value):
        raise errors.NonFiniteMetricResult(metric=metric)
    return float(value)


def _row(row_id: str | Sequence[str] | None) -> Column:
    """What errors call a row: its id, or null if none is named."""
    ids = [row_id] if isinstance(row_id, str) else list(row_id or ())
    if not ids:
        return F.lit(None).cast("string")
    return col(ids[0]) if len(ids) == 1 else F.struct(*map(col, ids))


def _first(bad: Column, row_id, *more: Column) -> Column:
    """The first row that is bad, with what more is to be told of it; null if none is."""
    return F.min(F.when(bad, F.struct(_row(row_id).alias("row"), *more)))


# --- regression ------------------------------------------------------------------------------------


def _pairs(df: DataFrame, actual: str, predicted: str, row_id, *more: Column):
    a, p = col(actual).cast("double"), col(predicted).cast("double")
    row = df.agg(F.count("*").alias("n"), _first(~finite(a), row_id).alias("bad_a"), _first(~finite(p), row_id).alias("bad_p"), *more).first()
    if not row["n"]:
        raise errors.EmptyMetricInput()
    if row["bad_a"]:
        raise errors.NonFiniteActualTarget(row=row["bad_a"]["row"])
    if row["bad_p"]:
        raise errors.NonFinitePrediction(row=row["bad_p"]["row"])
    return row


def mean_squared_error(df: DataFrame, actual: str, predicted: str, row_id: str | Sequence[str] | None = None) -> float:
    """The mean to its last digits, whatever the order of the rows: a second pass adds up what is left of a first mean.

    Plain sums of millions of rows lose more than some searches' candidates differ by.
    """
    d = col(actual).cast("double") - col(predicted)
    first = _finished("mean_squared_error", _pairs(df, actual, predicted, row_id, F.avg(d * d).alias("v"))["v"])
    return _finished("mean_squared_error", first + df.agg(F.avg(d * d - F.lit(first))).first()[0])


def root_mean_squared_error(df: DataFrame, actual: str, predicted: str, row_id: str | Sequence[str] | None = None) -> float:
    return math.sqrt(mean_squared_error(df, actual, predicted, row_id))


def mean_absolute_error(df: DataFrame, actual: str, predicted: str, row_id: str | Sequence[str] | None = None) -> float:
    return _finished("mean_absolute_error", _pairs(df, actual, predicted, row_id, F.avg(F.abs(col(actual).cast("double") - col(predicted))).alias("v"))["v"])


def r2_score(df: DataFrame, actual: str, predicted: str, row_id: str | Sequence[str] | None = None) -> float:
    """1 less the ratio of squared errors to squared deviations; no value for constant targets."""
    a = col(actual).cast("double")
    d = a - col(predicted)
    row = _pairs(df, actual, predicted, row_id, F.avg(d * d).alias("e"), F.var_pop(a).alias("v"))
    if row["v"] == 0:
        raise errors.ConstantTargets()
    return _finished("r2_score", 1 - row["e"] / row["v"])


# --- classification --------------------------------------------------------------------------------


def accuracy_score(df: DataFrame, actual: str, predicted: str) -> float:
    row = df.agg(F.count("*").alias("n"), F.avg((col(actual) == col(predicted)).cast("double")).alias("v")).first()
    if not row["n"]:
        raise errors.EmptyMetricInput()
    return float(row["v"])


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted and n for every pair of classes, with zeros.  As many rows as classes squared."""
    cells = df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    classes = cells.select(F.col("actual").alias("c")).union(cells.select("predicted")).distinct()
    listed = [r["c"] for r in classes.collect()]
    if not listed:
        raise errors.EmptyMetricInput()
    each = F.array(*[F.lit(c) for c in sorted(listed)])
    grid = df.sparkSession.range(1).select(F.explode(each).alias("actual")).select("actual", F.explode(each).alias("predicted"))
    return grid.join(F.broadcast(cells), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@dataclass(frozen=True)
class ZeroDivision:
    """What stands for 0 / 0: 0, 1, or an error."""

    value: float | None


ZERO, ONE, ERROR = ZeroDivision(0.0), ZeroDivision(1.0), ZeroDivision(None)


def class_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """class, hits, predicted and support of every class that is actual or predicted."""
    a, p = col(actual), col(predicted)
    each = df.select(F.explode(F.array(F.struct(a.alias("class"), (a == p).cast("long").alias("hit"), F.lit(0).cast("long").alias("p"), F.lit(1).cast("long").alias("s")), F.struct(p.alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(1).cast("long").alias("p"), F.lit(0).cast("long").alias("s")))).alias("r")).select("r.*")
    return each.groupBy("class").agg(F.sum("hit").alias("hits"), F.sum("p").alias("predicted"), F.sum("s").alias("support"))


def _ratio(a: Column, b: Column, zero: ZeroDivision) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(zero.value if zero.value is not None else 0.0))


def classification_report(df: DataFrame, actual: str, predicted: str, zero_division: ZeroDivision = ZERO) -> DataFrame:
    """class, precision, recall, f1 and support of each class, and the accuracy."""
    counts = class_counts(df, actual, predicted)
    if zero_division.value is None:
        rows = counts.where("predicted = 0 or support = 0").orderBy("class").limit(1).collect()
        if rows:
            before = counts.where(F.col("class") < F.lit(rows[0]["class"])).count()
            raise errors.UndefinedClassificationMetric(metric="precision" if not rows[0]["predicted"] else "recall", index=before)
    p, r = _ratio(F.col("hits"), F.col("predicted"), zero_division), _ratio(F.col("hits"), F.col("support"), zero_division)
    made = counts.select("class", p.alias("precision"), r.alias("recall"), "support", "hits")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    whole = counts.agg((F.sum("hits") / F.sum("support")).alias("accuracy"))
    return made.select("class", "precision", "recall", f1.alias("f1"), "support").join(F.broadcast(whole))


def _averaged(df: DataFrame, actual: str, predicted: str, what: str, averaging: str, zero_division: ZeroDivision) -> float:
    if averaging == "micro":
        return accuracy_score(df, actual, predicted)
    report = classification_report(df, actual, predicted, zero_division)
    how = F.avg(what) if averaging == "macro" else F.sum(F.col(what) * F.col("support")) / F.sum("support")
    value = report.agg(how.alias("v")).first()["v"]
    if value is None:
        raise errors.EmptyMetricInput()
    return float(value)


def precision_score(df: DataFrame, actual: str, predicted: str, averaging: str = "macro", zero_division: ZeroDivision = ZERO) -> float:
    return _averaged(df, actual, predicted, "precision", averaging, zero_division)


def recall_score(df: DataFrame, actual: str, predicted: str, averaging: str = "macro", zero_division: ZeroDivision = ZERO) -> float:
    return _averaged(df, actual, predicted, "recall", averaging, zero_division)


def f1_score(df: DataFrame, actual: str, predicted: str, averaging: str = "macro", zero_division: ZeroDivision = ZERO) -> float:
    return _averaged(df, actual, predicted, "f1", averaging, zero_division)


# --- probabilities ---------------------------------------------------------------------------------


def _clamped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def _refuse(found) -> None:
    """Raise the error of a probability, if one was found that is none."""
    if found is not None and found["p"] is not None and math.isfinite(found["p"]):
        raise errors.InvalidProbability(row=found["row"], value=found["p"])
    if found is not None:
        raise errors.NonFiniteProbability(row=found["row"])


def _improper(p: Column) -> Column:
    return ~finite(p) | (p < 0) | (p > 1)


def _binary(df: DataFrame, actual: str, probability: str, positive, row_id, *more: Column):
    p = col(probability).cast("double")
    row = df.agg(
        F.count("*").alias("n"), _first(_improper(p), row_id, p.alias("p")).alias("bad"), F.count_distinct(col(actual)).alias("classes"), F.count_if(col(actual) == F.lit(positive)).alias("pos"), *more
    ).first()
    if not row["n"]:
        raise errors.EmptyMetricInput()
    _refuse(row["bad"])
    if row["classes"] != 2:
        raise errors.ExpectedBinaryTargets(classes=row["classes"])
    if not row["pos"]:
        raise errors.PositiveLabelNotFound()
    return row


def binary_log_loss(df: DataFrame, actual: str, probability: str, positive, row_id: str | Sequence[str] | None = None) -> float:
    p = _clamped(col(probability).cast("double"))
    loss = -F.log(F.when(col(actual) == F.lit(positive), p).otherwise(1 - p))
    return _finished("binary_log_loss", _binary(df, actual, probability, positive, row_id, F.avg(loss).alias("v"))["v"])


def multiclass_log_loss(df: DataFrame, actual: str, probabilities: str, classes: Sequence, row_id: str | Sequence[str] | None = None) -> float:
    """probabilities is an array in the order of the sorted classes; only the actual class's is looked at."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), col(actual))
    p = F.element_at(col(probabilities), F.greatest(place.cast("int"), F.lit(1)))
    row = df.agg(
        F.count("*").alias("n"), _first(F.coalesce(place, F.lit(0)) == 0, row_id).alias("unknown"), F.max(F.size(col(probabilities))).alias("most"), F.min(F.size(col(probabilities))).alias("least"),
        _first(_improper(p), row_id, p.cast("double").alias("p")).alias("bad"), F.avg(-F.log(_clamped(p))).alias("v"),
    ).first()
    if not row["n"]:
        raise errors.EmptyMetricInput()
    for size in (row["least"], row["most"]):
        if size != len(classes):
            raise errors.MismatchedClassCount(expected=len(classes), actual=size)
    if row["unknown"]:
        raise errors.UnknownLabel(row=row["unknown"]["row"])
    _refuse(row["bad"])
    return _finished("multiclass_log_loss", row["v"])


def _auc(scored: DataFrame) -> DataFrame:
    """class and auc from class, p and hit (0 or 1), by ranks with ties averaged.

    Rows of equal class and p meet in one aggregate.  These are dealt by ranges of class and p, drawn
    from a sample and so of like sizes wherever the values lie; ranks are counted within each range,
    and what stands below a range is added to its sums.
    """
    ties = scored.groupBy("class", "p").agg(F.count("*").alias("n"), F.sum("hit").alias("pos"))
    dealt = ties.repartitionByRange("class", "p").withColumn("range", F.spark_partition_id())
    within = Window.partitionBy("class", "range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n").over(within), F.lit(0)) + (F.col("n") + 1) / 2
    parts = dealt.withColumn("r", F.col("pos") * rank).groupBy("class", "range").agg(F.sum("r").alias("r"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # as many rows as ranges, or as classes and ranges
    before = Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("r", F.col("r") + F.col("pos") * F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = placed.groupBy("class").agg(F.sum("r").alias("r"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return sums.select("class", F.when((pos > 0) & (neg > 0), (F.col("r") - pos * (pos + 1) / 2) / (pos.cast("double") * neg)).alias("auc"))


def roc_auc_score(df: DataFrame, actual: str, probability: str, positive, row_id: str | Sequence[str] | None = None) -> float:
    _binary(df, actual, probability, positive, row_id)
    made = _auc(df.select(F.lit(0).alias("class"), col(probability).cast("double").alias("p"), (col(actual) == F.lit(positive)).cast("long").alias("hit")))
    return _finished("roc_auc", made.first()["auc"])


def roc_auc_score_ovr(df: DataFrame, actual: str, probabilities: str, classes: Sequence, row_id: str | Sequence[str] | None = None) -> float:
    """Mean over the classes of the area of each against the rest."""
    if len(classes) < 2:
        raise errors.InsufficientClasses(required=2, actual=len(classes))
    p = col(probabilities)
    wrong = F.filter(p, _improper)
    row = df.agg(
        F.count("*").alias("n"), F.min(F.size(p)).alias("least"), F.max(F.size(p)).alias("most"), _first(F.size(wrong) > 0, row_id, F.get(wrong, F.lit(0)).cast("double").alias("p")).alias("bad")
    ).first()
    if not row["n"]:
        raise errors.EmptyMetricInput()
    for size in (row["least"], row["most"]):
        if size != len(classes):
            raise errors.MismatchedClassCount(expected=len(classes), actual=size)
    _refuse(row["bad"])
    names = F.array(*[F.lit(c) for c in classes])
    each = df.select(col(actual).alias("actual"), F.posexplode(p).alias("class", "p"))
    made = _auc(each.select("class", "p", (F.col("actual") == F.element_at(names, F.col("class") + 1)).cast("long").alias("hit"))).collect()
    return _finished("roc_auc_ovr", sum(r["auc"] if r["auc"] is not None else math.nan for r in made) / len(classes))
