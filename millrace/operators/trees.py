"""Decision trees, forests and boosting.

Data of up to LOCAL_ROWS rows is grown exactly over arrays: on the driver for one tree or for rounds
that wait for one another, one task a tree for forests.  Larger data is grown level by level by
aggregates over (node, feature, value), whose prefix sums are taken over ranges of values and then
within them, so that no task holds a node; nodes that have become small are finished over arrays, one
task a node.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..dataset import Dataset
from ..functions.cart import Limits, Tree, gini, grow, leaf_value, variance
from ..functions.expressions import number, sigmoid
from .model_selection import order_key, ranked
from .base import Classifier, Estimator, Predictor, shared_folder

LOCAL_ROWS = 200_000
#: Trees of up to so many leaves in all are applied as CASE expressions, larger ones over Arrow batches.
CASE_LEAVES = 48
RANGES = 256


# --- applying trees --------------------------------------------------------------------------------


def _case(tree: Tree, xs: list[Column], values: Sequence[float], node: int = 0) -> Column:
    if tree.feature[node] < 0:
        return number(values[node])
    return F.when(xs[tree.feature[node]] <= number(tree.threshold[node]), _case(tree, xs, values, tree.left[node])).otherwise(_case(tree, xs, values, tree.right[node]))


def weighted_sums(trees: list[Tree], outputs: list[np.ndarray], xs: list[Column]) -> list[Column]:
    """For each output: the sum over the trees of the row's leaf's number; outputs[t] is leaves by outputs."""
    k = outputs[0].shape[1]
    if sum(t.feature.count(-1) for t in trees) * k <= CASE_LEAVES:
        sums = []
        for o in range(k):
            total = None
            for t, values in zip(trees, outputs):
                part = _case(t, xs, values[:, o])
                total = part if total is None else total + part
            sums.append(total)
        return sums

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        out = np.zeros((len(x), k))
        for t, values in zip(trees, outputs):
            out += values[t.leaves(x)]
        return pd.Series(list(out))

    made = apply(*xs)
    return [made[o] for o in range(k)]


def _leaf_column(tree: Tree, xs: list[Column]) -> Column:
    return _case(tree, xs, range(len(tree.feature))).cast("int")


# --- growing over Spark ----------------------------------------------------------------------------


def _cut(df: DataFrame) -> DataFrame:
    """df as a written table in the folder that executors share."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grow_distributed(frame: DataFrame, p: int, m: int, kind: str, limits: Limits, per_split: int | None = None, seed: int = 0, local_rows: int = LOCAL_ROWS) -> Tree:
    """The tree of a frame with columns x0.., statistics s0.. and a row count c; see functions.cart.grow."""
    rng = np.random.default_rng(seed)
    stats = [f"s{i}" for i in range(m)]
    impurity_of = gini if kind == "gini" else variance
    tree = Tree()

    def totals(df: DataFrame) -> dict[int, tuple[float, np.ndarray, list[tuple[float, float]]]]:
        ranges = [f(f"x{j}").alias(f"{n}{j}") for j in range(p) for n, f in (("lo", F.min), ("hi", F.max))]
        return {r["node"]: (r["c"], np.array([r[s] for s in stats]), [(r[f"lo{j}"], r[f"hi{j}"]) for j in range(p)]) for r in df.groupBy("node").agg(F.sum("c").alias("c"), *[F.sum(s).alias(s) for s in stats], *ranges).collect()}

    frame = frame.withColumn("node", F.lit(0))
    level = 0
    small: list[tuple[int, int]] = []
    found = totals(frame)
    for node, (c, sums, _) in found.items():
        tree.add(leaf_value(kind, sums), c, float(impurity_of(sums)[0]))
    open_ = list(found)
    while open_:
        big = []
        for node in open_:
            c = tree.rows[node]
            if c < limits.min_samples_split or tree.impurity[node] <= 1e-14 or (limits.max_depth is not None and level >= limits.max_depth):
                continue
            (small if c <= local_rows else big).append((node, level) if c <= local_rows else node)
        if not big:
            break
        # places of values in ranges of their node and feature, from the least and greatest values
        chosen = {n: (np.sort(rng.choice(p, per_split, replace=False)).tolist() if per_split and per_split < p else list(range(p))) for n in big}
        bounds = frame.sparkSession.createDataFrame([(n, j, *found[n][2][j]) for n in big for j in chosen[n]], "node int, feature int, lo double, hi double")
        each = frame.where(F.col("node").isin(big)).select("node", "c", *stats, F.posexplode(F.array(*[f"x{j}" for j in range(p)])).alias("feature", "v"))
        hist = each.groupBy("node", "feature", "v").agg(F.sum("c").alias("c"), *[F.sum(s).alias(s) for s in stats]).join(F.broadcast(bounds), ["node", "feature"])
        hist = hist.withColumn("range", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(RANGES - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES))).otherwise(0).cast("int"))
        hist = _cut(hist)
        sums = ["c", *stats]
        by = Window.partitionBy("node", "feature").orderBy("range")
        ranges = hist.groupBy("node", "feature", "range").agg(F.min("v").alias("first"), *[F.sum(s).alias(s) for s in sums])
        ranges = ranges.select("node", "feature", "range", F.lead("first").over(by).alias("after"), *[F.coalesce(F.sum(s).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"b_{s}") for s in sums])
        within = Window.partitionBy("node", "feature", "range").orderBy("v")
        low = hist.withColumn("next", F.lead("v").over(within)).select("node", "feature", "range", "v", "next", *[F.sum(s).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias(f"l_{s}") for s in sums])
        whole = frame.sparkSession.createDataFrame([(n, float(tree.rows[n]), *map(float, found[n][1])) for n in big], "node int, " + ", ".join(f"w_{s} double" for s in sums))
        cand = low.join(ranges, ["node", "feature", "range"]).join(F.broadcast(whole), "node").withColumn("next", F.coalesce("next", "after")).where("next is not null")
        cand = cand.select("node", "feature", "v", "next", *[(F.col(f"l_{s}") + F.col(f"b_{s}")).alias(f"l_{s}") for s in sums], *[(F.col(f"w_{s}") - F.col(f"l_{s}") - F.col(f"b_{s}")).alias(f"r_{s}") for s in sums])
        cand = cand.where((F.col("l_c") >= limits.min_samples_leaf) & (F.col("r_c") >= limits.min_samples_leaf))

        def part(side: str) -> tuple[Column, Column]:
            """Impurity times weight, and weight, of one side."""
            v = [F.col(f"{side}_{s}") for s in stats]
            if kind == "gini":
                w = sum(v[1:], v[0])
                return F.when(w > 0, w - sum((a * a for a in v[1:]), v[0] * v[0]) / w).otherwise(0.0), w
            return F.when(v[0] > 0, v[2] - v[1] * v[1] / v[0]).otherwise(0.0), v[0]

        (il, wl), (ir, wr) = part("l"), part("r")
        score = F.round((il + ir) / (wl + wr), 12)
        best = cand.groupBy("node").agg(F.min(F.struct(score.alias("score"), "feature", (F.col("v") + (F.col("next") - F.col("v")) / 2).alias("t"))).alias("b")).collect()
        splits = {}
        for r in best:
            left, right = tree.add([0.0], 0, 0.0), tree.add([0.0], 0, 0.0)
            tree.split(r["node"], r["b"]["feature"], r["b"]["t"], left, right)
            splits[r["node"]] = (r["b"]["feature"], r["b"]["t"], left, right)
        if not splits:
            break
        moved = F.col("node")
        for n, (j, t, left, right) in splits.items():
            moved = F.when(F.col("node") == n, F.when(F.col(f"x{j}") <= number(t), left).otherwise(right)).otherwise(moved)
        frame = _cut(frame.withColumn("node", moved.cast("int")))
        children = [c for s in splits.values() for c in s[2:]]
        found = totals(frame.where(F.col("node").isin(children)))
        for n in children:
            c, sums_, _ = found[n]
            tree.value[n], tree.rows[n], tree.impurity[n] = [float(v) for v in leaf_value(kind, sums_)], c, float(impurity_of(sums_)[0])
        open_ = children
        level += 1
    if small:
        depths = dict(small)

        def finish(table: pa.Table) -> pa.Table:
            cols = {c: table.column(c).to_numpy() for c in table.column_names}
            node = int(cols["node"][0])
            own = np.random.default_rng([seed, node])
            pick = (lambda: np.sort(own.choice(p, per_split, replace=False))) if per_split and per_split < p else None
            sub = grow(np.column_stack([cols[f"x{j}"] for j in range(p)]), np.column_stack([cols[s] for s in stats]), cols["c"], kind, limits, pick, depths[node])
            return pa.table({"node": pa.array([node], pa.int32()), "tree": pa.array([pickle.dumps(sub)], pa.binary())})

        rows = frame.where(F.col("node").isin([n for n, _ in small])).select("node", "c", *stats, *[f"x{j}" for j in range(p)])
        for r in rows.groupBy("node").applyInArrow(finish, "node int, tree binary").collect():
            tree.graft(r["node"], pickle.loads(bytes(r["tree"])))
    return tree


# --- data ------------------------------------------------------------------------------------------


def _arrays(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """Columns of at most LOCAL_ROWS rows on the driver."""
    t = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).toArrow()
    return np.column_stack([t.column(i).to_numpy() for i in range(len(columns))])


def _ordered(data: Dataset) -> DataFrame:
    return data.df.orderBy(*map(lambda c: F.col(f"`{c}`"), data.row_id)) if data.row_id else data.df


def _indicator(data: Dataset, classes: list) -> list[Column]:
    return [(data.y == F.lit(c)).cast("double") for c in classes]


def _frame(data: Dataset, stats: list[Column], count: Column | None = None) -> DataFrame:
    return data.df.select(*[x.alias(f"x{j}") for j, x in enumerate(data.xs)], (F.lit(1.0) if count is None else count).alias("c"), *[s.cast("double").alias(f"s{i}") for i, s in enumerate(stats)])


# --- single trees ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class _TreeParams(Estimator):
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    local_rows: int = LOCAL_ROWS

    def __post_init__(self):
        if self.min_samples_split < 2:
            raise errors.InvalidMinSamplesSplit(value=self.min_samples_split)
        if self.min_samples_leaf < 1:
            raise errors.InvalidMinSamplesLeaf(value=self.min_samples_leaf)

    @property
    def limits(self) -> Limits:
        return Limits(self.max_depth, self.min_samples_split, self.min_samples_leaf)

    def _grow(self, data: Dataset, n: int, stats: list[Column], kind: str) -> Tree:
        p = data.n_features
        if n <= self.local_rows:
            a = _arrays(_ordered(data), [*data.xs, *stats])
            return grow(a[:, :p], a[:, p:], np.ones(len(a)), kind, self.limits)
        return grow_distributed(_frame(data, stats), p, len(stats), kind, self.limits, local_rows=self.local_rows)


@dataclass(frozen=True)
class TreeClassifierModel(Classifier):
    """Mean of the class shares of the trees' leaves."""

    features: tuple[str, ...]
    classes: list
    trees: list[Tree]

    def probability(self, xs: list[Column]) -> Column:
        return F.array(*weighted_sums(self.trees, [np.array(t.value) / len(self.trees) for t in self.trees], xs))

    @property
    def feature_importances(self) -> list[float]:
        return np.mean([t.importances(len(self.features)) for t in self.trees], 0).tolist()


@dataclass(frozen=True)
class TreeRegressorModel(Predictor):
    """init plus rate times the sum of the trees' leaves (for a forest: their mean)."""

    features: tuple[str, ...]
    trees: list[Tree]
    init: float = 0.0
    rate: float = 1.0

    def prediction(self, xs: list[Column]) -> Column:
        return number(self.init) + weighted_sums(self.trees, [np.array(t.value) * self.rate for t in self.trees], xs)[0]

    @property
    def feature_importances(self) -> list[float]:
        return np.mean([t.importances(len(self.features)) for t in self.trees], 0).tolist()


@dataclass(frozen=True)
class DecisionTreeClassifier(_TreeParams):
    """One tree by Gini impurity."""

    def fit(self, data: Dataset) -> TreeClassifierModel:
        n = data.validate()
        classes = data.classes()
        return TreeClassifierModel(data.features, classes, [self._grow(data, n, _indicator(data, classes), "gini")])


@dataclass(frozen=True)
class DecisionTreeRegressor(_TreeParams):
    """One tree by variance."""

    def fit(self, data: Dataset) -> TreeRegressorModel:
        n = data.validate(finite_target=True)
        y = data.y.cast("double")
        return TreeRegressorModel(data.features, [self._grow(data, n, [F.lit(1.0), y, y * y], "variance")])


# --- forests ---------------------------------------------------------------------------------------


def features_per_split(rule, p: int) -> int:
    """"all", "sqrt", "log2" or a number, between 1 and p."""
    if isinstance(rule, int):
        if rule < 1:
            raise errors.InvalidMaxFeatures(value=rule)
        return min(rule, p)
    return max(1, min(p, {"all": p, "sqrt": math.isqrt(p), "log2": int(math.log2(p)) if p > 1 else 1}[rule]))


@dataclass(frozen=True)
class _Forest(_TreeParams):
    n_estimators: int = 100
    max_features: str | int = "sqrt"
    seed: int = 42

    def __post_init__(self):
        super().__post_init__()
        if self.n_estimators < 1:
            raise errors.InvalidEstimatorCount(value=self.n_estimators)
        features_per_split(self.max_features, 1)

    def _trees(self, data: Dataset, n: int, stats: list[Column], kind: str) -> list[Tree]:
        p, m = data.n_features, len(stats)
        per, limits, seed = features_per_split(self.max_features, p), self.limits, self.seed
        spark = data.df.sparkSession
        if n > self.local_rows:
            # n draws of n places, each row's place being its rank: equal rows are drawn each for itself
            placed = _cut(ranked(data.df, order_key(data, False, 0) if data.row_id else data.xs, "_place"))
            count = F.col("_times").cast("double")
            made = []
            for t in range(self.n_estimators):
                draws = spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(t)), F.lit(n)).alias("_place")).groupBy("_place").agg(F.count("*").alias("_times"))
                frame = _frame(data.with_df(placed.join(draws, "_place")), [s * count for s in stats], count)
                made.append(grow_distributed(frame, p, m, kind, limits, per, seed + t, self.local_rows))
            return made
        held = spark.sparkContext.broadcast(_arrays(_ordered(data), [*data.xs, *stats]))  # local_rows rows at most

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = held.value
            for b in batches:
                for t in b["id"]:
                    rng = np.random.default_rng([seed, int(t)])
                    drawn = np.bincount(rng.integers(0, len(a), len(a)), minlength=len(a))
                    at = np.flatnonzero(drawn)
                    c = drawn[at].astype(float)
                    pick = (lambda r=rng: np.sort(r.choice(p, per, replace=False))) if per < p else None
                    tree = grow(a[at, :p], a[at, p:] * c[:, None], c, kind, limits, pick)
                    yield pd.DataFrame({"id": [t], "tree": [pickle.dumps(tree)]})

        tasks = min(self.n_estimators, 4 * spark.sparkContext.defaultParallelism)
        rows = spark.range(0, self.n_estimators, 1, tasks).mapInPandas(work, "id long, tree binary").collect()
        return [pickle.loads(bytes(r["tree"])) for r in sorted(rows, key=lambda r: r["id"])]


@dataclass(frozen=True)
class RandomForestClassifier(_Forest):
    """Trees on rows drawn with replacement, each split among features drawn anew."""

    def fit(self, data: Dataset) -> TreeClassifierModel:
        n = data.validate()
        classes = data.classes()
        return TreeClassifierModel(data.features, classes, self._trees(data, n, _indicator(data, classes), "gini"))


@dataclass(frozen=True)
class RandomForestRegressor(_Forest):
    max_features: str | int = "all"

    def fit(self, data: Dataset) -> TreeRegressorModel:
        n = data.validate(finite_target=True)
        y = data.y.cast("double")
        trees = self._trees(data, n, [F.lit(1.0), y, y * y], "variance")
        return TreeRegressorModel(data.features, trees, 0.0, 1 / len(trees))


# --- boosting --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Boosting(_TreeParams):
    max_depth: int | None = 3
    n_estimators: int = 100
    learning_rate: float = 0.1

    def __post_init__(self):
        super().__post_init__()
        if self.n_estimators < 1:
            raise errors.InvalidEstimatorCount(value=self.n_estimators)
        if not math.isfinite(self.learning_rate) or self.learning_rate <= 0:
            raise errors.InvalidLearningRate(value=self.learning_rate)


def _squares(r: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(r)), r, r * r])


@dataclass(frozen=True)
class GradientBoostingRegressor(_Boosting):
    """Trees on residuals, begun from the mean."""

    def fit(self, data: Dataset) -> TreeRegressorModel:
        n = data.validate(finite_target=True)
        y, p = data.y.cast("double"), data.n_features
        init = data.df.agg(F.avg(y)).first()[0]
        trees: list[Tree] = []
        if n <= self.local_rows:
            a = _arrays(_ordered(data), [*data.xs, y])
            x, score = a[:, :p], np.full(len(a), init)
            for _ in range(self.n_estimators):
                trees.append(grow(x, _squares(a[:, p] - score), np.ones(len(a)), "variance", self.limits))
                score += self.learning_rate * np.array(trees[-1].value)[trees[-1].leaves(x), 0]
        else:
            state = data.df.select(*[x.alias(f"x{j}") for j, x in enumerate(data.xs)], y.alias("y"), number(init).alias("score"))
            xs = [F.col(f"x{j}") for j in range(p)]
            for _ in range(self.n_estimators):
                r = F.col("y") - F.col("score")
                frame = state.select(*xs, F.lit(1.0).alias("c"), F.lit(1.0).alias("s0"), r.alias("s1"), (r * r).alias("s2"))
                trees.append(grow_distributed(frame, p, 3, "variance", self.limits, local_rows=self.local_rows))
                state = _cut(state.withColumn("score", F.col("score") + weighted_sums(trees[-1:], [np.array(trees[-1].value) * self.learning_rate], xs)[0]))
        return TreeRegressorModel(data.features, trees, init, self.learning_rate)


@dataclass(frozen=True)
class BinaryScoreModel(Classifier):
    """Two classes by a score: a sigmoid of init plus the trees' sum gives the second one's probability."""

    features: tuple[str, ...]
    classes: list
    trees: list[Tree]
    outputs: list[np.ndarray]
    init: float = 0.0

    def score(self, xs: list[Column]) -> Column:
        return number(self.init) + weighted_sums(self.trees, self.outputs, xs)[0]

    def probability(self, xs: list[Column]) -> Column:
        p = sigmoid(self.score(xs))
        return F.array(1 - p, p)

    def prediction(self, xs: list[Column]) -> Column:
        return F.when(self.score(xs) >= 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))

    @property
    def feature_importances(self) -> list[float]:
        return np.mean([t.importances(len(self.features)) for t in self.trees], 0).tolist()


def _two(data: Dataset) -> list:
    classes = data.classes()
    if len(classes) != 2:
        raise errors.ExpectedBinaryTargets(classes=len(classes))
    return classes


@dataclass(frozen=True)
class GradientBoostingClassifier(_Boosting):
    """Trees on residuals of two classes' probabilities; a leaf's number is one Newton step.

    Leaves of equal raw means share one step.
    """

    def fit(self, data: Dataset) -> BinaryScoreModel:
        n = data.validate()
        classes = _two(data)
        y, p = (data.y == F.lit(classes[1])).cast("double"), data.n_features
        share = data.df.agg(F.avg(y)).first()[0]
        init = math.log(share / (1 - share))
        trees: list[Tree] = []
        outputs: list[np.ndarray] = []

        def newton(tree: Tree, sums: dict[int, tuple[float, float]]) -> np.ndarray:
            """Steps of the leaves from their sums of residuals and of p (1 - p)."""
            by_mean: dict[float, list[float]] = {}
            for leaf, (r, h) in sums.items():
                s = by_mean.setdefault(tree.value[leaf][0], [0.0, 0.0])
                s[0] += r
                s[1] += h
            out = np.zeros((len(tree.feature), 1))
            for leaf in sums:
                r, h = by_mean[tree.value[leaf][0]]
                out[leaf, 0] = r / h if h > 1e-12 else 0.0
            return out * self.learning_rate

        if n <= self.local_rows:
            a = _arrays(_ordered(data), [*data.xs, y])
            x, score = a[:, :p], np.full(len(a), init)
            for _ in range(self.n_estimators):
                prob = 1 / (1 + np.exp(-score))
                r, h = a[:, p] - prob, prob * (1 - prob)
                trees.append(grow(x, _squares(r), np.ones(len(a)), "variance", self.limits))
                leaf = trees[-1].leaves(x)
                size = len(trees[-1].feature)
                rs, hs = np.bincount(leaf, r, size), np.bincount(leaf, h, size)
                outputs.append(newton(trees[-1], {i: (rs[i], hs[i]) for i in np.unique(leaf).tolist()}))
                score += outputs[-1][leaf, 0]
        else:
            state = data.df.select(*[x.alias(f"x{j}") for j, x in enumerate(data.xs)], y.alias("y"), number(init).alias("score"))
            xs = [F.col(f"x{j}") for j in range(p)]
            for _ in range(self.n_estimators):
                prob = sigmoid(F.col("score"))
                r = F.col("y") - prob
                frame = state.select(*xs, F.lit(1.0).alias("c"), F.lit(1.0).alias("s0"), r.alias("s1"), (r * r).alias("s2"))
                trees.append(grow_distributed(frame, p, 3, "variance", self.limits, local_rows=self.local_rows))
                leaves = state.select(_leaf_column(trees[-1], xs).alias("leaf"), r.alias("r"), (prob * (1 - prob)).alias("h")).groupBy("leaf").agg(F.sum("r").alias("r"), F.sum("h").alias("h")).collect()
                outputs.append(newton(trees[-1], {q["leaf"]: (q["r"], q["h"]) for q in leaves}))
                state = _cut(state.withColumn("score", F.col("score") + weighted_sums(trees[-1:], outputs[-1:], xs)[0]))
        return BinaryScoreModel(data.features, classes, trees, outputs, init)


@dataclass(frozen=True)
class AdaBoostClassifier(_Boosting):
    """Two classes by votes of weak trees on reweighted rows; a perfect tree ends the rounds with a vote of 1."""

    max_depth: int | None = 1
    n_estimators: int = 50
    learning_rate: float = 1.0

    def fit(self, data: Dataset) -> BinaryScoreModel:
        n = data.validate()
        classes = _two(data)
        y, p = (data.y == F.lit(classes[1])).cast("double"), data.n_features
        trees: list[Tree] = []
        votes: list[float] = []
        local = n <= self.local_rows
        if local:
            a = _arrays(_ordered(data), [*data.xs, y])
            x, positive, w = a[:, :p], a[:, p] > 0, np.full(n, 1 / n)
        else:
            state = data.df.select(*[x.alias(f"x{j}") for j, x in enumerate(data.xs)], y.alias("y"), F.lit(1 / n).alias("w"))
            xs = [F.col(f"x{j}") for j in range(p)]
        eps = float(np.finfo(float).eps)
        for _ in range(self.n_estimators):
            if local:
                w = np.maximum(w, eps)
                tree = grow(x, np.column_stack([w * ~positive, w * positive]), np.ones(n), "gini", self.limits)
                says = np.array(tree.value).argmax(1).astype(bool)
                wrong = says[tree.leaves(x)] != positive
                err = float(w[wrong].sum() / w.sum())
            else:
                state = state.withColumn("w", F.greatest("w", F.lit(eps)))
                frame = state.select(*xs, F.lit(1.0).alias("c"), (F.col("w") * (1 - F.col("y"))).alias("s0"), (F.col("w") * F.col("y")).alias("s1"))
                tree = grow_distributed(frame, p, 2, "gini", self.limits, local_rows=self.local_rows)
                says = np.array(tree.value).argmax(1).astype(bool)
                miss = _case(tree, xs, says.astype(float)) != F.col("y")
                row = state.agg(F.sum(F.when(miss, F.col("w")).otherwise(0.0)).alias("e"), F.sum("w").alias("w")).first()
                err = row["e"] / row["w"]
            if err <= 0:
                trees.append(tree)
                votes.append(1.0)
                break
            if err >= 0.5:
                if not trees:
                    raise errors.WeakLearnerNoBetterThanRandom()
                break
            alpha = self.learning_rate * math.log((1 - err) / err)
            trees.append(tree)
            votes.append(alpha)
            if local:
                w = np.where(wrong, w * math.exp(alpha), w)
                w /= w.sum()
            else:
                state = state.withColumn("w", F.when(miss, F.col("w") * math.exp(alpha)).otherwise(F.col("w")))
                whole = state.agg(F.sum("w")).first()[0]
                state = _cut(state.withColumn("w", F.col("w") / whole))
        outputs = [np.where(np.array(t.value).argmax(1) == 1, 1.0, -1.0)[:, None] * 2 * v / sum(votes) for t, v in zip(trees, votes)]
        return BinaryScoreModel(data.features, classes, trees, outputs, 0.0)
