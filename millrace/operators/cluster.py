"""Clustering: k-means, DBSCAN and Gaussian mixtures."""

from __future__ import annotations

import itertools
import math
import uuid

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StringType, StructField, StructType

from .. import errors
from ..dataset import Dataset, check_width, col
from ..functions.expressions import LOG_2PI, argmax, dot, number, softmax, squared_distance, total
from ..plans.aggregates import moments, sum_over
from .base import Classifier, Transformer, TransformerEstimator, check_iterations, check_tolerance, shared_folder
from .model_selection import ranked


# --- k-means ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class KMeans(TransformerEstimator):
    """Lloyd's rounds until the centres' summed squared moves are within the tolerance, or max_iterations.

    Of equally near centres the first wins; a centre without rows stays.  init: "plusplus", "random",
    or "first", the first rows in order of row_id.
    """

    n_clusters: int
    init: str = "plusplus"
    max_iterations: int = 300
    tolerance: float = 1e-4
    seed: int = 42

    def __post_init__(self):
        if self.n_clusters < 1:
            raise errors.InvalidClusterCount(value=self.n_clusters)
        check_iterations(self.max_iterations)
        check_tolerance(self.tolerance)

    def _start(self, frame: DataFrame, p: int, order: Column) -> np.ndarray:
        """k rows to begin with, each found by a top-1 or a small aggregate over hashed draws."""
        k = self.n_clusters
        xs = [f"x{i}" for i in range(p)]
        draw = F.md5(F.concat_ws("-", F.col("_row").cast("string"), F.lit(str(self.seed))))
        if self.init != "plusplus":
            by = order if self.init == "first" else draw
            return np.array([[r[c] for c in xs] for r in frame.orderBy(by).limit(k).collect()])
        centres = [frame.orderBy(draw).limit(1).select(*xs).first()]
        for j in range(1, k):
            d = F.array_min(F.array(*[squared_distance([F.col(c) for c in xs], list(c)) for c in centres]))
            # an exponential race: the least of -ln(u) / d falls on a row with a chance in proportion to d
            hashed = F.md5(F.concat_ws("-", F.col("_row").cast("string"), F.lit(str(self.seed)), F.lit(str(j))))
            u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
            race = F.when(d > 0, -F.log(u) / d)
            found = frame.select(*xs, race.alias("race")).orderBy(F.col("race").asc_nulls_last(), *xs).limit(1).first()
            centres.append(found[:p])
        return np.array([list(c)[:p] for c in centres], float)

    def fit(self, data: Dataset) -> "FittedKMeans":
        n = data.validate()
        k, p = self.n_clusters, data.n_features
        if n < k:
            raise errors.InsufficientSamples(required=k, actual=n)
        row = data.row if data.row_id else F.struct(*data.xs)
        frame = data.df.select(row.alias("_row"), *[x.alias(f"x{i}") for i, x in enumerate(data.xs)]).persist()
        try:
            columns = [F.col(f"x{i}") for i in range(p)]
            centres = self._start(frame, p, F.col("_row"))

            def assigned(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                d = np.stack([((m - x) ** 2).sum(1) for x in c], 1)
                return d.argmin(1), d.min(1)

            converged, rounds = False, 0
            while rounds < self.max_iterations and not converged:
                rounds += 1
                now = centres.copy()

                def kernel(m: np.ndarray) -> np.ndarray:
                    label, _ = assigned(m, now)
                    sums = np.zeros((k, p + 1))
                    for j in range(p):
                        sums[:, j] = np.bincount(label, m[:, j], k)
                    sums[:, p] = np.bincount(label, minlength=k)
                    return sums.ravel()

                sums = sum_over(frame, columns, kernel, k * (p + 1)).reshape(k, p + 1)
                centres = np.where(sums[:, p:] > 0, sums[:, :p] / np.maximum(sums[:, p:], 1), centres)
                converged = bool(((centres - now) ** 2).sum() <= self.tolerance)
            final = centres
            inertia = float(sum_over(frame, columns, lambda m: np.array([assigned(m, final)[1].sum()]), 1)[0])
        finally:
            frame.unpersist()
        return FittedKMeans(data.features, tuple(tuple(c.tolist()) for c in centres), inertia, rounds, converged)


@dataclass(frozen=True)
class FittedKMeans(Transformer):
    features: tuple[str, ...]
    centres: tuple[tuple[float, ...], ...]
    inertia: float
    iterations: int
    converged: bool

    def predict(self, data: Dataset, output: str = "cluster") -> DataFrame:
        check_width(data.features, len(self.features))
        far = F.array(*[-squared_distance(data.xs, c) for c in self.centres])
        return data.df.withColumn(output, (argmax(far) - 1).cast("int"))

    def transform(self, data: Dataset) -> Dataset:
        """Distances from the centres as features."""
        check_width(data.features, len(self.features))
        names = tuple(f"distance_{i}" for i in range(len(self.centres)))
        made = [F.sqrt(squared_distance(data.xs, c)).alias(n) for c, n in zip(self.centres, names)]
        others = [c for c in data.df.columns if c not in data.features]
        return data.with_df(data.df.select(*map(col, others), *made), names)


# --- DBSCAN ----------------------------------------------------------------------------------------


def _shared(spark: SparkSession) -> str:
    """A new place in the folder that executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends there."""
    path = _shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Features that points meet by; cells of more would have too many neighbours.
GRID = 3


#: Up to so many edges one task finds all components.
TASK_EDGES = 4_000_000


def _components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least number of each number's component, of n that edges u, v connect."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _labels_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [b for b in batches if b.num_rows]
    if edges:
        table = pa.Table.from_batches(edges)
        ids = pc.unique(pa.chunked_array(table.column("id").chunks + table.column("other").chunks))
        ids = ids.take(pc.sort_indices(ids))
        u, v = (pc.index_in(table.column(c), value_set=ids).to_numpy() for c in ("id", "other"))
        label = _components(u, v, len(ids))
        cluster = np.unique(label, return_inverse=True)[1]
        yield from pa.table({"id": ids, "label": ids.take(pa.array(label)), "cluster": pa.array(cluster, pa.int32())}).to_batches()


def _least_labels(edges: DataFrame) -> DataFrame:
    """id and label, the least id of its component, of every id in edges (id, other), which hold both ways and every id itself.

    Where one task finds them, it ranks the labels too: there is a column cluster then.
    """
    kind = edges.schema["id"].dataType
    if isinstance(kind, (IntegralType, StringType)) and edges.count() <= TASK_EDGES:
        named = edges.select("id", "other").repartition(1)
        return _cut(named.mapInArrow(_labels_of_batches, StructType([StructField("id", kind), StructField("label", kind), StructField("cluster", IntegerType())])))
    label = _cut(edges.groupBy("id").agg(F.min("other").alias("label")))
    own = F.when(F.col("id") == F.col("other"), F.col("l"))
    while True:
        # the least label among neighbours, and then the label of that label: paths shrink by halves
        old = label.select("id", F.col("label").alias("l"))
        spread = edges.join(old.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("l").alias("label"), F.min(own).alias("old"))
        label = _cut(spread.join(old.withColumnRenamed("id", "label"), "label").select("id", F.least("label", "l").alias("label"), "old"))
        if label.where("label <> old").isEmpty():
            return label.select("id", "label")


def _numbered(label: DataFrame) -> DataFrame:
    """id and cluster: the rank of its label."""
    if "cluster" in label.columns:
        return label.select("id", "cluster")
    ranks = ranked(label.select("label").distinct(), [F.col("label")], "cluster").select("label", F.col("cluster").cast("int"))
    return label.join(_cut(ranks), "label").select("id", "cluster")


def _count_of(cluster: DataFrame) -> int:
    return cluster.agg(F.coalesce(F.max("cluster") + 1, F.lit(0))).first()[0]


@dataclass(frozen=True)
class Dbscan:
    """Density clusters.  A row's neighbours are those within eps, itself included; min_samples of them make it a core.

    Clusters are numbered by their first core row; a border row joins the lowest-numbered cluster in
    reach; noise has a null label.
    """

    eps: float
    min_samples: int = 5

    def __post_init__(self):
        if not math.isfinite(self.eps) or self.eps <= 0:
            raise errors.InvalidEps(value=self.eps)
        if self.min_samples < 1:
            raise errors.InvalidMinSamples(value=self.min_samples)

    def fit(self, data: Dataset) -> "FittedDbscan":
        """Rows that are equal in all features are one point with a weight."""
        data.validate()
        xs = [f"x{i}" for i in range(data.n_features)]
        named = data.df.select(data.row.alias("row"), *[x.alias(c) for x, c in zip(data.xs, xs)])
        points = _cut(named.groupBy(*xs).agg(F.min("row").alias("id"), F.count("*").alias("w")))
        labels, n_clusters = self._by_cells(points, xs) if len(xs) <= GRID else self._by_pairs(points, xs)
        return FittedDbscan(_cut(named.join(labels, xs).select("row", "cluster")), n_clusters)

    def _within(self, xs: list[str]) -> Column:
        return total([(F.col(c) - F.col(f"y{i}")) * (F.col(c) - F.col(f"y{i}")) for i, c in enumerate(xs)]) <= self.eps * self.eps

    def _by_cells(self, points: DataFrame, xs: list[str]) -> tuple[DataFrame, int]:
        """Clusters of points of up to GRID features, without lists of pairs of points.

        Points meet by cells so small that points of one cell are always neighbours.  All points of a cell
        that weighs min_samples are cores; only points of lighter cells, of which each holds fewer than
        min_samples, are compared with those around them.  The graph is one of cells: the cores of a cell are
        in one cluster, and two cells are linked if two cores of theirs are neighbours.  Extreme cores of
        either cell show most links; only cells whose boxes are near each other, and which are not in one
        cluster by then, are compared by their cores that are near the other's box.
        """
        p = len(xs)
        side, reach = self.eps / math.sqrt(p) * (1 - 1e-6), 2
        offsets = list(itertools.product(range(-reach, reach + 1), repeat=p))
        ys = [F.col(c).alias(f"y{i}") for i, c in enumerate(xs)]

        def around(df: DataFrame, steps: list[tuple[int, ...]]) -> DataFrame:
            """df with a row for each of the cells around its own."""
            each = F.array(*[F.array(*[F.lit(v).cast("long") for v in t]) for t in steps])
            return df.withColumn("_step", F.explode(each)).withColumn("cell", F.zip_with("cell", "_step", lambda u, v: u + v)).drop("_step")

        placed = points.withColumn("cell", F.array(*[F.floor(F.col(c) / side) for c in xs]))
        crowded = placed.groupBy("cell").agg(F.sum("w").alias("n")).where(F.col("n") >= self.min_samples).select("cell", F.lit(True).alias("crowded"))
        marked = _cut(placed.join(crowded, "cell", "left"))
        met = around(marked.where("crowded is null").select("id", "cell", *xs), offsets).join(marked.select("cell", "w", *ys), "cell").where(self._within(xs))
        counted = met.groupBy("id").agg(F.sum("w").alias("n")).where(F.col("n") >= self.min_samples).select("id", F.lit(True).alias("counted"))
        known = _cut(marked.join(counted, "id", "left").withColumn("core", F.coalesce("crowded", "counted", F.lit(False))).drop("crowded", "counted"))
        cores = known.where("core").select("id", "cell", *xs)

        at = F.array(*map(F.col, xs))
        extremes = F.array(*[by(at, F.col(c)) for c in xs for by in (F.min_by, F.max_by)])
        boxes = _cut(cores.groupBy("cell").agg(F.min("id").alias("id"), F.array(*[F.min(c) for c in xs]).alias("low"), F.array(*[F.max(c) for c in xs]).alias("high"), extremes.alias("ends")))

        def gap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
            """Whether two boxes are within eps of each other."""
            apart = [F.greatest(F.lit(0.0), other_low[i] - high[i], low[i] - other_high[i]) for i in range(p)]
            return total([d * d for d in apart]) <= self.eps * self.eps

        others = boxes.select("cell", F.col("cell").alias("b_cell"), F.col("id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in ("low", "high", "ends")])
        start = around(boxes.withColumn("a_cell", F.col("cell")), [t for t in offsets if t > (0,) * p])
        near = start.join(others, "cell").where(gap(*map(F.col, ("low", "high", "b_low", "b_high"))))
        touch = F.exists("ends", lambda u: F.exists("b_ends", lambda v: total([(u[i] - v[i]) * (u[i] - v[i]) for i in range(p)]) <= self.eps * self.eps))
        near = _cut(near.select("a_cell", "b_cell", "id", "other", "low", "high", "b_low", "b_high", touch.alias("touch")))
        alone = boxes.select("id", F.col("id").alias("other"))
        sure = near.where("touch").select("id", "other")

        def labelled(links: DataFrame) -> DataFrame:
            return _least_labels(_cut(links.union(links.select("other", "id")).union(alone)))

        label = labelled(sure)
        of = label.select("id", "label")
        # of one feature the extremes are the boxes, so that all near cells touch
        unsure = near.where("not touch").join(of, "id").join(of.withColumnsRenamed({"id": "other", "label": "b_label"}), "other").where("label <> b_label")
        unsure = _cut(unsure.select("a_cell", "b_cell", "id", "other", "low", "high", "b_low", "b_high")) if p > 1 else None
        if unsure is not None and not unsure.isEmpty():
            one = unsure.withColumn("cell", F.col("a_cell")).join(cores.select("cell", *xs), "cell").where(gap(at, at, F.col("b_low"), F.col("b_high"))).select("id", "other", *xs)
            two = unsure.withColumn("cell", F.col("b_cell")).join(cores.select("cell", *xs), "cell").where(gap(at, at, F.col("low"), F.col("high"))).select("id", "other", *ys)
            label = labelled(sure.union(one.join(two, ["id", "other"]).where(self._within(xs)).select("id", "other").distinct()))
        cell = _cut(boxes.select("cell", "id").join(_numbered(label), "id").select("cell", "cluster"))
        of_core = cores.join(cell, "cell")
        reached = around(known.where("not core").select("id", "cell", *xs), offsets).join(of_core.select("cell", "cluster", *ys), "cell").where(self._within(xs)).groupBy("id").agg(F.min("cluster").alias("cluster"))
        border = known.where("not core").select("id", *xs).join(reached, "id", "left")
        return of_core.select(*xs, "cluster").union(border.select(*xs, "cluster")), _count_of(cell)

    def _by_pairs(self, points: DataFrame, xs: list[str]) -> tuple[DataFrame, int]:
        """Clusters of points of more features, which meet by cells of eps in the first GRID of them.

        Pairs of neighbours are written: their number is that of the points by their mean number of neighbours.
        """
        p = len(xs)
        cell = [F.floor(F.col(c) / self.eps).alias(f"g{i}") for i, c in enumerate(xs[:GRID])]
        left = points.select("id", *xs, *cell)
        steps = [F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(t)]) for t in itertools.product((-1, 0, 1), repeat=GRID)]
        right = points.select(F.col("id").alias("other"), "w", *[F.col(c).alias(f"y{i}") for i, c in enumerate(xs)], *cell, F.explode(F.array(*steps)).alias("s"))
        right = right.select("other", "w", *[f"y{i}" for i in range(p)], *[(F.col(f"g{i}") + F.col(f"s.s{i}")).alias(f"g{i}") for i in range(GRID)])
        pairs = _cut(left.join(right, [f"g{i}" for i in range(GRID)]).where(self._within(xs)).select("id", "other", "w"))
        cores = pairs.groupBy("id").agg(F.sum("w").alias("n")).where(F.col("n") >= self.min_samples).select("id")
        label = _least_labels(_cut(pairs.join(cores, "id").join(cores.withColumnRenamed("id", "other"), "other").select("id", "other")))
        core = _numbered(label)
        reached = pairs.join(core.withColumnsRenamed({"id": "other"}), "other").groupBy("id").agg(F.min("cluster").alias("reached"))
        return points.join(core, "id", "left").join(reached, "id", "left").select(*xs, F.coalesce("cluster", "reached").alias("cluster")), _count_of(core)


@dataclass(frozen=True)
class FittedDbscan:
    """labels: row and cluster (null: noise)."""

    labels: DataFrame
    n_clusters: int

    def n_noise_points(self) -> int:
        return self.labels.where("cluster is null").count()


# --- Gaussian mixtures -----------------------------------------------------------------------------

FLOOR = 1e-12


def _log_densities(m: np.ndarray, weights: np.ndarray, means: np.ndarray, rotations: list[tuple[np.ndarray, float]]) -> np.ndarray:
    out = []
    for w, mean, (rotate, log_det) in zip(weights, means, rotations):
        z = (m - mean) @ rotate
        out.append(np.log(w) - 0.5 * (m.shape[1] * LOG_2PI + log_det + (z * z).sum(1)))
    return np.stack(out, 1)


def _rotations(covs: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """For each covariance what whitens a row, and its log determinant."""
    out = []
    for c in covs:
        values, vectors = np.linalg.eigh(c)
        values = np.maximum(values, FLOOR)
        out.append((vectors / np.sqrt(values), float(np.log(values).sum())))
    return out


@dataclass(frozen=True)
class GaussianMixture:
    """Full covariances by expectation and maximisation, begun from k-means.

    Stops when the mean log likelihood moves by less than the tolerance; the reported one belongs to
    the parameters before the last step.
    """

    n_components: int
    max_iterations: int = 100
    tolerance: float = 1e-3
    reg_covar: float = 1e-6
    seed: int = 42

    def __post_init__(self):
        if self.n_components < 1:
            raise errors.InvalidComponentCount(value=self.n_components)
        check_iterations(self.max_iterations)
        check_tolerance(self.tolerance)
        if not math.isfinite(self.reg_covar) or self.reg_covar < 0:
            raise errors.InvalidRegularization(value=self.reg_covar)

    def fit(self, data: Dataset) -> "GaussianMixtureModel":
        n = data.validate()
        k, p = self.n_components, data.n_features
        if n < k:
            raise errors.InsufficientSamples(required=k, actual=n)
        start = KMeans(k, seed=self.seed).fit(data)
        frame = data.df.select(*[x.alias(f"x{i}") for i, x in enumerate(data.xs)]).persist()
        size = k * (1 + p + p * p) + 1
        try:
            columns = [F.col(c) for c in frame.columns]
            # sums are taken around the overall mean, so that second moments keep their digits
            _, shift, overall = moments(frame, columns)
            centres = np.array(start.centres)

            def hard(m: np.ndarray) -> np.ndarray:
                return np.eye(k)[np.stack([((m - c) ** 2).sum(1) for c in centres], 1).argmin(1)]

            def gathered(m: np.ndarray, resp: np.ndarray, likelihood: float) -> np.ndarray:
                d = m - shift
                return np.concatenate([resp.sum(0), (resp.T @ d).ravel(), np.stack([(d * resp[:, [j]]).T @ d for j in range(k)]).ravel(), [likelihood]])

            def maximise(sums: np.ndarray, first: bool):
                nk = sums[:k]
                s1, s2 = sums[k : k + k * p].reshape(k, p), sums[k + k * p : -1].reshape(k, p, p)
                eye = self.reg_covar * np.eye(p)
                weights, means, covs = [], [], []
                for j in range(k):
                    if first and nk[j] == 0:
                        weights.append(1 / k)
                        means.append(shift)
                        covs.append(overall + eye)
                        continue
                    m = max(nk[j], FLOOR)
                    mean = s1[j] / m
                    weights.append(m / n)
                    means.append(mean + shift)
                    covs.append(s2[j] / m - np.outer(mean, mean) + eye)
                weights = np.array(weights)
                return weights / weights.sum(), np.array(means), np.array(covs)

            weights, means, covs = maximise(sum_over(frame, columns, lambda m: gathered(m, hard(m), 0.0), size), True)
            before, likelihood, converged, rounds = -math.inf, -math.inf, False, 0
            while rounds < self.max_iterations and not converged:
                rounds += 1
                w, mu, rot = weights, means, _rotations(covs)

                def step(m: np.ndarray) -> np.ndarray:
                    logs = _log_densities(m, w, mu, rot)
                    top = logs.max(1, keepdims=True)
                    norm = top[:, 0] + np.log(np.exp(logs - top).sum(1))
                    return gathered(m, np.exp(logs - norm[:, None]), float(norm.sum()))

                sums = sum_over(frame, columns, step, size)
                likelihood = sums[-1] / n
                weights, means, covs = maximise(sums, False)
                converged = abs(likelihood - before) < self.tolerance
                before = likelihood
        finally:
            frame.unpersist()
        return GaussianMixtureModel(data.features, list(range(k)), tuple(weights.tolist()), tuple(tuple(m.tolist()) for m in means), tuple(tuple(tuple(r) for r in c.tolist()) for c in covs), float(likelihood), rounds, converged)


@dataclass(frozen=True)
class GaussianMixtureModel(Classifier):
    features: tuple[str, ...]
    classes: list
    weights: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    covariances: tuple
    log_likelihood: float
    iterations: int
    converged: bool

    def joint(self, xs: list[Column]) -> list[Column]:
        out = []
        for w, mean, (rotate, log_det) in zip(self.weights, self.means, _rotations(np.array(self.covariances))):
            centred = [x - number(m) for x, m in zip(xs, mean)]
            z = [dot(centred, rotate[:, j]) for j in range(rotate.shape[1])]
            out.append(number(math.log(w) - 0.5 * (len(xs) * LOG_2PI + log_det)) - 0.5 * total([v * v for v in z]))
        return out

    def probability(self, xs: list[Column]) -> Column:
        return softmax(F.array(*self.joint(xs)))

    def score_samples(self, data: Dataset | DataFrame, output: str = "log_density") -> DataFrame:
        df, xs = self.inputs(data)
        logs = F.array(*self.joint(xs))
        top = F.array_max(logs)
        return df.withColumn(output, top + F.log(F.aggregate(logs, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


