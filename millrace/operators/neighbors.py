"""Exact nearest neighbours, and the classifier and regressor made of them.

Training rows are split at medians into leaves with boxes; a query is compared with the rows of the
leaves whose boxes are not farther than its k-th neighbour.  Of rows that are equal in all features
only the first k by id can be among the k nearest, so no more of them are held.  Up to BROADCAST_CELLS
numbers of training data go to every task.  Beyond, training rows are dealt to cells of space, and each
query to the cells that can hold its neighbours; k rows a query and cell are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import errors
from ..dataset import Dataset, check_width, col
from ..functions.expressions import finite
from .base import Estimator

BROADCAST_CELLS = 4_000_000
#: Numbers of training data in a cell of space, and of queries that meet it in one task.
BLOCK_CELLS = 400_000
#: Cells there are at most, and rows a cell in the sample whose medians part them; every row is dealt.
MAX_BLOCKS, SAMPLE_ROWS = 4096, 64
#: Rows of a leaf; numbers in a matrix of queries by leaves; found rows that are held before they are merged.
LEAF_ROWS, GAPS, HELD = 256, 1 << 21, 1 << 20


def _halves(x: np.ndarray, most: int) -> tuple[list[np.ndarray], list[tuple[int, float, int, int]]]:
    """Places of x's rows in leaves of at most `most`, cut at medians of the widest column, and the cuts.

    A cut is a column, the greatest value on its left, and what is on either side: another cut, or -1 - a leaf.
    """
    leaves: list[np.ndarray] = []
    cuts: list[tuple[int, float, int, int]] = []
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        at, above, side = todo.pop()
        here = -1 - len(leaves)
        if len(at) > most:
            j = int(np.argmax(np.ptp(x[at], axis=0)))
            middle = len(at) // 2
            at = at[np.argpartition(x[at, j], middle - 1)]
            here = len(cuts)
            cuts.append((j, float(x[at[middle - 1], j]), 0, 0))
            todo += [(at[middle:], here, 3), (at[:middle], here, 2)]
        else:
            leaves.append(at)
        if above >= 0:
            cut = list(cuts[above])
            cut[side] = here
            cuts[above] = tuple(cut)
    return leaves, cuts


def _gaps(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances of queries from boxes, rounded as those of rows are: none is above that of a row in the box."""
    d = np.zeros((len(queries), len(low)))
    for j in range(low.shape[1]):
        q = queries[:, j][:, None]
        d += np.maximum(np.maximum(low[:, j] - q, q - high[:, j]), 0.0) ** 2
    return np.sqrt(d)


@dataclass(frozen=True)
class _Tree:
    """Training rows by leaves: places in the table, ranks of ids, features, first rows of leaves, and boxes."""

    places: np.ndarray
    order: np.ndarray
    x: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(x: np.ndarray, order: np.ndarray, k: int) -> "_Tree":
        alike = np.lexsort((order, *x.T))
        new = np.append(True, (x[alike[1:]] != x[alike[:-1]]).any(1))
        first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        kept = alike[np.arange(len(x)) - first < k]
        leaves, _ = _halves(x[kept], max(LEAF_ROWS, 2 * k))  # halves of more hold k rows or more
        places = kept[np.concatenate(leaves)]
        low, high = (np.array([f(x[kept[leaf]], axis=0) for leaf in leaves]) for f in (np.min, np.max))
        return _Tree(places, order[places], x[places], np.cumsum([0, *map(len, leaves)]), low, high)

    def _distances(self, leaf: int, queries: np.ndarray) -> np.ndarray:
        rows = self.x[self.starts[leaf] : self.starts[leaf + 1]]
        d = np.zeros((len(queries), len(rows)))
        for j in range(rows.shape[1]):
            d += (queries[:, j][:, None] - rows[:, j][None, :]) ** 2
        return np.sqrt(d)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest training rows, ties by `order`."""
        k = min(k, len(self.x))
        at_once = max(1, min(GAPS // len(self.low), GAPS // (4 * max(LEAF_ROWS, 2 * k))))
        found = [self._nearest(queries[lo : lo + at_once], k) for lo in range(0, len(queries), at_once)]
        places, distances = (np.concatenate(f) for f in zip(*found))
        return places.reshape(-1, k), distances.reshape(-1, k)

    def _nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        gaps = _gaps(self.low, self.high, queries)
        home, bound = gaps.argmin(1), np.empty(len(queries))
        for leaf in np.unique(home):
            asked = np.flatnonzero(home == leaf)
            bound[asked] = np.partition(self._distances(leaf, queries[asked]), k - 1, axis=1)[:, k - 1]
        near = (gaps <= bound[:, None]).T
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            asked, rows, d = (np.concatenate(h) for h in zip(*held))
            by = np.lexsort((self.order[rows], d, asked))
            asked, rows, d = asked[by], rows[by], d[by]
            first = np.searchsorted(asked, asked)
            kept = np.arange(len(asked)) - first < k
            return asked[kept], rows[kept], d[kept]

        for leaf in np.flatnonzero(near.any(1)):
            asked = np.flatnonzero(near[leaf])
            d = self._distances(leaf, queries[asked])
            i, j = np.nonzero(d <= bound[asked][:, None])
            held.append((asked[i], j + self.starts[leaf], d[i, j]))
            n_held += len(i)
            if n_held > HELD:
                held = [merged()]
                n_held = 0
        _, rows, d = merged()
        return self.places[rows], d


def _dealer(cuts: list[tuple[int, float, int, int]]):
    """A function of rows that tells their leaves."""
    if not cuts:
        return lambda x: np.zeros(len(x), np.int64)
    columns, values, lefts, rights = (np.array(c) for c in zip(*cuts))

    def leaf(x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            c = at[inner]
            at[inner] = np.where(x[inner, columns[c]] <= values[c], lefts[c], rights[c])
        return -1 - at

    return leaf


def _by_cells(t: DataFrame, q: DataFrame, n: int, p: int, k: int, schema: str, features, tree_of, rows) -> DataFrame:
    """The k nearest rows of each query among those of each cell that it is dealt to.

    A query goes to every cell that is not farther than r, where cells within r as a whole hold k rows.
    """
    xs = [f"x{i}" for i in range(p)]
    size = max(2 * k, BLOCK_CELLS // p)
    blocks = min(MAX_BLOCKS, math.ceil(n / size))
    drawn = t.select(*xs).sample(min(1.0, SAMPLE_ROWS * blocks / n), 42).limit(2 * SAMPLE_ROWS * blocks).toArrow()  # parts space; no row is left out
    x = np.unique(features(drawn, "x"), axis=0)
    _, cuts = _halves(x, max(1, math.ceil(len(x) / blocks)))
    leaf = _dealer(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(leaf(features(b, "x"))))

    first = Window.partitionBy(*xs).orderBy("id")
    kept = t.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= k).drop("_copy")
    dealt = kept.mapInArrow(deal, StructType([*kept.schema.fields, StructField("cell", LongType())])).persist()
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *[F.min(c).alias(f"low_{c}") for c in xs], *[F.max(c).alias(f"high_{c}") for c in xs]).orderBy("cell").toArrow()
    cells, sizes = boxes.column("cell").to_numpy(), boxes.column("n").to_numpy()
    low, high = (np.column_stack([boxes.column(f"{side}_{c}").to_numpy() for c in xs]) for side in ("low", "high"))
    enough = min(k, int(sizes.sum()))
    at_once = max(1, GAPS // len(cells))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with each cell they are dealt to."""
        for whole in batches:
            for lo in range(0, whole.num_rows, at_once):
                b = whole.slice(lo, at_once)
                y = features(b, "q")
                far = np.zeros((len(y), len(cells)))
                for j in range(p):
                    far += np.maximum(np.abs(y[:, j][:, None] - low[:, j]), np.abs(y[:, j][:, None] - high[:, j])) ** 2
                far = np.sqrt(far)
                by = np.argsort(far, axis=1)
                reach = (np.cumsum(sizes[by], axis=1) >= enough).argmax(1)
                r = far[np.arange(len(y)), by[np.arange(len(y)), reach]]
                i, c = np.nonzero(_gaps(low, high, y) <= r[:, None])
                yield b.take(pa.array(i)).append_column("cell", pa.array(cells[c]))

    asked = q.mapInArrow(ask, StructType([*q.schema.fields, StructField("cell", LongType())])).persist()
    # a cell with many queries stands once for each part of them
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).alias("parts"))
    copied = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    spread = asked.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("query", *[f"q{i}" for i in range(p)]), F.col("parts"))).drop("parts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": right.column("query").slice(0, 0), "train_id": left.column("id").slice(0, 0), "target": left.column("target").slice(0, 0), "distance": pa.array([], pa.float64())})
        right = right.combine_chunks()
        return rows(*tree_of(left), right.column("query").chunk(0), features(right, "q"))

    return copied.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(meet, schema)


def nearest_neighbors(train: Dataset, queries: Dataset, k: int, broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """query, rank (from 1), train_id, target and distance of the k nearest training rows of each query.

    The order is by distance and then by the training row's id; both ids are single columns.
    """
    if k < 1:
        raise errors.InvalidNeighborCount(value=k)
    check_width(queries.features, train.n_features)
    n = train.validate()
    if n < k:
        raise errors.InsufficientSamples(required=k, actual=n)
    p = train.n_features
    t = train.df.select(train.row.alias("id"), (train.y if train.target else F.lit(None).cast("string")).alias("target"), *[x.alias(f"x{i}") for i, x in enumerate(train.xs)])
    q = queries.df.select(queries.row.alias("query"), *[x.alias(f"q{i}") for i, x in enumerate(queries.xs)])
    schema = f"query {q.schema['query'].dataType.simpleString()}, train_id {t.schema['id'].dataType.simpleString()}, target {t.schema['target'].dataType.simpleString()}, distance double"

    def features(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
        return np.column_stack([table.column(f"{name}{i}").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(f"{name}{i}").to_numpy() for i in range(p)])

    def tree_of(table: pa.Table) -> tuple[_Tree, pa.Array, pa.Array]:
        """The tree of a table's rows, and the ids and targets of those it keeps, in its order."""
        ids = table.column("id").combine_chunks()
        tree = _Tree.of(features(table, "x"), np.argsort(np.asarray(pa.compute.sort_indices(ids)), kind="stable"), k)
        kept = table.select(["id", "target"]).take(pa.array(tree.places)).combine_chunks()
        ids, targets = (c.combine_chunks() for c in kept.columns)
        ids, targets = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, targets))
        return replace(tree, places=np.arange(len(tree.places))), ids, targets

    def rows(tree: _Tree, ids: pa.Array, targets: pa.Array, asked: pa.Array, y: np.ndarray) -> pa.Table:
        places, distances = tree.nearest(y, k)
        flat = pa.array(places.ravel())
        return pa.table({"query": asked.take(pa.array(np.repeat(np.arange(len(y)), places.shape[1]))), "train_id": ids.take(flat), "target": targets.take(flat), "distance": distances.ravel()})

    if n * max(p, 1) <= broadcast_cells:
        held = train.df.sparkSession.sparkContext.broadcast(tree_of(t.toArrow()))  # broadcast_cells numbers at most

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from rows(*held.value, b.column(0), features(b, "q")).to_batches()

        found = q.mapInArrow(work, schema)
    else:
        found = _by_cells(t, q, n, p, k, schema, features, tree_of, rows)
    order = Window.partitionBy("query").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "train_id", "target", "distance")


def _weighted(near: DataFrame, weighting: str) -> DataFrame:
    """near with w: 1, or 1 / distance; a query with a neighbour at 1e-12 or less gives all weight to the first one."""
    if weighting == "uniform":
        return near.withColumn("w", F.lit(1.0))
    first = Window.partitionBy("query")
    touching = F.min(F.when(F.col("distance") <= 1e-12, F.col("rank"))).over(first)
    return near.withColumn("w", F.when(touching.isNotNull(), (F.col("rank") == touching).cast("double")).otherwise(1 / F.greatest("distance", F.lit(1e-300))))


@dataclass(frozen=True)
class _Neighbors(Estimator):
    n_neighbors: int = 5
    weighting: str = "uniform"

    def __post_init__(self):
        if self.n_neighbors < 1:
            raise errors.InvalidNeighborCount(value=self.n_neighbors)


@dataclass(frozen=True)
class KNeighborsClassifier(_Neighbors):
    """The label of the greatest weight among the k nearest; of equal ones the smallest label."""

    def fit(self, data: Dataset) -> "NeighborsModel":
        n = data.validate()
        if n < self.n_neighbors:
            raise errors.InsufficientSamples(required=self.n_neighbors, actual=n)
        return NeighborsModel(data, self.n_neighbors, self.weighting, True)


@dataclass(frozen=True)
class KNeighborsRegressor(_Neighbors):
    """The weighted mean of the k nearest targets."""

    def fit(self, data: Dataset) -> "NeighborsModel":
        n = data.validate(finite_target=True)
        if n < self.n_neighbors:
            raise errors.InsufficientSamples(required=self.n_neighbors, actual=n)
        return NeighborsModel(data, self.n_neighbors, self.weighting, False)


@dataclass(frozen=True)
class NeighborsModel:
    data: Dataset
    n_neighbors: int
    weighting: str
    classify: bool

    def predict(self, data: Dataset, output: str = "prediction") -> DataFrame:
        """data with predictions, joined by its row id."""
        near = _weighted(nearest_neighbors(self.data, data, self.n_neighbors), self.weighting)
        if self.classify:
            votes = near.groupBy("query", "target").agg(F.sum("w").alias("w"))
            best = votes.groupBy("query").agg(F.min(F.struct((-F.col("w")).alias("less"), "target")).alias("best"))
            made = best.select("query", F.col("best.target").alias(output))
        else:
            mean = F.sum(F.col("w") * F.col("target").cast("double")) / F.sum("w")
            made = near.groupBy("query").agg(mean.alias(output))
            made = made.withColumn(output, F.when(finite(col(output)), col(output)).otherwise(F.raise_error(F.lit("NonFinitePrediction")).cast("double")))
        return data.df.join(made, data.row == F.col("query")).drop("query")
