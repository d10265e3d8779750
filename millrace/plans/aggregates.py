"""Aggregates over rows that fits are made of: moments, sums by numpy kernels, a tall-skinny QR, and medians."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many columns second moments are JVM aggregates; beyond, numpy kernels.
NARROW = 16


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    """A batch of double columns as a matrix."""
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]) if batch.num_columns else np.zeros((batch.num_rows, 0))


def sum_over(df: DataFrame, columns: Sequence[Column], kernel: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of kernel(matrix of the columns), a vector of `size` numbers, over all rows.

    Each task sums its own batches; one vector a task is shuffled by place.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                out += kernel(matrix_of(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], names=["place", "v"])

    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    out = np.zeros(size)
    for r in named.mapInArrow(work, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r["place"]] = r["v"]
    return out


def moments(df: DataFrame, columns: Sequence[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means, and covariances divided by the number of rows."""
    p = len(columns)
    if p <= NARROW:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
        row = named.agg(F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(p)], *[F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in pairs]).first()
        cov = np.zeros((p, p))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"s{i}_{j}"] if row["n"] else 0.0
        return row["n"], np.array([row[f"m{i}"] if row["n"] else 0.0 for i in range(p)]), cov
    first = sum_over(df, columns, lambda x: np.append(x.sum(0), len(x)), p + 1)
    n = int(first[-1])
    mean = first[:-1] / max(n, 1)
    second = sum_over(df, columns, lambda x: ((x - mean).T @ (x - mean)).ravel(), p * p)
    return n, mean, second.reshape(p, p) / max(n, 1)


def class_moments(df: DataFrame, label: Column, columns: Sequence[Column], covariances: bool = False) -> dict:
    """For each class: rows, means, population variances, and covariances if asked for."""
    p = len(columns)
    named = df.select(label.alias("label"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = [F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(p)], *[F.var_pop(f"c{i}").alias(f"v{i}") for i in range(p)]]
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)] if covariances else []
    parts += [F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in pairs]
    out = {}
    for r in named.groupBy("label").agg(*parts).orderBy("label").collect():
        cov = np.diag([r[f"v{i}"] for i in range(p)])
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"s{i}_{j}"]
        out[r["label"]] = (r["n"], np.array([r[f"m{i}"] for i in range(p)]), cov)
    return out


def tall_qr(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """The triangular factor of the matrix of the columns.

    Each task reduces its rows to one triangle; triangles meet in a few tasks, whose own are reduced on
    the driver.  What moves is a square of the number of columns for each task.
    """
    p = len(columns)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, p))
        for b in batches:
            if b.num_rows:
                r = np.linalg.qr(np.vstack([r, matrix_of(b)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[:, i])) for i in range(p)], names=[f"c{i}" for i in range(p)])

    schema = ", ".join(f"c{i} double" for i in range(p))
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    first = named.mapInArrow(reduce, schema)
    met = first.repartition(32).mapInArrow(reduce, schema) if named.rdd.getNumPartitions() > 256 else first
    rows = met.toArrow()
    x = np.column_stack([rows.column(i).to_numpy() for i in range(p)]) if rows.num_rows else np.zeros((0, p))
    return np.linalg.qr(x, mode="r") if len(x) else x


def medians(df: DataFrame, columns: list[Column], few: int = 4096) -> list[float | None]:
    """The exact median of each column's values that are not null, as one number or the midpoint of two.

    Each round draws three approximate quantiles near every rank that is looked for, and counts the values
    below and at each of them.  A rank is found at one of them, or lies in an open interval between two,
    which holds some thousandths of the values or fewer.  Values come to the driver once an interval
    holds at most `few` of them.  Each round is two aggregates of all columns together.
    """
    sizes = df.agg(*[F.count(c) for c in columns]).first()
    found: dict[tuple[int, int], float] = {}
    # rank, counted from 0 over the whole column: the open interval that holds it, its size, the values below it
    wanted = {(j, k): (None, None, n, 0) for j, n in enumerate(sizes) if n for k in {(n - 1) // 2, n // 2}}

    def inside(j: int, low: float | None, high: float | None) -> Column:
        x = columns[j]
        tests = [x > F.lit(low)] * (low is not None) + [x < F.lit(high)] * (high is not None)
        return F.when(reduce(lambda a, b: a & b, tests, F.lit(True)), x)

    while wanted:
        ready = {t: w for t, w in wanted.items() if w[2] <= few}
        if ready:
            row = df.agg(*[F.sort_array(F.collect_list(inside(t[0], *w[:2]))) for t, w in ready.items()]).first()
            found |= {t: float(values[t[1] - w[3]]) for (t, w), values in zip(ready.items(), row)}
        wanted = {t: w for t, w in wanted.items() if t not in ready}
        if not wanted:
            break
        shares = {t: [min(1.0, max(0.0, (t[1] - w[3] + 0.5) / w[2] + d)) for d in (-5e-4, 0.0, 5e-4)] for t, w in wanted.items()}
        drawn = df.agg(*[F.percentile_approx(inside(t[0], *w[:2]), shares[t], 10000) for t, w in wanted.items()]).first()
        pivots = {t: sorted(set(values)) for t, values in zip(wanted, drawn)}
        counts = df.agg(*[F.count_if(test) for t, w in wanted.items() for p in pivots[t] for x in [inside(t[0], *w[:2])] for test in (x < F.lit(p), x == F.lit(p))]).first()
        at, still = 0, {}
        for t, (low, high, n, below) in wanted.items():
            k, edges = t[1] - below, [(low, 0)]
            for p in pivots[t]:
                less, same = counts[at], counts[at + 1]
                at += 2
                if less <= k < less + same:
                    found[t] = float(p)
                edges.append((p, less, less + same))
            if t not in found:
                last = max(i for i, e in enumerate(edges) if i == 0 or e[2] <= k)
                start = edges[last][2] if last else 0
                end, upper = (edges[last + 1][1], edges[last + 1][0]) if last + 1 < len(edges) else (n, high)
                still[t] = (edges[last][0], upper, end - start, below + start)
        wanted = still
    return [found[j, (n - 1) // 2] / 2 + found[j, n // 2] / 2 if n else None for j, n in enumerate(sizes)]
