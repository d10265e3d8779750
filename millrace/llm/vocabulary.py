"""Counts of terms over a whole corpus, and joining them back to documents.

Terms follow a Zipf law: a few stand in nearly every document, most in hardly any.  Joining documents
with term statistics by shuffling every (document, term) pair moves the corpus several times over and
sends a common term's rows to one task.  Here the most frequent terms, `hot` of them at most, are
broadcast and looked up where the documents are read; only the others, each of them rare by
construction, are shuffled.  The split is exact: every occurrence goes one way or the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import serve, slices

#: Terms that are broadcast at most; a few MB.
HOT_TERMS = 1 << 18

#: Distinct terms that a task holds before it passes its counts on.
TASK_TERMS = 400_000


def count_terms(df: DataFrame, terms: Callable[[pa.RecordBatch], Iterator[list]], binary: bool) -> DataFrame:
    """term and n: how often each term stands in all of df.

    terms gives a batch's texts as lists of terms (bytes if binary, else str).  Counts are summed in
    each task before the shuffle.
    """
    kind = pa.binary() if binary else pa.string()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("counting")
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(counts)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([counts[k] for k in part], pa.int64())], names=["term", "n"])
            counts.clear()

        for b in slices(batches):
            for ws in terms(b):
                counts.update(ws)
                if len(counts) > TASK_TERMS:
                    yield from out()
        yield from out()

    made = df.mapInArrow(work, f"term {'binary' if binary else 'string'}, n long")
    return made.groupBy("term").agg(F.sum("n").alias("n"))


def hot_bound(vocabulary: DataFrame, most: int = HOT_TERMS) -> int:
    """The least count that at most `most` terms reach."""
    # counts are gathered by eighths of a power of two: some hundred rows
    step = F.floor(F.log2("n") * 8).cast("int")
    bound, total = None, 0
    rows = vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("terms"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    for r in rows:
        total += r["terms"]
        if total > most:
            break
        bound = r["least"]
    return bound if bound is not None else (rows[0]["least"] if rows and rows[0]["terms"] <= most else 1 << 62)


def hot_terms(vocabulary: DataFrame, value: str, bound: int) -> dict:
    """Terms with a count of bound or more, and their value; HOT_TERMS of them at most."""
    rows = vocabulary.where(F.col("n") >= bound).select("term", value).toArrow()
    keys = rows.column(0).to_pylist()
    return dict(zip(keys, rows.column(1).to_pylist()))
