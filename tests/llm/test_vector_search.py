"""Operator 9: recall and exact scores against brute force, ties, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import vector_search as vs


def brute(rows, queries, k):
    """rows and queries: (id, vector); k nearest of each query by distance, then id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
        by = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in by]
    return out


def gathered(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("rows_per_shard", [16_384, 130])
def test_recall_on_table(spark, rows_per_shard):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = df.where("vec_id % 20 = 0")
    got = gathered(vs.nearest(df, queries, rows_per_shard=rows_per_shard))
    want = brute(df.select("vec_id", "embedding").collect(), queries.select("vec_id", "embedding").collect(), 10)
    assert got.keys() == want.keys()
    found = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) / 10
    assert found >= 0.95
    exact = {(q, i): s for q, rows in brute(df.select("vec_id", "embedding").collect(), queries.select("vec_id", "embedding").collect(), 10**6).items() for i, s in rows}
    assert all(np.isclose(exact[q, i], s, rtol=1e-12) for q, rows in got.items() for i, s in rows)
    assert all(rows == sorted(rows, key=lambda r: (r[1], r[0])) for rows in got.values())


def test_recall_on_random_vectors():
    x = np.random.default_rng(4).normal(size=(4000, 24)).astype(np.float32)
    graph, entry = vs.build_graph(x)
    assert (graph >= 0).sum(1).min() > 0 and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in graph)
    q = np.random.default_rng(5).normal(size=(100, 24)).astype(np.float32)
    found, _ = vs.beam_search(x, (x * x).sum(1), graph, entry, q, 96)
    truth = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(t)) for f, t in zip(found, truth)]) / 10 >= 0.9


def test_ties_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [float(i), 5.0]) for i in range(5)]
    rows += [(200, None), (201, [0.0, 0.0]), (202, [nan, 1.0]), (203, [inf, 1.0]), (204, [1.0, None]), (205, []), (206, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (207, [-0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    asked = df.where("vec_id in (0, 7, 102, 200, 201, 202, 206) or vec_id is null")
    for per in (1000, 20):
        got = gathered(vs.nearest(df, asked, k=10, rows_per_shard=per))
        clean = [(i, v) for i, v in rows if i is not None and i not in range(200, 207)]
        assert got == brute(clean, [(i, v) for i, v in clean if i in (0, 7, 102)], 10)


@pytest.mark.parametrize("per_block", [1 << 17, 7])
def test_vectors_of_several_lengths(spark, per_block):
    """Each is searched among those of its own length."""
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=2 + i % 3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for per in (1000, 10):
        index, _ = vs.build_index(df, rows_per_shard=per)
        got = gathered(vs.search(index, df.where("vec_id < 60"), k=5, per_block=per_block))
        for n in (2, 3, 4):
            mine = [x for x in rows if len(x[1]) == n]
            want = brute(mine, [x for x in mine if x[0] < 60], 5)
            assert {q: v for q, v in got.items() if q in want} == want
        assert len(got) == 60


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0])], schema)
    assert vs.nearest(one, one).count() == 0
    two = spark.createDataFrame([(1, [1.0]), (2, [4.0]), (2, [4.0])], schema)
    assert [tuple(r) for r in vs.nearest(two, two).orderBy("query_id", "rank").collect()] == [(1, 1, 2, 3.0), (1, 2, 2, 3.0), (2, 1, 1, 3.0)]
    none = one.limit(0)
    assert vs.nearest(none, none).count() == 0 and vs.nearest(one, none).count() == 0 and vs.nearest(none, one).count() == 0
