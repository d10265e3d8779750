"""Operator 9: approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of about ROWS_PER_SHARD by their ids' hashes, those of each length to shards
of their own, as a distance is defined between vectors of one length only.  In a shard equal vectors
are one node, which remembers its ids.  The graph is built in batches: a greedy beam search from the
medoid proposes neighbours for each new node from what it visited; robust pruning keeps the nearest
and drops every candidate that is nearer to a kept one, by a relaxed factor ALPHA, than to the node;
edges back are added, and lists that grow too long are pruned in the same way.  A search walks each
shard's graph with a beam and takes the exact distance, in double precision, of what it found; the
best of all shards are the result.

All steps run for many nodes or queries at a time.  Indexes are rows of a table, so a lost executor
costs no more than the tasks it ran.  Queries move to the shards: in a task a shard's graph comes first
and queries pass it batch by batch, so that memory holds one graph, whatever the number of queries.  Only
beyond QUERIES_PER_BLOCK queries does a second task get a copy of the graph.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, text_column, write_result, write_table

ROWS_PER_SHARD = 16_384
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 56, 192, 1.2
#: Nodes of the beam whose neighbours are looked at in one step.
WIDTH = 4
BATCH = 512
#: Partitions at most in which shards and queries meet; with more shards, a task serves several, one after another.
MOST_PARTS = 20_000
QUERIES_PER_BLOCK = 1 << 17


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances, less the query's own square, of the `beam` nearest found, nearest first; -1 fills up."""
    n, b = len(x), len(q)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    ids[:, 0] = entry
    dist[:, 0] = norms[entry] - 2 * (q @ x[entry])
    done = np.ones((b, beam), bool)
    done[:, 0] = False
    seen = np.zeros((b, n), bool)
    seen[:, entry] = True
    live = np.arange(b)
    while len(live):
        i, d, f = ids[live], dist[live], done[live]
        # the nearest open nodes of each beam; beams are sorted
        rank = np.cumsum(~f, 1)
        take = ~f & (rank <= WIDTH)
        slot = np.where(take, rank - 1, WIDTH)
        opened = np.full((len(live), WIDTH + 1), -1, np.int64)
        np.put_along_axis(opened, slot, np.where(take, i, -1), 1)
        opened = opened[:, :WIDTH]
        f |= take
        around = np.where(opened[:, :, None] >= 0, graph[np.maximum(opened, 0)], -1).reshape(len(live), -1)
        # a node that two opened ones have is taken once
        around.sort(axis=1)
        ok = around >= 0
        ok[:, 1:] &= around[:, 1:] != around[:, :-1]
        rows = live[:, None]
        ok &= ~seen[rows, np.maximum(around, 0)]
        r, c = np.nonzero(ok)
        new = around[r, c]
        seen[live[r], new] = True
        found = np.full(around.shape, np.inf, np.float32)
        found[r, c] = norms[new] - 2 * np.einsum("kd,kd->k", q[live[r]], x[new])
        all_d = np.concatenate([d, found], 1)
        all_i = np.concatenate([i, np.where(ok, around, -1)], 1)
        all_f = np.concatenate([f, ~ok], 1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), axis=1, kind="stable"), 1)
        ids[live], dist[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_i, all_d, all_f))
        live = live[~done[live].all(1)]
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node its neighbours among its candidates (-1: none), `degree` at most."""
    b, k = candidates.shape
    out = np.full((b, degree), -1, np.int32)
    at = np.maximum(candidates, 0)
    vectors = x[at]
    far = ((vectors - x[nodes][:, None, :]) ** 2).sum(2)
    far[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    at = np.take_along_axis(at, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    far[:, 1:][at[:, 1:] == at[:, :-1]] = np.inf
    norms = (vectors**2).sum(2)
    rows = np.arange(b)
    open_ = np.isfinite(far)
    a2 = np.float32(alpha * alpha)
    for j in range(degree):
        first = open_.argmax(1)
        have = open_[rows, first]
        if not have.any():
            break
        out[have, j] = at[rows, first][have]
        kept = vectors[rows, first]
        between = norms + (kept**2).sum(1)[:, None] - 2 * np.einsum("bd,bkd->bk", kept, vectors, optimize=True)
        open_ &= (a2 * between > far) & have[:, None]
        open_[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Neighbours of each of the distinct vectors x, and the node where searches enter."""
    n = len(x)
    norms = (x * x).sum(1)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(0).permutation(n)
    order = order[order != entry]
    at, size = 0, 1
    while at < len(order):
        nodes = order[at : at + size]
        at += len(nodes)
        size = min(BATCH, size * 2)
        found, _ = beam_search(x, norms, graph, entry, x[nodes], beam)
        # nodes of one batch do not see one another in the graph yet: some of them are proposed as well
        peers = np.broadcast_to(nodes, (len(nodes), len(nodes)))
        if len(nodes) > 1:
            inner = norms[nodes][None, :] - 2 * (x[nodes] @ x[nodes].T)
            np.fill_diagonal(inner, np.inf)
            near = np.argpartition(inner, min(8, len(nodes) - 1) - 1, axis=1)[:, : min(8, len(nodes) - 1)]
            found = np.concatenate([found, np.take_along_axis(peers, near, 1)], 1)
        graph[nodes] = robust_prune(x, nodes, found, degree, alpha)
        # edges back
        to = graph[nodes].ravel()
        from_ = np.repeat(nodes, degree)[to >= 0]
        to = to[to >= 0]
        by = np.argsort(to, kind="stable")
        to, from_ = to[by], from_[by]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        targets, counts = to[first], np.diff(np.append(first, len(to)))
        have = (graph[targets] >= 0).sum(1)
        for lo in range(0, len(targets), BATCH):
            part = slice(lo, lo + BATCH)
            t, c, h = targets[part], counts[part], have[part]
            more = np.full((len(t), int(c.max())), -1, np.int64)
            place = np.arange(int(c.max())) < c[:, None]
            more[place] = from_[first[lo] : first[lo] + int(c.sum())]
            more[(more[:, :, None] == graph[t][:, None, :]).any(2)] = -1
            lists = np.concatenate([graph[t], more], 1)
            full = h + c > degree
            if full.any():
                graph[t[full]] = robust_prune(x, t[full], lists[full], degree, alpha)
            if (~full).any():
                loose = lists[~full]
                graph[t[~full]] = np.take_along_axis(loose, np.argsort(loose < 0, axis=1, kind="stable"), 1)[:, :degree]
    return graph, entry


def _valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, with finite components only, and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v and dim of the rows of df that take part."""
    rows = df.select(F.col(f"`{text_column(df, vec_id)}`").cast("long").alias("id"), F.col(f"`{text_column(df, vector)}`").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & _valid(F.col("v"))).withColumn("dim", F.size("v"))


def build_index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", rows_per_shard: int = ROWS_PER_SHARD, degree: int = DEGREE) -> tuple[DataFrame, str]:
    """A table with one row for each shard's graph, and its path.

    Takes every row with an id and a vector that is not null or zero and has finite components only,
    whatever its length.  Ids are read as longs; one that is none counts as null.
    """
    rows = _vectors(df, vec_id, vector)
    shards = rows.groupBy("dim").agg(F.ceil(F.count("*") / rows_per_shard).cast("long").alias("shards"))  # one row for each length
    schema = "dim int, shard int, ids binary, first binary, vectors binary, graph binary, entry long, degree int"
    kinds = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("ids", "first", "vectors", "graph")), ("entry", pa.int64()), ("degree", pa.int32())])

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, dim = table.column("id").to_numpy(), table.column("dim")[0].as_py()
        exact = table.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        # equal vectors (0.0 and -0.0 are equal) are one node, with its ids in order
        exact = exact + 0.0
        _, node = np.unique(np.ascontiguousarray(exact).view(np.dtype((np.void, 8 * dim))).ravel(), return_inverse=True)
        by = np.lexsort((ids, node))
        first = np.flatnonzero(np.concatenate([[True], node[by][1:] != node[by][:-1]]))
        distinct = exact[by[first]]
        graph, entry = build_graph(distinct.astype(np.float32), degree)
        row = [dim, table.column("shard")[0].as_py(), ids[by].tobytes(), np.append(first, len(ids)).astype(np.int64).tobytes(), distinct.tobytes(), graph.tobytes(), entry, degree]
        return pa.table([[x] for x in row], schema=kinds)

    dealt = rows.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    return write_table(dealt.select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInArrow(build, schema), "graphs")


class _Shard:
    """One shard's graph, as searches use it."""

    def __init__(self, dim: int, ids: bytes, first: bytes, vectors: bytes, graph: bytes, entry: int, degree: int):
        self.ids, self.first = np.frombuffer(ids, np.int64), np.frombuffer(first, np.int64)
        self.exact = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.x = self.exact.astype(np.float32)
        self.norms = (self.x * self.x).sum(1)
        self.graph, self.entry = np.frombuffer(graph, np.int32).reshape(-1, degree), entry

    def nearest(self, asked: np.ndarray, q: np.ndarray, k: int, beam: int) -> list[np.ndarray]:
        """Query id, vector id and distance of the k nearest found of each query, but for rows of its own id."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found, _ = beam_search(self.x, self.norms, self.graph, self.entry, q.astype(np.float32), min(max(beam, k + 1), max(len(self.x), 1)))
        for i, nodes in enumerate(found):
            nodes = nodes[nodes >= 0]
            score = np.sqrt(((self.exact[nodes] - q[i]) ** 2).sum(1))
            # k + 1 ids of each node are enough: one may be the query's own
            members = [self.ids[self.first[p] : min(self.first[p] + k + 1, self.first[p + 1])] for p in nodes.tolist()]
            every = np.concatenate(members)
            each = np.repeat(score, [len(m) for m in members])
            other = every != asked[i]
            every, each = every[other], each[other]
            best = np.lexsort((every, each))[:k]
            out.append((np.full(len(best), asked[i]), every[best], each[best]))
        return [np.concatenate(c) for c in zip(*out)]


def search(index: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", beam: int = SEARCH_BEAM, per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each query, but for rows of the query's own id.

    Queries without a valid vector, or of a length that no vector has, have no rows.  Each query meets
    each shard of its length once; what is compared after that is k rows a query and shard.
    """
    asked = _vectors(queries, vec_id, vector).distinct()
    blocks = max(1, math.ceil(asked.count() / per_block))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    graph = ["ids", "first", "vectors", "graph", "entry", "degree"]
    place = ["dim", "shard", "block"]
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))  # one row for each length
    each = asked.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
    wanted = each.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select(*place, "id", "v", *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in graph])
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*place, F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), *graph)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a place stand together, its graph before its queries."""
        now, shard = None, None
        for b in batches:
            ids = b.column("id").to_pylist()
            places = list(zip(*(b.column(c).to_pylist() for c in place)))
            at = 0
            while at < len(ids):
                if ids[at] is None:
                    now = places[at]
                    shard = _Shard(now[0], *(b.column(c)[at].as_py() for c in graph))
                    at += 1
                    continue
                end = at
                while end < len(ids) and end - at < BATCH and ids[end] is not None and places[end] == now:
                    end += 1
                if end == at:  # a shard that no vector was dealt to
                    at += 1
                    continue
                q = b.column("v").slice(at, end - at).flatten().to_numpy(zero_copy_only=False).reshape(end - at, now[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(shard.nearest(np.array(ids[at:end]), q, k, beam), arrow)], schema=arrow)
                at = end

    # more partitions than places, as places are dealt by hash
    parts = max(1, min(4 * index.count() * blocks, MOST_PARTS))
    together = held.unionByName(wanted).repartition(parts, *place).sortWithinPartitions(*place, F.col("id").asc_nulls_first())
    near = together.mapInArrow(look, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", rows_per_shard: int = ROWS_PER_SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest rows of df, by Euclidean distance, of each query; see build_index and search.

    Ties go to the smaller id.  Repeated ids: rows of a query's own id are no candidates; repeated
    queries are asked once.  Fewer than k candidates give fewer rows, an empty table none.
    """
    index, path = build_index(df, vec_id, vector, rows_per_shard)
    out = write_result(search(index, queries, k, vec_id, vector, beam), "nearest")
    drop_table(df.sparkSession, path)
    return out
