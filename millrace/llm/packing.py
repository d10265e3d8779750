"""Operator 6: packing of token sequences by exact complements, then best fit.

Which lengths go together depends on how many pieces there are of each length, and nothing else, so
the plan is made from a histogram of at most `capacity` counts.  Sums of one, two and three available
lengths are indexed by their value.  From the longest length down, what a piece leaves free is looked
up there, and a combination that fills it exactly is consumed as often as its counts allow.  What finds
none is packed by best fit, longest first: each piece goes to the sequence with the smallest gap that
holds it.

Exact fills waste nothing, but may use up the short pieces that best fit needs at its end.  So some
plans are made, which differ in how long a piece must be to be complemented and how short one may be
to be part of a complement, and plain best fit is the last of them; the one with fewest sequences is
taken.  Each needs no more than the histogram, so that they cost the same whatever the number of rows.

Pieces then get their places by rank among those of equal length.  Ranks come from counts by length
and a hash salt, so that a length that a third of all pieces have is ranked in many tasks.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .common import drop_table, map_batches, serve, slices, text_column, texts, tokenizer_path, write_result, write_table


class SumIndex:
    """Sums of one, two and three available lengths by their value.

    pairs[s] holds the longer length of each pair with sum s, triples[s] the longest of each triple, in
    ascending order.  Counts only go down, so what is found to be used up is dropped for good.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        capacity = len(counts) - 1
        have = np.flatnonzero(counts)
        self.pairs: dict[int, list[int]] = defaultdict(list)
        self.triples: dict[int, list[int]] = defaultdict(list)
        shortest = np.full(capacity + 1, capacity + 1)  # of each sum, the least longer length of a pair
        for a in have.tolist():
            other = have[(have <= a) & (have + a <= capacity)]
            if counts[a] < 2:
                other = other[other < a]
            shortest[a + other] = np.minimum(shortest[a + other], a)
            for s in (a + other).tolist():
                self.pairs[s].append(a)
        for a in have.tolist():
            for s in np.flatnonzero(shortest[: capacity - a + 1] <= a).tolist():
                self.triples[a + s].append(a)

    def _pair(self, total: int, longest: int) -> tuple[int, int] | None:
        listed = self.pairs.get(total, [])
        for i in range(len(listed) - 1, -1, -1):
            a, b = listed[i], total - listed[i]
            if self.counts[b] < 1 or self.counts[a] < 1 + (a == b):
                del listed[i]
            elif a <= longest:
                return a, b
        return None

    def find(self, total: int) -> tuple[int, ...] | None:
        """As few available lengths as sum to total, three at most and longest first; of equally many, the one with the longest first."""
        if self.counts[total]:
            return (total,)
        if found := self._pair(total, total):
            return found
        listed = self.triples.get(total, [])
        while listed:
            a = listed[-1]
            if self.counts[a]:
                self.counts[a] -= 1
                found = self._fresh_pair(total - a, a)
                self.counts[a] += 1
                if found:
                    return (a, *found)
            listed.pop()
        return None

    def _fresh_pair(self, total: int, longest: int) -> tuple[int, int] | None:
        """_pair that leaves the index as it is: the counts are lowered for this look-up alone."""
        for a in reversed(self.pairs.get(total, [])):
            b = total - a
            if a <= longest and self.counts[b] >= 1 and self.counts[a] >= 1 + (a == b):
                return a, b
        return None


def _complemented(counts: np.ndarray, least: int, made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Consume exact complements of lengths from the longest down to `least`; returns what is left, for best fit."""
    capacity = len(counts) - 1
    index = SumIndex(counts)
    left = np.zeros_like(counts)
    for length in range(capacity - 1, least - 1, -1):
        while counts[length]:
            counts[length] -= 1
            found = index.find(capacity - length)
            counts[length] += 1
            if not found:
                # none now, none later: as far as complements go, this length is used up
                left[length], counts[length] = counts[length], 0
                break
            need = Counter((length, *found))
            times = int(min(counts[x] // k for x, k in need.items()))
            made.append(((length, *found), times))
            for x, k in need.items():
                counts[x] -= times * k
    return left + counts


def _best_fit(counts: np.ndarray, made: list[tuple[tuple[int, ...], int]]) -> None:
    """Best fit, longest first, over groups of alike sequences by gap."""
    capacity = len(counts) - 1
    by_gap: dict[int, list[list]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            gap = min((g for g, groups in by_gap.items() if g >= length and groups), default=0)
            if gap:
                group = by_gap[gap].pop()
            else:
                gap, group = capacity, [(), n]
            each = gap // length
            many = min(group[1], n // each)
            if many:
                by_gap[gap - each * length].append([group[0] + (length,) * each, many])
                if group[0] and group[1] > many:
                    by_gap[gap].append([group[0], group[1] - many])
                n -= many * each
            else:
                by_gap[gap - n * length].append([group[0] + (length,) * n, 1])
                if group[0] and group[1] > 1:
                    by_gap[gap].append([group[0], group[1] - 1])
                n = 0
    made += [(tuple(lengths), n) for groups in by_gap.values() for lengths, n in groups]


#: Plans that are made, in 16ths of the capacity: the least length that is complemented, and the least that is part
#: of a complement.  Best fit alone, which complements nothing, is the last.
PLANS = [(0, 0), (0, 1), (0, 4), (8, 0), (8, 4), (12, 0), (16, 0)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences, as lengths in order, and how many sequences have them: the best of PLANS."""
    every = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        every[length] += n
    bound = -(-int((every * np.arange(capacity + 1)).sum()) // capacity)
    best, fewest = [], None
    for least, part in PLANS:
        held, counts, made = every.copy(), every.copy(), []
        held[max(1, part * capacity // 16) :] = 0  # for best fit alone
        counts -= held
        held += _complemented(counts, max(1, least * capacity // 16), made)
        _best_fit(held, made)
        n = sum(n for _, n in made)
        if fewest is None or n < fewest:
            best, fewest = made, n
        if fewest == bound:
            break
    return best


def runs(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of runs of pieces, the sequence of each run's first piece, and their offset."""
    taken: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, n in made:
        offset = 0
        for length in lengths:
            out[length].append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset.  `order` names columns that set pieces apart; pieces equal in them are alike.

    pieces is read twice, so it should be a written table.  An empty table is packed into nothing.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # capacity rows at most
    places = runs(plan(counts, capacity))
    total = sum(counts.values())
    salts = max(1, math.isqrt(total) // 8)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(length, "_salt").count()
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(length, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = (
        salted.withColumn("_row", F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order)))
        .join(bases, [length, "_salt"])
        .withColumn("_rank", F.col("_base") + F.col("_row") - 1)
        .select(*pieces.columns, "_rank")
    )
    schema = T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    spread = pieces.sparkSession.sparkContext.broadcast(places)  # some runs for each of `capacity` lengths

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        size = b.column(b.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
        rank = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        by = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[by], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(by)]):
            at = by[lo:hi]
            first, start, where = spread.value[int(size[at[0]])]
            k = np.searchsorted(first, rank[at], side="right") - 1
            sequence[at] = start[k] + rank[at] - first[k]
            offset[at] = where[k]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    return map_batches(ranked, place, schema)


def cut_pieces(df: DataFrame, capacity: int, tokenizer: str, end_id: int, doc_id: str, text: str, with_ids: bool) -> DataFrame:
    """Pieces of at most `capacity` ids of each text with its end id; a longer text's first piece may be shorter."""
    fields = [T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("byte_bpe")
        for b in slices(batches):
            bpe = byte_bpe(tokenizer_path(tokenizer))
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, packed in enumerate(bpe.encode_batch(texts(b, "text"))):
                all_ids = np.append(np.frombuffer(packed, bpe.dtype), bpe.dtype.type(end_id)).astype("<u4")
                n = len(all_ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                raw = memoryview(all_ids.tobytes())
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(k)
                    piece.append(i)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(raw[4 * lo : 4 * hi]))
                    if with_ids:
                        ids.append(all_ids[lo:hi].astype(np.int32))
            columns = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=schema.fieldNames())

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, schema)


def pack_documents(
    df: DataFrame,
    capacity: int = 1024,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pack every text of df into sequences of at most `capacity` ids; one row a piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the piece's ids.
    A null or empty text is one piece, the end id.  A null id is kept; rows of one id are packed each
    for itself, and equal rows have equal pieces in places of their own.  Other columns are left out.
    """
    spark = df.sparkSession
    cut, path = write_table(cut_pieces(df, capacity, tokenizer, end_id, text_column(df, doc_id), text_column(df, text), with_ids), "pieces")
    packed = write_result(pack(cut, capacity, ["doc_id", "piece", "start", "length", "ids_crc32"]), "packed")
    drop_table(spark, path)
    return packed
