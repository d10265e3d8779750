"""Operator 3: language-model scores by prediction by partial matching (PPM).

Model.  A trie of byte contexts up to `order` long with symbol counts.  A symbol is coded in the
longest context that the model has: with n counted symbols of which d are distinct, a symbol counted
c times has probability c / (n + d), and d / (n + d) is the escape to the next shorter context
(method C).  There, symbols that the longer context has are excluded: they would have been coded
before.  Below the empty context all bytes not yet excluded are equally likely.  The end of a text is
a symbol too, so probabilities of all texts sum to 1.

Pretrained, the counts are those of the training texts, gathered by Spark as n-gram counts, and every
counted context is in the model.  As no count changes while scoring, a symbol's code length depends on
the `order` bytes before it and itself only: it is worked out once for each distinct gram of order + 1
bytes that stands in any text, escapes and exclusions included, by joins with the grams one byte
shorter.  The most frequent grams' code lengths are broadcast and looked up where the texts are read;
the others, each of them rare, are joined.  So the model grows with the corpus, and no task or driver
holds it.  With max_contexts a bounded trie is unrolled once per worker into an automaton instead: a row
for each context with the code length and the next context of each symbol.  Texts are cut into
segments, each preceded by the context it needs, and all segments step through it side by side.
Adaptive, the trie starts empty and learns from the text itself.

A word model stands beside it: for each word, and an end, log10 of an add-one estimate from the
training texts' word counts.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytegrams import EDGE, count_grams, framed, gram_keys
from .common import SLICE_ROWS, drop_table, groups_of, keeps, serve, slices, text_column, texts, write_result, write_table
from .vocabulary import HOT_TERMS, count_terms, hot_bound, hot_terms

ORDER = 5
#: Grams whose code lengths are broadcast at most, 12 MB; those of the others are joined.
HOT_GRAMS = 1 << 20
SEGMENT = 256


class Automaton:
    """A pretrained trie, unrolled.  grams[k] has keys (context of k bytes, symbol) and their counts."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.order = order = len(grams) - 1
        seen = np.unique(grams[0][0]).astype(np.int64)
        self.other, self.pad = len(seen), len(seen) + 1
        self.width = width = len(seen) + 2
        self.classes = np.full(256, self.other, np.uint8)
        self.classes[seen] = np.arange(len(seen))
        contexts = [np.unique(k >> np.uint64(8)) for k, _ in grams]
        if not len(contexts[0]):
            contexts[0] = np.zeros(1, np.uint64)
        first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        n_states = int(first[-1])
        self.cost = np.zeros((n_states, width), np.float32)
        self.next = np.zeros((n_states, width), np.int32)
        after = np.zeros((n_states, width), np.float32)  # code length from here once the longer context has escaped to its suffix
        counts = np.zeros((1, width), np.float32)
        for k in range(order + 1):
            ctx, (keys, n) = contexts[k], grams[k]
            if not len(ctx):
                break
            longer, counts = counts, np.zeros((len(ctx), width), np.float32)
            counts[np.searchsorted(ctx, keys >> np.uint64(8)), self.classes[(keys & np.uint64(255)).astype(np.int64)]] = n
            if k:
                suffix = np.searchsorted(contexts[k - 1], ctx & np.uint64((1 << 8 * (k - 1)) - 1))
            for lo in range(0, len(ctx), 4096):
                part = slice(lo, min(lo + 4096, len(ctx)))
                rows = slice(first[k] + part.start, first[k] + part.stop)
                have = counts[part].astype(np.float64)
                if k:
                    self.next[rows] = self.next[first[k - 1] + suffix[part]]
                    after[rows] = self._escaped(longer[suffix[part]], have > 0, after[first[k - 1] + suffix[part]])
                else:
                    after[rows] = np.log10(np.maximum(256 - (have > 0).sum(1), 1))[:, None]
                self.cost[rows] = self._escaped(have, np.zeros(have.shape, bool), after[rows])
            if k < order and len(deeper := contexts[k + 1]):
                parent = np.minimum(np.searchsorted(ctx, deeper >> np.uint64(8)), len(ctx) - 1)
                hit = np.flatnonzero(ctx[parent] == deeper >> np.uint64(8))
                self.next[first[k] + parent[hit], self.classes[(deeper[hit] & np.uint64(255)).astype(np.int64)]] = first[k + 1] + hit
        self.cost[:, self.pad] = 0

    @staticmethod
    def _escaped(counts: np.ndarray, excluded: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Code lengths in contexts with these counts but for the excluded symbols; shorter: after a further escape.

        A context with nothing left is passed over at no cost.
        """
        counts = counts.astype(np.float64)
        counts[excluded] = 0
        distinct = (counts > 0).sum(1)[:, None]
        whole = counts.sum(1)[:, None] + distinct
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(distinct > 0, np.log10(whole / np.maximum(distinct, 1)), 0.0)
            return np.where(counts > 0, np.log10(whole) - np.log10(counts), escape + shorter)

    def code_lengths(self, data: list[bytes]) -> np.ndarray:
        """Code length of each text and its end, in decimal digits (-log10 of its probability)."""
        k = self.order
        buf, starts = framed(data, k)
        code = np.append(self.classes[buf], np.full(SEGMENT + k, self.pad, np.uint8))
        lengths = np.diff(starts) - k  # bytes and one end
        parts = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(data)), parts)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = starts[:-1][doc] + part * SEGMENT  # where the segment's context begins
        size = np.minimum(SEGMENT, lengths[doc] - part * SEGMENT)
        cost, step, width = self.cost.ravel(), self.next.ravel(), self.width
        state = np.zeros(len(doc), np.int64)
        total = np.zeros(len(doc))
        for i in range(k + int(size.max(initial=0))):
            sym = code[at + i]
            if i >= k:
                sym = np.where(i - k < size, sym, self.pad)
                index = state * width + sym
                total += cost[index]
            else:
                index = state * width + sym
            state = step[index].astype(np.int64)
        return np.bincount(doc, total, len(data))


@lru_cache(maxsize=1)
def _automaton(name: str, holder: "_Held") -> Automaton:
    return Automaton(holder.value)


keeps("ppm", lambda: _automaton.cache_clear())


class _Held:
    """A broadcast with a name of its own, so that a worker unrolls each model once."""

    def __init__(self, broadcast):
        self.id, self.broadcast = uuid.uuid4().hex, broadcast

    def __hash__(self):
        return hash(self.id)

    def __eq__(self, other):
        return self.id == other.id

    @property
    def value(self):
        return self.broadcast.value


def train(df: DataFrame, order: int, max_contexts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of contexts and symbols of df's column text, for Automaton.

    With more than max_contexts contexts, those seen less often than a bound are left out, the bound being
    the least for which the number fits.
    """
    spark = df.sparkSession
    grams, path = write_table(count_grams(df, order + 1), "grams")
    by_order = {k: (grams if k == order else grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))) for k in range(order + 1)}
    context = F.shiftrightunsigned("key", 8)
    # how many contexts, of any order, reach which count: some hundred rows
    sizes = None
    for k, g in by_order.items():
        step = g.groupBy(context.alias("c")).agg(F.sum("n").alias("n")).select(F.floor(F.log2("n") * 8).cast("int").alias("step"), "n").groupBy("step").agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
        sizes = step if sizes is None else sizes.union(step)
    bound, total = 1 << 62, 0
    for r in sizes.groupBy("step").agg(F.sum("contexts").alias("contexts"), F.min("least").alias("least")).orderBy(F.desc("step")).collect():
        total += r["contexts"]
        if total > max_contexts:
            break
        bound = r["least"]
    out = []
    for k, g in by_order.items():
        kept = g.groupBy(context.alias("c")).agg(F.sum("n").alias("total")).where(F.col("total") >= bound).select("c") if bound > 1 else None
        rows = (g if kept is None else g.withColumn("c", context).join(kept, "c", "left_semi")).select("key", "n").toArrow()
        keys = rows.column(0).to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(keys)
        out.append((keys[by], rows.column(1).to_numpy()[by]))
    drop_table(spark, path)
    return out


def gram_costs(df: DataFrame, order: int = ORDER) -> tuple[DataFrame, str]:
    """key, n and cost of each gram of order + 1 bytes in df's texts, and the path of the table that holds them.

    df has text and tag, 1 for texts that are learnt from and else 0.  n is how often the gram stands in all
    texts, cost the code length of its last byte after the others, in decimal digits.
    """

    def suffix(size: int) -> F.Column:
        return F.col("key").bitwiseAND(F.lit((1 << 8 * size) - 1))

    tag = F.shiftrightunsigned("key", 8 * (order + 1))
    counted = count_grams(df, order + 1, tags=2).groupBy(suffix(order + 1).alias("key")).agg(F.sum("n").alias("n"), F.sum(F.when(tag == 1, F.col("n")).otherwise(0)).alias("seen"))
    grams, paths = {}, []
    for size in range(order + 1, 0, -1):
        grams[size], path = write_table(counted, "grams")
        paths.append(path)
        counted = grams[size].groupBy(suffix(size - 1).alias("key")).agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    # of each gram's context how often it was seen and with how many symbols; 256 rows a context at most
    context = Window.partitionBy(F.shiftrightunsigned("key", 8))
    stats = {"total": F.sum("seen").over(context), "distinct": F.count_if(F.col("seen") > 0).over(context)}
    whole = F.col("total") + F.col("distinct")

    def coded(seen: str, whole: F.Column, distinct: F.Column, shorter: F.Column) -> F.Column:
        """The code length in a context, or of an escape from it and then in the shorter one; one with nothing left costs nothing."""
        return F.when(F.col(seen) > 0, F.log10(whole) - F.log10(seen)).when(distinct > 0, F.log10(whole / distinct) + shorter).otherwise(shorter)

    # beyond: the code length after an escape from the gram's context, whose symbols are excluded from then on
    made = grams[1].withColumns(stats).withColumn("beyond", F.log10(F.greatest(256 - F.col("distinct"), F.lit(1))))
    made = made.withColumn("cost", coded("seen", whole, F.col("distinct"), F.col("beyond")))
    for size in range(2, order + 2):
        below = made.select(F.col("key").alias("below"), *[F.col(c).alias(f"b_{c}") for c in ("seen", "total", "distinct", "beyond", "cost")])
        made = grams[size].join(below, suffix(size - 1) == F.col("below")).withColumns(stats | {"taken": F.sum(F.when(F.col("seen") > 0, F.col("b_seen")).otherwise(0)).over(context)})
        left = F.col("b_distinct") - F.col("distinct")  # the context's symbols are symbols of the shorter one too
        made = made.withColumn("beyond", coded("b_seen", F.col("b_total") - F.col("taken") + left, left, F.col("b_beyond")))
        # a context that was never seen is none of the model's
        made = made.withColumn("cost", F.when(F.col("distinct") > 0, coded("seen", whole, F.col("distinct"), F.col("beyond"))).otherwise(F.col("b_cost")))
    costs, path = write_table(made.select("key", "n", "cost"), "gram_costs")
    drop_table(df.sparkSession, *paths)
    return costs, path


class GramCosts:
    """Code lengths of the most frequent grams: sorted keys and a code length for each."""

    def __init__(self, keys: np.ndarray, cost: np.ndarray, order: int):
        by = np.argsort(keys)
        self.keys, self.cost, self.order = keys[by], cost[by].astype(np.float32), order

    def code_lengths(self, data: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Of each text and its end the code length by these grams, and the other grams with how often they stand in it."""
        size = self.order + 1
        buf, starts = framed(data, self.order)
        grams = gram_keys(buf, size).view(np.int64)
        doc = np.repeat(np.arange(len(data)), np.diff(starts))[: len(grams)]
        # the last places of each text but the last begin grams that run into the next text
        ok = np.ones(len(grams), bool)
        for j in range(1, size):
            ok[starts[1:-1] - j] = False
        doc, (grams, which) = doc[ok], np.unique(grams[ok], return_inverse=True)
        at = np.searchsorted(self.keys, grams)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == grams[hit]
        cost = np.zeros(len(grams))
        cost[hit] = self.cost[at[hit]]
        total = np.bincount(doc, cost[which], len(data))
        rest: list[list[tuple[int, int]]] = [[] for _ in data]
        cold = np.flatnonzero(~hit[which])
        if len(cold):
            pairs, n = np.unique(doc[cold] * np.int64(len(grams)) + which[cold], return_counts=True)
            for d, g, k in zip((pairs // len(grams)).tolist(), grams[pairs % len(grams)].tolist(), n.tolist()):
                rest[d].append((g, k))
        return total, rest


def adaptive_code_length(data: bytes, order: int = ORDER, counts: dict | None = None, learn: bool = True) -> float:
    """Code length of one text and its end by a trie that learns as it goes (or by given counts).

    counts maps a context (bytes) to a Counter of symbols; it is added to if learn is set.
    """
    counts = defaultdict(Counter) if counts is None else counts
    history = bytes([EDGE]) * order
    digits = 0.0
    for sym in [*data, EDGE]:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            table = counts.get(history[len(history) - k :] if k else b"")
            if not table:
                continue
            left = {s: c for s, c in table.items() if s not in excluded}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if sym in left:
                digits += math.log10(whole / left[sym])
                break
            digits += math.log10(whole / len(left))
            excluded |= left.keys()
        else:
            digits += math.log10(256 - len(excluded))
        if learn:
            for k in range(order + 1):
                counts[history[len(history) - k :] if k else b""][sym] += 1
        history = (history + bytes([sym]))[-order:] if order else b""
    return digits


def _words(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes' own split and lower know ASCII only, as wanted."""
    return text.encode().lower().split()


def score(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    learn_from: "F.Column | None" = None,
    order: int = ORDER,
    max_contexts: int | None = None,
    adaptive: bool = False,
    hot: int = HOT_TERMS,
    hot_grams: int = HOT_GRAMS,
) -> DataFrame:
    """Score every text of df by models learnt from those rows for which learn_from (all, if None) is true.

    Columns: doc_id, held_out (not learnt from), n_tokens (words and the end), n_known (those that the
    training texts have), train_tokens, base_score (log10 by the word model), score (log10 by PPM), n_bytes.
    A null or empty text is the end alone; null and repeated ids are kept, each row scored for itself;
    a null learn_from counts as false.  Without training texts every symbol is as likely as another.
    Other columns are left out, and an empty table gives no rows.  Every counted context is in the model
    unless max_contexts is given; hot and hot_grams only say how much of it is broadcast.
    """
    spark = df.sparkSession
    learn = F.coalesce(learn_from, F.lit(False)) if learn_from is not None else F.lit(True)
    key = text_column(df, doc_id)
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text_column(df, text)}`").alias("text"), learn.alias("learn"))
    train_rows = rows.where("learn").select("text")
    words, words_path = write_table(count_terms(train_rows, lambda b: map(_words, texts(b)), binary=True), "words")
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_ends = train_rows.count()
    n_all, n_distinct = n_words + n_ends, distinct + (n_ends > 0)
    whole = float(n_all + n_distinct + 1)
    bound = hot_bound(words, hot)
    known = spark.sparkContext.broadcast({w: (math.log10((n + 1) / whole)) for w, n in hot_terms(words, "n", bound).items()})  # `hot` terms at most
    model = costs = costs_path = None
    if not adaptive and max_contexts is not None:
        model = _Held(spark.sparkContext.broadcast(train(train_rows, order, max_contexts)))
    elif not adaptive:
        costs, costs_path = gram_costs(rows.select("text", F.col("learn").cast("int").alias("tag")), order)
        gram_bound = hot_bound(costs, hot_grams)
        found = costs.where(F.col("n") >= gram_bound).select("key", "cost").toArrow()  # `hot_grams` at most
        common = spark.sparkContext.broadcast(GramCosts(found.column(0).to_numpy(), found.column(1).to_numpy(), order))
    end_score, unseen = math.log10((n_ends + 1) / whole), math.log10(1 / whole)
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", df.schema[key].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("hot_known", T.LongType()),
            T.StructField("hot_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rest", T.MapType(T.BinaryType(), T.IntegerType())),
            T.StructField("rest_grams", T.MapType(T.LongType(), T.IntegerType())),
        ]
    )

    whole_model = costs is not None  # a frame cannot go to the workers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("ppm")
        get = known.value.get
        for b in slices(batches, 4 * SLICE_ROWS):
            data = [t.encode() for t in texts(b)]
            scores, rest_grams = np.zeros(len(data)), []
            for lo, hi in groups_of(data):
                if whole_model:
                    scores[lo:hi], others = common.value.code_lengths(data[lo:hi])
                    rest_grams += others
                else:
                    scores[lo:hi] = [adaptive_code_length(d, order) for d in data[lo:hi]] if model is None else _automaton(model.id, model).code_lengths(data[lo:hi])
                    rest_grams += [[]] * (hi - lo)
            n_tokens, hot_known, hot_score, rest = [], [], [], []
            for d in data:
                ws = d.lower().split()
                found = list(map(get, ws))
                cold = Counter([w for w, f in zip(ws, found) if f is None]) if None in found else {}
                n_tokens.append(len(ws) + 1)
                hot_known.append(len(ws) - sum(cold.values()) + (n_ends > 0))
                hot_score.append(math.fsum([f for f in found if f is not None]) + end_score)
                rest.append(list(cold.items()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), b.column(3), pa.array(n_tokens, pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array(hot_known, pa.int64()),
                    pa.array(hot_score, pa.float64()), pa.array(-scores), pa.array(rest, pa.map_(pa.binary(), pa.int32())),
                    pa.array(rest_grams, pa.map_(pa.int64(), pa.int32())),
                ],
                names=schema.fieldNames(),
            )

    docs, docs_path = write_table(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", (~F.col("learn")).alias("held_out")).mapInArrow(work, schema), "scored")
    cold = docs.select("row", F.explode("rest").alias("term", "k"))
    each = F.coalesce(F.log10((F.col("n") + 1) / F.lit(whole)), F.lit(unseen))
    sums = (
        cold.join(words.where(F.col("n") < bound), "term", "left")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("cold_known"), F.sum(F.col("k") * each).alias("cold_score"))
    )
    out = docs.drop("rest", "rest_grams").join(sums, "row", "left").withColumn("cold_cost", F.lit(0.0))
    if costs is not None:
        others = docs.select("row", F.explode("rest_grams").alias("key", "k")).join(costs.where(F.col("n") < gram_bound), "key")
        out = out.drop("cold_cost").join(others.groupBy("row").agg(F.sum(F.col("k") * F.col("cost")).alias("cold_cost")), "row", "left")
    out = write_result(
        out
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("hot_known") + F.coalesce("cold_known", F.lit(0).cast("long"))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0))).alias("base_score"),
            (F.col("score") - F.coalesce("cold_cost", F.lit(0.0))).alias("score"),
            "n_bytes",
        ),
        "lm_scores",
    )
    drop_table(spark, words_path, docs_path, *([costs_path] if costs_path else []))
    return out
