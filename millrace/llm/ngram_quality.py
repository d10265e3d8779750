"""Operator 4: quality rules with n-gram perplexity.

Rules of repetition and size come first; a text that fails them is rejected.  The others are judged
by an n-gram model of bytes for each language: perplexity per byte must lie between the language's
lower and upper bound.

Model.  Modified Kneser-Ney: counts of all n-grams are gathered by Spark; lower orders count in how many
contexts a gram stands; three discounts by order and language come from the counts of counts.  It learns
from texts that pass the rules and have at most one symbol in SYMBOL_WORDS words, so that common junk does
not teach it to expect junk; every text that passes the rules is judged.  A gram's interpolated
probability depends on its bytes alone, so it is worked out once for each distinct gram that stands in
any judged text, by joins with the grams one byte shorter.  The model is stored in arrays sorted by hash
and found by the hash's leading bits and some steps on: those of the most frequent grams, HOT_GRAMS of
all languages together at most, are broadcast; the others' are rows of a table, one for each range of
hashes, to which the texts' other grams are dealt.  No gram and no language is left out.  Costs are whole
numbers of millionths of a digit, so that sums do not depend on how rows are dealt.

Bands.  For each language, over all distinct texts that pass the rules, come the median of log
perplexity per byte and the median distance from it, exact to a bin of 1e-4.  The band reaches ABOVE and
BELOW times that distance from the median, and MARGIN further; it is wider for short texts, whose
perplexity scatters as one over the square root of their length.  Neither many copies of one text nor
any junk that makes up less than half of a language moves it much.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytegrams import count_grams, framed, gram_keys
from .common import SLICE_ROWS, drop_table, give_back, groups_of, keeps, mix64, serve, slices, text_column, texts, write_result, write_table
from .vocabulary import hot_bound
from .wordvec import SPACE, Words, span_hashes, sum_by, windows, words_of

ORDER = 5
#: Grams whose costs are broadcast at most, 12 MB; those of the others are looked up in a table.
HOT_GRAMS = 1 << 20
#: A part of that table holds about so many grams, and is asked about so many times.
PART_GRAMS, PART_ASKED = 1 << 17, 1 << 20
#: Costs are in millionths of a decimal digit, perplexities are binned by ten-thousandths.
UNIT, BIN = 1_000_000, 10_000
#: Texts with more than a symbol in so many words are not learnt from.
SYMBOL_WORDS = 10
ABOVE, BELOW, MARGIN, SHORT = 20.0, 40.0, 0.02, 1.0

MIN_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


# --- rules -----------------------------------------------------------------------------------------


def _repeated(w: Words) -> np.ndarray:
    """Of each text, the words in windows that stand in it twice or more."""
    h, at = windows(w, WINDOW)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(h):
        key = h ^ mix64(w.doc[at].astype(np.uint64) + np.uint64(1))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(h), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    return sum_by((np.cumsum(covered[:-1]) > 0), w.first)


def _duplicate_lines(w: Words, data: list[bytes]) -> np.ndarray:
    """Of each text, the lines with a word that equal an earlier line."""
    ends = np.flatnonzero(w.buf == 0x0A)  # one stands after each text
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(~SPACE[w.buf], out=before[1:])
    line = before[ends] > before[starts]
    starts, ends = starts[line], ends[line]
    if not len(starts):
        return np.zeros(len(data), np.int64)
    doc = np.searchsorted(w.text_start, starts, side="right") - 1
    key = span_hashes(w.buf, starts, ends) ^ mix64(doc.astype(np.uint64) + np.uint64(1))
    by = np.argsort(key, kind="stable")
    again = by[1:][key[by][1:] == key[by][:-1]]
    return np.bincount(doc[again], minlength=len(data))


def rule_counts(data: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each text."""
    w = words_of(data)
    letters = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum((~SPACE[w.buf]) & ((w.buf & 0xC0) != 0x80), out=letters[1:])
    symbols = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(_SYMBOL[w.buf], out=symbols[1:])
    lo, hi = w.text_start[:-1], w.text_start[1:]
    out = {
        "n_words": w.counts,
        "word_chars": letters[hi] - letters[lo],
        "n_symbols": symbols[hi] - symbols[lo],
        "n_dup_lines": _duplicate_lines(w, data),
        "n_repeat_words": _repeated(w),
    }
    return out | {"base_failed": (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEATED_PERCENT * out["n_words"])}


# --- model -----------------------------------------------------------------------------------------


def use_of(data: list[bytes]) -> np.ndarray:
    """Of each text 1 if it is learnt from, 0 if it is only judged, -1 if the rules reject it."""
    found = rule_counts(data)
    return np.where(found["base_failed"], -1, (found["n_symbols"] * SYMBOL_WORDS <= found["n_words"]).astype(np.int64))


def gram_mask(size: int) -> int:
    return (1 << 8 * size) - 1


def _discounts(n1: F.Column, n2: F.Column, n3: F.Column, n4: F.Column) -> list[F.Column]:
    """Three discounts from the numbers of grams seen once to four times."""
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    made = [(1, 1 - 2 * y * n2 / n1, 0.5), (2, d2, 0.75), (3, F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(d2), 0.9)]
    return [F.when((n1 > 0) & (n2 > 0), F.least(F.greatest(d, F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(few)).alias(f"d{i}") for i, d, few in made]


def gram_costs(df: DataFrame, order: int = ORDER) -> tuple[DataFrame, str]:
    """grp, gram, n and cost of each gram of `order` bytes in df's texts, and the path of the table that holds them.

    df has text and grp, a number for each language.  n is how often the gram stands in all judged texts,
    cost -log10 of the probability of its last byte after the others, in millionths.
    """
    tag = F.shiftrightunsigned("key", 8 * order)
    gram = F.col("key").bitwiseAND(F.lit(gram_mask(order))).alias("gram")
    counted = count_grams(df, order, tags=2, groups=True, tag_of=use_of).groupBy("grp", gram).agg(F.sum("n").alias("n"), F.sum(F.when(tag == 1, F.col("n")).otherwise(0)).alias("seen"))
    grams, paths = {}, []
    for size in range(order, 0, -1):
        grams[size], path = write_table(counted, "kn_grams")
        paths.append(path)
        # a shorter gram was seen as often as there are longer ones, seen themselves, that end in it
        counted = grams[size].groupBy("grp", F.col("gram").bitwiseAND(F.lit(gram_mask(size - 1))).alias("gram")).agg(F.count_if(F.col("seen") > 0).alias("seen"))
    stats = None
    for size, table in grams.items():
        one = table.where("seen > 0").groupBy("grp").agg(*[F.count_if(F.col("seen") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).select(F.lit(size).alias("size"), "grp", *_discounts(*map(F.col, ("n1", "n2", "n3", "n4"))))
        stats = one if stats is None else stats.union(one)
    discounts, path = write_table(stats, "kn_discounts")  # one row for each language and order
    paths.append(path)
    context = Window.partitionBy("grp", F.shiftrightunsigned("gram", 8))  # 257 rows at most
    taken = [F.col("seen") == 1, F.col("seen") == 2, F.col("seen") > 2]
    own = F.greatest(F.col("seen") - F.when(taken[0], F.col("d1")).when(taken[1], F.col("d2")).when(taken[2], F.col("d3")), F.lit(0.0))
    made = None
    for size in range(1, order + 1):
        now = grams[size].join(discounts.where(F.col("size") == size).drop("size"), "grp", "left")
        if made is None:
            now = now.withColumn("below", F.lit(1 / 256))
        else:
            shorter = made.select("grp", F.col("gram").alias("_suffix"), F.col("p").alias("below"))
            now = now.withColumn("_suffix", F.col("gram").bitwiseAND(F.lit(gram_mask(size - 1)))).join(shorter, ["grp", "_suffix"])
        total = F.sum("seen").over(context)
        left = sum((F.count_if(t).over(context) * F.col(f"d{i + 1}") for i, t in enumerate(taken)), F.lit(0.0))
        now = now.withColumns({"total": total, "left": left})
        # a context that was never seen is none of the model's: the shorter one speaks
        made = now.withColumn("p", F.when(F.col("total") > 0, (F.coalesce(own, F.lit(0.0)) + F.col("left") * F.col("below")) / F.col("total")).otherwise(F.col("below")))
    costs, path = write_table(made.select("grp", "gram", "n", F.round(-F.log10("p") * UNIT).cast("int").alias("cost")), "kn_costs")
    drop_table(df.sparkSession, *paths)
    return costs, path


def gram_hashes(grams: np.ndarray, grp: np.ndarray) -> np.ndarray:
    """64-bit hashes of grams of numbered languages."""
    return mix64(grams.astype(np.uint64) ^ mix64(grp.astype(np.int64).view(np.uint64) + np.uint64(1)))


class HashArrays:
    """Costs of grams in an array sorted by the grams' hashes."""

    def __init__(self, hashes: np.ndarray, cost: np.ndarray):
        by = np.argsort(hashes)
        self.hash, self.cost = hashes[by], cost[by].astype(np.int32)
        self.bits = max(1, min(20, int(len(hashes)).bit_length() + 1))
        lead = (self.hash >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.steps = int(np.diff(self.start).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 for those that are not there."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hash):
            return out
        lead = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[lead], self.start[lead + 1]
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        for _ in range(self.steps):
            have = self.hash[at]
            hit = have == h
            out[todo[hit]] = at[hit]
            on = (~hit) & (have < h) & (at + 1 < end)
            if not on.any():
                break
            todo, at, end, h = todo[on], at[on] + 1, end[on], h[on]
        return out


class Model:
    """Costs of all grams: the frequent ones in a broadcast, the others in a table of hash arrays."""

    def __init__(self, costs: DataFrame, order: int, hot: int = HOT_GRAMS):
        spark = costs.sparkSession
        self.name, self.order = uuid.uuid4().hex, order
        bound = hot_bound(costs, hot)
        found = costs.where(F.col("n") >= bound).select("grp", "gram", "cost").toArrow()  # `hot` rows at most
        columns = [found.column(c).to_numpy() for c in range(3)]
        self.broadcast = spark.sparkContext.broadcast((gram_hashes(columns[1], columns[0]), columns[2]))
        del found, columns
        give_back()
        rare = costs.where(F.col("n") < bound)
        n, asked = rare.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.bits = max(0, math.ceil(math.log2(max(n / PART_GRAMS, asked / PART_ASKED, 1))))
        self.cold, self.path = None, None
        if n:
            self.cold, self.path = write_table(_hash_parts(rare, self.bits), "kn_arrays")

    def for_workers(self) -> "_Held":
        return _Held(self.name, self.broadcast, self.order)

    def cold_costs(self, rows: DataFrame) -> DataFrame:
        """row and cost: what the grams of rows (row, rest_hash, rest_k) that are not broadcast cost together."""
        asked = rows.select("row", F.explode(F.arrays_zip("rest_hash", "rest_k")).alias("r")).select("row", F.col("r.rest_hash").alias("hash"), F.col("r.rest_k").alias("k"), _part(F.col("r.rest_hash"), self.bits).alias("part"))

        def look(arrays: pa.Table, asked: pa.Table) -> pa.Table:
            row, cost = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if arrays.num_rows and asked.num_rows:
                held = HashArrays(np.frombuffer(arrays.column("hashes")[0].as_py(), np.uint64), np.frombuffer(arrays.column("costs")[0].as_py(), np.int32))
                at = held.find(asked.column("hash").to_numpy().view(np.uint64))
                if (at < 0).any():
                    raise ValueError("a gram of the texts is not in the model")
                row, which = np.unique(asked.column("row").to_numpy(), return_inverse=True)
                cost = np.zeros(len(row), np.int64)
                np.add.at(cost, which, held.cost[at].astype(np.int64) * asked.column("k").to_numpy())
            return pa.table({"row": pa.array(row), "cost": pa.array(cost)})

        found = self.cold.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(look, "row long, cost long")
        return found.groupBy("row").agg(F.sum("cost").alias("cold_cost"))


def _part(hash_: F.Column, bits: int) -> F.Column:
    return F.shiftrightunsigned(hash_, 64 - bits).cast("int") if bits else F.lit(0)


def _hash_parts(costs: DataFrame, bits: int) -> DataFrame:
    """part, hashes and costs: sorted arrays of the grams whose hashes begin with the part's bits."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = gram_hashes(b.column(1).to_numpy(), b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(2)], names=["hash", "cost"])

    def together(table: pa.Table) -> pa.Table:
        held = HashArrays(table.column("hash").to_numpy().view(np.uint64), table.column("cost").to_numpy())
        return pa.table({"part": table.column("part").slice(0, 1), "hashes": pa.array([held.hash.tobytes()], pa.binary()), "costs": pa.array([held.cost.tobytes()], pa.binary())})

    each = costs.select("grp", "gram", "cost").mapInArrow(hashed, "hash long, cost int").withColumn("part", _part(F.col("hash"), bits))
    return each.groupBy("part").applyInArrow(together, "part int, hashes binary, costs binary")


class _Held:
    """A broadcast model with a name of its own, so that a worker builds its arrays once."""

    def __init__(self, name: str, broadcast, order: int):
        self.name, self.broadcast, self.order = name, broadcast, order

    def __hash__(self):
        return hash(self.name)

    def __eq__(self, other):
        return self.name == other.name

    def costs(self, data: list[bytes], grp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each text and its end what the broadcast grams cost, and the other grams' hashes with their counts."""
        n, arrays = self.order, _built(self)
        buf, starts = framed(data, n - 1)
        keys = gram_keys(buf, n)
        ok = np.ones(len(keys), bool)
        for j in range(1, n):
            ok[starts[1:-1] - j] = False
        doc = np.repeat(np.arange(len(data)), np.diff(starts))[: len(keys)][ok]
        h = gram_hashes(keys[ok], grp[doc])
        at = arrays.find(h)
        cold = at < 0
        total = np.zeros(len(data), np.int64)
        np.add.at(total, doc[~cold], arrays.cost[at[~cold]].astype(np.int64))
        by = np.lexsort((h[cold], doc[cold]))
        h, doc = h[cold][by], doc[cold][by]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
        k = np.diff(np.append(first, len(h))).astype(np.int32)
        cuts = np.searchsorted(doc[first], np.arange(1, len(data)))
        return total, np.split(h[first].view(np.int64), cuts), np.split(k, cuts)


@lru_cache(maxsize=1)
def _built(model: _Held) -> HashArrays:
    return HashArrays(*model.broadcast.value)


keeps("ngram_quality", _built.cache_clear)


# --- operator --------------------------------------------------------------------------------------


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _grouped(df: DataFrame, lang: str | None) -> F.Column:
    """A number for each language: a hash of its name; null is one more, and lang=None makes one of all."""
    return F.xxhash64(F.col(f"`{text_column(df, lang)}`").cast("string")) if lang is not None else F.lit(0).cast("long")


def _measured(df: DataFrame, text: str, lang: str | None, keep: list[str], model: Model) -> DataFrame:
    """Columns `keep` of df, named c0 and so on, and what is known of each row before rare grams are looked up.

    row, grp, digest (of the text), the rules' counts, base_failed, n_bytes, cost (of the broadcast grams),
    rest_hash and rest_k (the other grams).  Texts that the rules reject cost nothing.
    """
    text = text_column(df, text)
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    body = F.col(f"`{text}`")
    plain = df.select(*inner, _grouped(df, lang).alias("grp"), *([] if text in keep else [body.alias("text")]))
    where = keep.index(text) if text in keep else len(keep) + 1
    shown = T.StructType(plain.schema.fields[: len(keep) + 1])
    schema = T.StructType(
        [*shown.fields, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.LongType())]
        + [T.StructField("cost", T.LongType()), T.StructField("rest_hash", T.ArrayType(T.LongType())), T.StructField("rest_k", T.ArrayType(T.IntegerType()))]
    )
    held = model.for_workers()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("ngram_quality")
        for b in slices(batches, 2 * SLICE_ROWS):
            data = [(t or "").encode() for t in b.column(where).to_pylist()]
            grp = b.column(len(keep)).to_numpy(zero_copy_only=False)
            found, digest, cost = [], np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
            hashes, times = [[]] * len(data), [[]] * len(data)
            for lo, hi in groups_of(data):
                found.append(rule_counts(data[lo:hi]))
                buf = np.frombuffer(b"".join(data[lo:hi]), np.uint8)
                ends = np.cumsum([len(d) for d in data[lo:hi]])
                digest[lo:hi] = span_hashes(buf, np.concatenate([[0], ends[:-1]]), ends).view(np.int64)
                some = lo + np.flatnonzero(~found[-1]["base_failed"])
                if len(some):
                    cost[some], h, k = held.costs([data[i] for i in some], grp[some])
                    for i, x, y in zip(some.tolist(), h, k):
                        hashes[i], times[i] = x, y
            made = [pa.array(np.concatenate([f[c] for f in found])) for c in (*COUNTS, "base_failed")]
            made += [pa.array([len(d) for d in data], pa.int64()), pa.array(digest), pa.array(cost), pa.array(hashes, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep) + 1)), *made], names=schema.fieldNames())

    return plain.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id())


def _perplexity(cost: F.Column) -> F.Column:
    return F.when(~F.col("base_failed"), cost / UNIT / (F.col("n_bytes") + 1))


def bands(scored: DataFrame) -> DataFrame:
    """grp, low and high: bounds of log10 perplexity of each language, from scored's grp, digest, base_failed and log10_ppl."""
    bins = scored.where("not base_failed").select("grp", "digest", F.round(F.col("log10_ppl") * BIN).cast("long").alias("x")).distinct().groupBy("grp", "x").agg(F.count("*").alias("n"))

    def median(counts: DataFrame, name: str) -> DataFrame:
        """The least x of each grp that half of its rows do not pass; counts has a row for each bin."""
        each = Window.partitionBy("grp")
        upto = each.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(each)}).where(F.col("upto") * 2 >= F.col("all")).groupBy("grp").agg(F.min("x").alias(name))

    middle = median(bins, "middle")
    apart = bins.join(middle, "grp").groupBy("grp", F.abs(F.col("x") - F.col("middle")).alias("x")).agg(F.sum("n").alias("n"))
    both = middle.join(median(apart, "apart"), "grp")
    return both.select("grp", ((F.col("middle") - BELOW * F.col("apart")) / BIN - MARGIN).alias("low"), ((F.col("middle") + ABOVE * F.col("apart")) / BIN + MARGIN).alias("high"))


def judged() -> F.Column:
    """Whether a row with log10_ppl and its language's bounds is kept."""
    slack = F.lit(SHORT) / F.sqrt(F.col("n_bytes") + 1)
    return ~F.col("base_failed") & F.coalesce((F.col("log10_ppl") >= F.col("low") - slack) & (F.col("log10_ppl") <= F.col("high") + slack), F.lit(False))


def fit(df: DataFrame, text: str = "text", lang: str | None = "lang", order: int = ORDER, hot: int = HOT_GRAMS) -> Model:
    """The model of df's texts; its table, if it has one, is the caller's to drop."""
    costs, path = gram_costs(df.select(F.col(f"`{text_column(df, text)}`").alias("text"), _grouped(df, lang).alias("grp")), order)
    model = Model(costs, order, hot)
    drop_table(df.sparkSession, path)
    return model


def assess(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", order: int = ORDER, hot: int = HOT_GRAMS) -> DataFrame:
    """doc_id, the rules' counts, base_failed, log10_ppl (per byte), the language's bounds and kept for every row of df.

    A null or empty text has no words and fails; log10_ppl is null for texts that fail.  Every language has
    a model and a band of its own, a null one like any other; lang=None makes one language of all rows.
    Null and repeated ids are kept as they are; an empty table gives no rows.  Other columns are left out.
    hot only says how much of the model is broadcast.
    """
    spark, model = df.sparkSession, fit(df, text, lang, order, hot)
    measured, path = write_table(_measured(df, text, lang, [text_column(df, doc_id)], model), "measured")
    cost = F.col("cost")
    whole = measured
    if model.cold is not None:
        whole = measured.join(model.cold_costs(measured.select("row", "rest_hash", "rest_k")), "row", "left")
        cost = cost + F.coalesce("cold_cost", F.lit(0).cast("long"))
    scored = write_result(whole.select(F.col("c0").alias("doc_id"), *COUNTS, "base_failed", "n_bytes", "grp", "digest", _perplexity(cost).alias("log10_ppl")), "assessed")
    limits = write_result(bands(scored), "bands")  # one row for each language
    drop_table(spark, path, *([model.path] if model.path else []))
    return scored.join(limits, "grp", "left").select("doc_id", *COUNTS, "base_failed", "log10_ppl", "low", "high", judged().alias("kept"))


def keep_good(df: DataFrame, text: str = "text", lang: str | None = "lang", order: int = ORDER, hot: int = HOT_GRAMS) -> DataFrame:
    """The rows of df that assess keeps, with the columns of df.

    Rows are written once with their measures.  Of those that are moved to meet their verdicts, only ones
    with rare grams are: what the others cost is known where they were read.
    """
    spark, model = df.sparkSession, fit(df, text, lang, order, hot)
    measured = write_result(_measured(df, text, lang, list(df.columns), model), "measured")
    known = measured.withColumn("log10_ppl", _perplexity(F.col("cost")))
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    if model.cold is None:
        limits = write_result(bands(known), "bands")
        return known.join(limits, "grp").where(judged()).select(*columns)
    narrow = measured.where("not base_failed").select("row", "grp", "digest", "base_failed", "n_bytes", "cost", "rest_hash", "rest_k")
    whole = narrow.join(model.cold_costs(narrow.select("row", "rest_hash", "rest_k")), "row", "left")
    scored, scored_path = write_table(whole.select("row", "grp", "digest", "base_failed", "n_bytes", (F.size("rest_hash") > 0).alias("moved"), _perplexity(F.col("cost") + F.coalesce("cold_cost", F.lit(0).cast("long"))).alias("log10_ppl")), "scored")
    limits = write_result(bands(scored), "bands")
    verdict = write_result(scored.where("moved").join(limits, "grp").where(judged()).select("row"), "verdicts")
    drop_table(spark, scored_path, model.path)
    alone = known.where(F.size("rest_hash") == 0).join(limits, "grp").where(judged()).select(*columns)
    return alone.unionByName(measured.where(F.size("rest_hash") > 0).join(verdict, "row", "left_semi").select(*columns))
