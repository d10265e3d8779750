"""Operator 5: near-duplicates by ProbMinHash, banding and verification.

Shingles are all windows of five words (runs without space and 0x09-0x0D) of a text; a text of one to
four words is one shingle.  A shingle's weight is its number of places in the text.

Signature.  ProbMinHash: each shingle sends arrivals, a Poisson process with its weight as the rate
and the shingle's hash as the seed, to uniformly drawn registers; a register keeps the shingle that
arrives first.  A process ends once its time is beyond the latest of the text's registers.  Two texts
agree in a register with the probability Jaccard similarity of their weighted shingles.  All shingles
are signed with weight 1, for which that is the Jaccard similarity of their sets, as links are defined:
how often a passage repeats cannot keep a link's texts apart.

Candidates.  Registers are banded, BANDS times ROWS: pairs at the threshold of 0.8 share no band in
3 of a million cases.  Texts with equal words are one node, whatever their number.  A node of whose
shingles more than a fifth stand in no other node that it meets cannot be similar to any, and leaves;
pairs that cannot be similar, by their sizes, by such shingles of their own and by what they are known
to have in common with one centre, are passed over.
In a bucket every node is compared with one of them, the centre: the one that meets most others in
all its buckets, as the original of a group of variants does.  Buckets whose nodes are in one class by
then, through this bucket or any other, are done.  In those that are not, every node outside the
bucket's largest class is compared with the nodes of other classes that it may be similar to: variants
of one centre that have too little in common with it must share shingles that the centre lacks, and
are found by those.  So no link between classes is lost, and no list of a bucket's pairs is made: a
group of n variants of one text costs n comparisons.

What is known of whole buckets (their sizes, centres and largest classes) is counted in partial sums and
written before nodes are joined with it.  So a stage that deals nodes by their buckets holds nothing but
the join, and adaptive execution deals a large bucket's nodes to several tasks.

Verification.  A link is a pair whose sets of shingles have a Jaccard similarity of 0.8 or more,
computed from the whole sets of 40-bit hashes.  Classes are the connected components of links.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, binaries, drop_table, groups_of, mix64, serve, slices, text_column, texts, write_result, write_table
from .wordvec import Words, windows, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
HASH_BITS = 40

#: Bits of the broadcast filters of keys: 2 MB.
FILTER_BITS = 24


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 40-bit hash and weight of each distinct shingle, in order of text and hash."""
    h, at = windows(w, size)
    doc = w.doc[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for i in range(size - 1):
            more = w.counts[few] > i
            whole[more] = mix64(whole[more] + w.hash[w.first[few[more]] + i] + np.uint64(1))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, few])
    keys = np.sort((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS)))
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> np.uint64(HASH_BITS)).astype(np.int64), keys & np.uint64((1 << HASH_BITS) - 1), weight


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures of n texts: the shingle that arrived first in each register; 0 for texts without shingles."""
    first = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    seed, rate, base = mix64(h + np.uint64(1)), weight.astype(np.float64), doc * registers
    time = np.zeros(len(h))
    step = 0
    while len(h):
        step = (step + 0x9E3779B97F4A7C15) % (1 << 64)
        draw = mix64(seed + np.uint64(step))
        time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) / (1 << 53))) / rate
        at = base + (mix64(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        owner[at[won]] = h[won] + np.uint64(1)
        # a process whose time is beyond all its text's registers cannot win any more
        on = time < first.reshape(n, registers).max(1)[doc]
        doc, h, seed, rate, base, time = doc[on], h[on], seed[on], rate[on], base[on], time[on]
    return owner.reshape(n, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + signature.reshape(-1, bands, rows)[:, :, r])
    return mix64(out + np.arange(bands, dtype=np.uint64))


def content_keys(data: list[bytes]) -> list[bytes | None]:
    """A 128-bit key of each text's words; None for a text without words."""
    return [hashlib.blake2b(b" ".join(ws), digest_size=16).digest() if (ws := d.split()) else None for d in data]


def _signed(df: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", df.schema[doc_id].dataType),
            T.StructField("key", T.BinaryType()),
            T.StructField("n_shingles", T.IntegerType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("shingles", T.BinaryType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("near_duplicates")
        for b in slices(batches, SLICE_ROWS):
            data = [t.encode() for t in texts(b)]
            hashes, sets, counts = [], [], []
            for lo, hi in groups_of(data):
                doc, h, _ = shingles(words_of(data[lo:hi]), size)
                hashes.append(band_hashes(prob_minhash(doc, h, np.ones(len(h), np.int64), hi - lo, bands * rows), bands, rows))
                packed = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].tobytes()
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)) * (HASH_BITS // 8)
                sets += [packed[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist())]
                counts.append(np.diff(ends) // (HASH_BITS // 8))
            flat = np.concatenate(hashes).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * bands), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), binaries(content_keys(data)), pa.array(np.concatenate(counts).astype(np.int32)), listed, binaries(sets)], names=schema.fieldNames())

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, schema)


def _filter_of(keys: DataFrame) -> DataFrame:
    """A bit for each value of a hash that some key has: 2**(FILTER_BITS - 6) rows of word and bits at most, whatever the number of keys."""
    h = F.shiftrightunsigned(F.xxhash64("key"), 64 - FILTER_BITS)
    return keys.select(F.shiftright(h, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(key), {64 - FILTER_BITS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _may_be_in(df: DataFrame, made: DataFrame) -> DataFrame:
    """df with may_be: false only if the row's key (null: never) is none of the filter's."""
    h = F.shiftrightunsigned(F.xxhash64("key"), 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(key), {64 - FILTER_BITS}) & 63 as int))")
    joined = df.withColumn("word", F.when(F.col("key").isNotNull(), F.shiftright(h, 6))).join(F.broadcast(made), "word", "left")
    return joined.withColumn("may_be", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb: their sizes, weight) with common, the number of shingles that both have."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    width = HASH_BITS // 8

    def unpack(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // width, 8), np.uint8)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
        return out.view(np.uint64).ravel()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_ROWS):
            common = []
            last, right = None, None
            for sa, sb in zip(b.column(5).to_pylist(), b.column(6).to_pylist()):
                if sb != last:
                    last, right = sb, unpack(sb)
                merged = np.sort(np.concatenate([unpack(sa), right]))
                common.append(int((merged[1:] == merged[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(common, pa.int32())], names=["a", "b", "na", "nb", "weight", "common"])

    return both.select("a", "b", "na", "nb", "weight", "sa", "sb").mapInArrow(work, "a binary, b binary, na int, nb int, weight long, common int")


def _beyond(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """shingle and key of each node's (key, hub) shingles that its hub lacks."""
    both = nodes.select("key", "hub").join(sets, "key").join(sets.select(F.col("key").alias("hub"), F.col("shingles").alias("others")), "hub").select("key", "shingles", "others")
    width = HASH_BITS // 8

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_ROWS):
            at, out = [], []
            for i, (mine, hub) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                left, right = ({raw[k : k + width] for k in range(0, len(raw), width)} for raw in (mine, hub))
                fresh = left - right
                out += fresh
                at += [i] * len(fresh)
            yield pa.RecordBatch.from_arrays([binaries(out), b.column(0).take(pa.array(at, pa.int64()))], names=["shingle", "key"])

    return both.mapInArrow(work, "shingle binary, key binary")


def _own(sets: DataFrame) -> DataFrame:
    """node and own: how many of a node's shingles stand in no other node.  node is a hash of the key."""
    width = HASH_BITS // 8

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_ROWS):
            raw = b.column(1).to_pylist()
            flat = np.zeros((sum(map(len, raw)) // width, 8), np.uint8)
            flat[:, :width] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(r) // width for r in raw])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64).ravel()), pa.array(node)], names=["shingle", "node"])

    each = sets.select(F.xxhash64("key").alias("node"), "shingles").mapInArrow(spread, "shingle long, node long")
    once = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    return once.groupBy("node").agg(F.count("*").alias("own"))


def linked(signed: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """key and label of every key that is linked to another one, and the tables that hold them."""
    spark = signed.sparkSession
    placed = signed.where("key is not null").select(F.explode("bands").alias("bucket"), "key", "n_shingles").distinct()
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met, met_path = write_table(placed.join(shared, "bucket"), "members")
    chosen = _may_be_in(signed.select("key", "shingles"), _filter_of(met.select("key"))).where("may_be")
    sets, sets_path = write_table(chosen.select("key", "shingles").dropDuplicates(["key"]), "sets", codec="lz4")
    # nodes that cannot be similar to any other leave; the rest get the number of nodes that they meet
    own = _own(sets)
    stay = met.join(own.withColumnRenamed("node", "_node"), F.xxhash64("key") == F.col("_node"), "left").withColumn("own", F.coalesce("own", F.lit(0)))
    stay, stay_path = write_table(stay.where(F.col("own") <= F.col("n_shingles") * (1 - threshold) + 1e-9).select("bucket", "key", "n_shingles", (F.col("n_shingles") - F.col("own")).alias("most")), "members")
    sizes, sizes_path = write_table(stay.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    still = stay.join(sizes, "bucket")
    degree = still.groupBy("key").agg(F.sum("n").alias("degree"))
    # each node with its size, the most it can have in common with others, a centre that it was compared
    # with and what they have in common, and its class; a node's own key is its class until it has a link
    columns = ["bucket", "key", "n_shingles", "most", "degree", "hub", "inter", "label"]
    begun = still.select("bucket", "key", "n_shingles", "most").join(degree, "key").withColumns({"hub": F.col("key"), "inter": F.col("n_shingles"), "label": F.col("key")})
    members, members_path = write_table(begun.select(*columns), "members")
    drop_table(spark, met_path, stay_path, sizes_path)

    def enough(common: F.Column, n: F.Column, m: F.Column) -> F.Column:
        """Whether sets of n and m with so much in common are similar."""
        return common * (1 + threshold) >= (n + m) * (threshold - 1e-9)

    compared: list[str] = []

    by_hub = F.least("inter", "c_inter") + F.least(F.col("most") - F.col("inter"), F.col("c_most") - F.col("c_inter"))
    bound = F.least("most", "c_most", F.when(F.col("hub") == F.col("c_hub"), by_hub))
    may_be_similar = (F.col("label") != F.col("c_label")) & enough(bound, F.col("n_shingles"), F.col("c_n_shingles"))
    # same-hub pairs that are not similar by what they share with the hub alone
    beyond_hub = (F.col("hub") == F.col("c_hub")) & ~enough(F.least("inter", "c_inter"), F.col("n_shingles"), F.col("c_n_shingles"))

    def renamed(nodes: DataFrame, on: str) -> DataFrame:
        return nodes.select(on, *[F.col(c).alias(f"c_{c}") for c in columns if c != "bucket"])

    def compare(near: DataFrame, first: bool) -> DataFrame:
        """Compare pairs of key and c_key; later, a pair may come both ways round."""
        swap = (F.col("key") > F.col("c_key")) & F.lit(not first)
        sides = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in (("a", "key", "c_key"), ("b", "c_key", "key"), ("na", "n_shingles", "c_n_shingles"), ("nb", "c_n_shingles", "n_shingles"))]
        weight = F.col("c_degree") if first else F.lit(0).cast("long")
        counted, path = write_table(_common(near.select(*sides, weight.alias("weight")).distinct(), sets), "compared")
        compared.append(path)
        return counted

    def classes() -> tuple[DataFrame, list[str]]:
        made = spark.read.schema("a binary, b binary, na int, nb int, weight long, common int").parquet(*compared)
        return components(made.where(enough(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b"))

    top = members.groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("d"), *columns[1:])).alias("c"))
    tops, tops_path = write_table(renamed(top.select("bucket", *[F.col(f"c.{c}").alias(c) for c in columns[1:]]), "bucket"), "centres")
    counted = compare(members.join(tops, "bucket").where(may_be_similar), True)
    label, label_paths = classes()
    # of a node's centres the one that meets most nodes is the one that it has in common with most of them
    hubs = counted.groupBy("a").agg(F.max(F.struct("weight", "b", "common")).alias("h")).select(F.col("a").alias("key"), F.col("h.b").alias("new_hub"), F.col("h.common").alias("new_inter"))
    now = members.drop("label", "hub", "inter").join(label, "key", "left").join(hubs, "key", "left")
    now = now.withColumns({"label": F.coalesce("label", "key"), "hub": F.coalesce("new_hub", "key"), "inter": F.coalesce("new_inter", "n_shingles")})
    now, now_path = write_table(now.select(*columns), "members")
    of_class = now.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = of_class.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("classes")).where("classes > 1").select("bucket", F.col("m.label").alias("largest"))
    largest, largest_path = write_table(largest, "largest")
    drop_table(spark, members_path, tops_path)
    members, open_path = write_table(now.join(largest, "bucket"), "members")
    drop_table(spark, largest_path)
    minority = members.where("label <> largest")
    # variants of one hub meet by shingles that it lacks, others in their buckets
    tokens, tokens_path = write_table(_beyond(members.select("key", "hub").distinct(), sets), "beyond")
    met = tokens.join(members.select(*columns[1:]).distinct(), "key").join(renamed(tokens.join(minority.select(*columns[1:]).distinct(), "key"), "shingle"), "shingle").where(may_be_similar & beyond_hub)
    compare(met, False)
    compare(members.join(renamed(minority, "bucket"), "bucket").where(may_be_similar & ~beyond_hub), False)
    drop_table(spark, *label_paths)
    label, label_paths = classes()
    drop_table(spark, sets_path, now_path, open_path, tokens_path, *compared)
    return label, label_paths


def _drawn(key: F.Column, turn: int) -> F.Column:
    """A key behind its hash of this turn, by which it is compared."""
    return F.struct(F.xxhash64(key, F.lit(turn)).alias("hash"), key.alias("key"))


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """key and label (one key of its component) of every key in edges (a, b).

    Each round maps every node to that of itself and its neighbours which has the least hash, and contracts
    the edges by that map, until no edge is left; maps are composed on the way.  Hashes are drawn anew in each
    round, so that a share of the nodes goes in every round, however keys are ordered: rounds are expected to
    grow as the logarithm of the number of nodes.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    label: DataFrame | None = None
    path = None
    for turn in itertools.count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to, to_path = write_table(both.groupBy("a").agg(F.min(_drawn(F.col("b"), turn)).alias("b")).select("a", F.least(F.col("b"), _drawn(F.col("a"), turn))["key"].alias("to")), "parents")
        if label is None:
            label, path = to.select(F.col("a").alias("key"), F.col("to").alias("label")), to_path
        else:
            joined = label.join(to.withColumnRenamed("a", "label"), "label", "left").select("key", F.coalesce("to", "label").alias("label"))
            label, new = write_table(joined, "labels")
            paths.append(path)
            path = new
            paths.append(to_path)
        fewer = (
            edges.join(to.withColumnsRenamed({"a": "a", "to": "x"}), "a")
            .join(to.withColumnsRenamed({"a": "b", "to": "y"}), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges, edges_path = write_table(fewer, "edges")
        paths.append(edges_path)
        if edges.isEmpty():
            break
    drop_table(spark, *paths)
    return label, [path]


def _classes(df: DataFrame, doc_id: str, text: str, size: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (doc_id, key, n_shingles) and key, label of those keys that are linked to others; and tables to drop."""
    spark = df.sparkSession
    signed, signed_path = write_table(_signed(df, text_column(df, doc_id), text_column(df, text), size, bands, rows), "signatures")
    label, label_paths = linked(signed, threshold)
    narrow, narrow_path = write_table(signed.select("doc_id", "key", "n_shingles"), "keys")
    drop_table(spark, signed_path)
    return narrow, label, [narrow_path, *label_paths]


def find(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, class_id (the least id of the class), class_size (rows) and n_shingles of every row of df.

    Texts with equal words are in one class, and so are texts linked by a similarity of threshold or
    more, directly or through others.  A null text, an empty one and one without words is a class of its
    own.  Null ids are ignored for class_id, which is null if a class has no other; repeated rows are
    kept and count.  Other columns are left out; an empty table gives no rows.
    """
    keyed, label, temporary = _classes(df, doc_id, text, size, threshold, bands, rows)
    # one row for each distinct content first, so that a group of copies is not moved copy by copy
    contents = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    labelled = contents.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_key = labelled.select("key", "label").join(sizes, "label").select("key", "class_id", "class_size")
    out = write_result(
        keyed.join(of_key, "key", "left").select(
            "doc_id",
            F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
            "n_shingles",
        ),
        "classes",
    )
    drop_table(df.sparkSession, *temporary)
    return out


def keep_first(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """df with one row of each class: the one with the least id, of equal ids any.  Texts without words all stay."""
    spark = df.sparkSession
    keyed, label, temporary = _classes(df, doc_id, text, size, threshold, bands, rows)
    order = F.struct(F.col("doc_id").isNull().alias("null_last"), "doc_id")
    contents = keyed.where("key is not null").groupBy("key").agg(F.min(order).alias("least"), F.count("*").alias("n"))
    labelled = contents.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    best = labelled.groupBy("label").agg(F.min(F.struct("least", "key")).alias("best"), F.sum("n").alias("rows")).where("rows > 1")
    verdict = write_result(labelled.select("key", "label").join(best, "label").select("key", (F.col("best.key") == F.col("key")).alias("stays")), "verdicts")
    drop_table(spark, *temporary)
    made = write_result(_filter_of(verdict), "filter")

    inner = [f"c{i}" for i in range(len(df.columns))]
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, inner)])
    body, ident = inner[df.columns.index(text_column(df, text))], inner[df.columns.index(text_column(df, doc_id))]
    schema = T.StructType(plain.schema.fields + [T.StructField("key", T.BinaryType())])
    where = inner.index(body)

    def add_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("near_duplicates")
        for b in slices(batches):
            data = [(t or "").encode() for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, binaries(content_keys(data))], names=schema.fieldNames())

    marked = _may_be_in(plain.mapInArrow(add_key, schema), made)
    alone = marked.where("not may_be").select(*inner)
    # only rows that may have a duplicate are moved; copies meet in partial aggregates
    judged = marked.where("may_be").join(verdict, "key", "left")
    others = judged.where("stays is null").select(*inner)
    first = (
        judged.where("stays")
        .groupBy("key")
        .agg(F.min_by(F.struct(*inner), F.struct(F.col(ident).isNull().alias("null_last"), F.col(ident).alias("id"))).alias("row"))
        .select("row.*")
    )
    kept = alone.unionByName(others).unionByName(first)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(inner, df.columns)])
