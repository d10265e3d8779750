"""Operator 10: quality classifier, a logistic regression on hashed word n-grams.

A text's words are its runs of letters, digits and non-ASCII characters, and its runs of symbols.  A
word that repeats the one before it counts as the mark of a repetition.  Words and pairs of words are
hashed to buckets; a bucket's value is 1 + ln(count), and values are scaled to a Euclidean length of
1, beside a bias of 1.  Weights are learnt by follow-the-regularised-leader updates (FTRL-proximal,
per-coordinate rates, L1 and L2), example by example.  A score is a sparse dot product and a sigmoid.

Training takes a bounded sample: of the labelled rows that may be learnt from, the `max_train` whose
ids' hashes are smallest.  Scoring takes every row, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_name, give_back, groups_of, mix64, map_batches, serve, text_column, texts
from .wordvec import SPACE, span_hashes

BUCKETS = 1 << 18
#: Labelled rows that are learnt from at most, and how many examples are shown: each row 3 times at least.
MAX_TRAIN, SHOWN = 6000, 18_000
#: Bytes of text at most that are learnt from.
MAX_TRAIN_BYTES = 64 << 20
#: FTRL-proximal: rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_REPEATED = np.uint64(0x5DEECE66D)


def features(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and value of every feature of the given texts, in order of text and bucket."""
    joined = b"\n".join(data) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    text_start = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in data], out=text_start[1:])
    kind = _KIND[buf]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    end = np.append(edge[1:], len(buf))
    word = kind[edge] != 0
    start, end = edge[word], end[word]
    h = span_hashes(buf, start, end)
    doc = np.searchsorted(text_start, start, side="right") - 1
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    h[same] = _REPEATED
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both = mix64(h[pair] * np.uint64(3) + h[pair + 1])
    mask = np.uint64(BUCKETS - 1)
    shift = np.uint64(BUCKETS.bit_length() - 1)
    keys = np.sort(np.concatenate([(doc.astype(np.uint64) << shift) | (h & mask), (doc[pair].astype(np.uint64) << shift) | (both & mask)]))
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(at, len(keys)))
    value = 1 + np.log(count)
    text = (keys[at] >> shift).astype(np.int64)
    length = np.sqrt(np.bincount(text, value * value, len(data)))
    return text, (keys[at] & mask).astype(np.int64), value / length[text]


class Ftrl:
    """Weights by FTRL-proximal; the last weight is the bias, which has no L1."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        """One example: its buckets with the bias last, their values, and its label."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sample(df: DataFrame, labels: DataFrame, allowed, label: str, doc_id: str, text: str, max_train: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of a bounded sample of labelled rows for which allowed(doc_id column) is true.

    The sample has the max_train rows whose ids' hashes are smallest, as far as their texts together have
    MAX_TRAIN_BYTES bytes at most.
    """
    key, target = text_column(labels, doc_id), text_column(labels, label)
    known = labels.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{target}`").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & allowed(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    chosen = known.orderBy(*order).limit(max_train)
    rows = df.select(F.col(f"`{text_column(df, doc_id)}`").alias("doc_id"), F.col(f"`{text_column(df, text)}`").alias("text"))
    # max_train rows at most are broadcast, and as many come back
    some = rows.join(F.broadcast(chosen), "doc_id").orderBy(*order, F.xxhash64("text")).limit(max_train)
    upto = Window.orderBy(*order, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    found = some.withColumn("bytes", F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(upto)).where(F.col("bytes") <= MAX_TRAIN_BYTES).select("text", "label").toArrow()
    return [(t or "").encode() for t in found.column(0).to_pylist()], np.array(found.column(1).to_pylist(), np.int64)


def fit(data: list[bytes], labels: np.ndarray, shown: int = SHOWN) -> np.ndarray:
    """Weights of the buckets and the bias, learnt from the given examples in a fixed order."""
    model = Ftrl()
    parts = []
    for lo, hi in groups_of(data):
        text, bucket, value = features(data[lo:hi])
        at = np.searchsorted(text, np.arange(hi - lo + 1))
        parts += [(np.append(bucket[a:b], BUCKETS).astype(np.int32), np.append(value[a:b], 1.0)) for a, b in zip(at, at[1:])]
    for epoch in range(max(3, min(60, shown // max(1, len(parts))))):
        for i in np.random.default_rng(epoch).permutation(len(parts)):
            model.learn(*parts[i], labels[i])
    return model.weights()


def scores(weights: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Probabilities of label 1 of the given texts."""
    out = np.zeros(len(data))
    for lo, hi in groups_of(data):
        text, bucket, value = features(data[lo:hi])
        out[lo:hi] = np.bincount(text, weights[bucket] * value, hi - lo)
    return 1 / (1 + np.exp(-np.clip(out + weights[-1], -35, 35)))


def classify(
    df: DataFrame,
    labels: DataFrame,
    allowed,
    label: str = "quality",
    threshold: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    max_train: int = MAX_TRAIN,
    only: bool = False,
) -> DataFrame:
    """Columns `keep` of df (all, by default), score (0 to 1) and predicted (1 if score >= threshold, else 0).

    labels has doc_id and the label column, 0 or 1; other labels and null ids are not learnt from.
    allowed takes a column of ids and says which may be learnt from.  Scores depend on texts alone; a
    null text counts as empty, and an empty one has the bias's score (0.5 if there is nothing to
    learn from).  Rows are kept as they are, repeated ones too; clashing new names get underscores.
    With only=True, rows that are predicted 0, and the new columns, are left out.
    """
    source = text_column(df, text)
    keep = [text_column(df, c) for c in keep] if keep is not None else df.columns
    weights = fit(*sample(df, labels, allowed, label, doc_id, text, max_train))
    give_back()
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # BUCKETS numbers
    kept = df.select(*[f"`{c}`" for c in keep])
    fields = list(kept.schema.fields)
    if not only:
        fields += [T.StructField(column_name(kept, "score"), T.DoubleType()), T.StructField(column_name(kept, "predicted"), T.IntegerType())]
    schema = T.StructType(fields)
    body = column_name(kept, "text_")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        serve("quality_classifier")
        p = scores(shared.value, [t.encode() for t in texts(b, body)])
        columns = [b.column(i) for i in range(len(keep))]
        if only:
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames()).filter(pa.array(p >= threshold))
        return pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.fieldNames())

    return map_batches(df.select(*[f"`{c}`" for c in keep], F.col(f"`{source}`").alias(body)), work, schema)
