"""Operator 10: features and updates against plain Python, held-out accuracy, odd rows."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality_classifier as qc
from millrace.llm.queries import held_out

SF = "/root/testdata/sf0.1"


def test_features_count_words_and_pairs():
    data = [b"", b"the cat the cat sat!!", b"a a a a", "ñandú|x".encode(), b"\n \n"]
    text, bucket, value = qc.features(data)
    sizes = Counter(text.tolist())
    # the cat, cat the, cat sat, sat !!, and four words
    assert sizes == {1: 8, 2: 4, 3: 5}
    for t in sizes:
        assert math.isclose((value[text == t] ** 2).sum(), 1)
    top = value[text == 1]
    assert math.isclose(top.max() / top.min(), 1 + math.log(2))
    again = qc.features([b"zzz", b"the cat the cat sat!!"])
    assert set(again[1][again[0] == 1]) == set(bucket[text == 1])


def test_update_is_ftrl_proximal():
    m = qc.Ftrl(alpha=0.1, beta=1.0, l1=0.01, l2=0.2)
    z = n = w = 0.0
    for label in (1, 0, 1, 1):
        m.learn(np.array([3, qc.BUCKETS]), np.array([0.5, 1.0]), label)
    zb = nb = wb = 0.0
    for label in (1, 0, 1, 1):
        w = 0.0 if abs(z) <= 0.01 else -(z - math.copysign(0.01, z)) / ((1 + math.sqrt(n)) / 0.1 + 0.2)
        wb = -zb / ((1 + math.sqrt(nb)) / 0.1 + 0.2)
        p = 1 / (1 + math.exp(-(0.5 * w + wb)))
        for g, which in (((p - label) * 0.5, 0), (p - label, 1)):
            if which == 0:
                s = (math.sqrt(n + g * g) - math.sqrt(n)) / 0.1
                z, n = z + g - s * w, n + g * g
            else:
                s = (math.sqrt(nb + g * g) - math.sqrt(nb)) / 0.1
                zb, nb = zb + g - s * wb, nb + g * g
    np.testing.assert_allclose([m.z[3], m.n[3], m.z[-1], m.n[-1]], [z, n, zb, nb], rtol=1e-12)


def test_held_out_accuracy(spark):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = qc.classify(df, labels, lambda d: ~held_out(d), keep=["doc_id"])
    rows = got.join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert (good.predicted == 1).mean() > 0.99 and (bad.predicted == 0).mean() > 0.95
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def test_odd_rows_and_no_labels(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 7), (5, 1), (5, 0)], "doc_id long, quality int")
    got = qc.classify(odd_documents.withColumn("Score", F.lit("x")), labels, lambda d: F.lit(True))
    assert got.columns == [*odd_documents.columns, "Score", "_score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd_documents.count() and all(0 < r["_score"] < 1 for r in rows)
    none = qc.classify(odd_documents, labels.limit(0), lambda d: F.lit(True), keep=["doc_id"]).collect()
    assert {r["score"] for r in none} == {0.5}
    assert qc.classify(odd_documents.limit(0), labels, lambda d: F.lit(True)).count() == 0


def test_only_keeps_accepted_rows(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    both = {r["doc_id"]: r["predicted"] for r in qc.classify(documents, labels, lambda d: ~held_out(d), keep=["doc_id"]).collect()}
    kept = qc.classify(documents, labels, lambda d: ~held_out(d), only=True)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, p in both.items() if p}
