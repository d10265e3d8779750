"""Operator 3 against a trie in plain Python and plain counts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bytegrams, ppm
from millrace.llm.common import crc32_of


def trie(texts, order):
    counts = defaultdict(Counter)
    for t in texts:
        ppm.adaptive_code_length(t, order, counts)
    return counts


def grams_of(counts, order):
    out = []
    for k in range(order + 1):
        rows = sorted((int.from_bytes(c + bytes([s]), "big"), n) for c, table in counts.items() if len(c) == k for s, n in table.items())
        out.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)))
    return out


words = st.lists(st.text(alphabet="abé ", max_size=12).map(str.encode), max_size=6)


@settings(max_examples=150, deadline=None)
@given(words, words, st.integers(0, 4))
def test_automaton_equals_trie(train, test, order):
    counts = trie(train, order)
    want = [ppm.adaptive_code_length(t, order, counts, learn=False) for t in test]
    got = ppm.Automaton(grams_of(counts, order)).code_lengths(test)
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-6)


def test_automaton_probabilities_sum_to_one():
    a = ppm.Automaton(grams_of(trie([b"abracadabra", b"abba"], 3), 3))
    seen = np.flatnonzero(a.classes != a.other)
    total = (10.0 ** -a.cost[:, : a.other].astype(float)).sum(1) + (256 - len(seen)) * 10.0 ** -a.cost[:, a.other].astype(float)
    np.testing.assert_allclose(total, 1, rtol=1e-5)


def test_segments_do_not_change_scores():
    r = np.random.default_rng(1)
    data = [bytes(r.choice(list(b"abcd "), n).tolist()) for n in (0, 1, 255, 256, 257, 511, 5000)]
    counts = trie(data[:4], 3)
    a = ppm.Automaton(grams_of(counts, 3))
    np.testing.assert_allclose(a.code_lengths(data), [ppm.adaptive_code_length(d, 3, counts, learn=False) for d in data], rtol=1e-5)


def test_counts_of_grams(spark, odd_documents):
    got = {r["key"]: r["n"] for r in bytegrams.count_grams(odd_documents.select("text"), 3).collect()}
    want = Counter()
    for (t,) in odd_documents.select("text").collect():
        b = b"\xff\xff" + (t or "").encode() + b"\xff"
        want.update(int.from_bytes(b[i : i + 3], "big") for i in range(len(b) - 2))
    assert got == want


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
@pytest.mark.parametrize("hot", [0, 100, 1 << 18])
def test_scores(which, hot, request):
    df = request.getfixturevalue(which)
    if which == "documents":
        df = df.where("n_chars < 1500").limit(60)
    learn = F.coalesce(crc32_of(df, "doc_id"), F.lit(0)) % 7 != 2
    got = ppm.score(df, learn_from=learn, order=3, hot=hot).collect()
    rows = [(d, (t or "").encode()) for d, t in df.select("doc_id", "text").collect()]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    train = [t for (_, t), h in zip(rows, held) if not h]
    counts = Counter(w for t in train for w in t.lower().split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    trained = trie([t for t in train], 3)
    want = defaultdict(list)
    for (d, t), h in zip(rows, held):
        ws = t.lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        want[d, h, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n].append((base, -ppm.adaptive_code_length(t, 3, trained, learn=False)))
    have = defaultdict(list)
    for r in got:
        have[tuple(r)[:5]].append((r["base_score"], r["score"]))
    assert have.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(sorted(have[k]), sorted(want[k]), rtol=1e-4)


def test_no_training_texts_and_empty_table(odd_documents):
    got = ppm.score(odd_documents.limit(3), learn_from=F.lit(False)).collect()
    assert [r["train_tokens"] for r in got] == [0] * 3 and all(r["n_known"] == 0 for r in got)
    assert ppm.score(odd_documents.limit(0)).count() == 0


def test_bounded_model_and_adaptive(documents):
    small = ppm.train(documents.select("text"), 4, 500)
    assert sum(len(np.unique(k >> np.uint64(8))) for k, _ in small) <= 500
    some = documents.where("n_chars < 400").limit(5)
    rows = {r["doc_id"]: r["score"] for r in ppm.score(some, adaptive=True).collect()}
    assert rows == {d: -ppm.adaptive_code_length(t.encode()) for d, t in some.select("doc_id", "text").collect()}


@pytest.mark.parametrize("hot_grams", [0, 3000, 1 << 20])
def test_every_counted_context_is_in_the_model(spark, hot_grams):
    # more contexts than the 100,000 that the model was once bounded by
    r = np.random.default_rng(3)
    rows = [(i, bytes(r.choice(list(b"abcdefghijklmnop "), 30_000).tolist()).decode()) for i in range(6)] + [(6, "abc"), (7, "unseen ZZ bytes é"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.score(df, learn_from=F.col("doc_id") % 3 != 1, hot_grams=hot_grams).collect()}
    trained = trie([(t or "").encode() for i, t in rows if i % 3 != 1], 5)
    assert len(trained) > 150_000
    want = {i: -ppm.adaptive_code_length((t or "").encode(), 5, trained, learn=False) for i, t in rows}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[i] for i in want], list(want.values()), rtol=1e-5)
