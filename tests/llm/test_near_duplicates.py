"""Operator 5 against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_duplicates as nd
from millrace.llm.wordvec import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_classes(rows):
    """Class of each row's position, by comparing all pairs."""
    sets = [shingle_set(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i]) * 0.8 <= len(sets[j]) <= len(sets[i]) / 0.8:
                n = len(sets[i] & sets[j])
                if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                    parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def partition(pairs):
    groups = {}
    for row, c in pairs:
        groups.setdefault(c, []).append(row)
    return sorted(sorted(g) for g in groups.values())


@pytest.fixture(scope="module")
def copies(spark):
    """Copies, chains of near copies, a common passage, short texts and repeated rows."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    texts = []
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([20, 80, 300]))]
        texts += [" ".join(base)] * r.choice([1, 3])
        for _ in range(4):
            base = list(base)
            for _ in range(max(1, len(base) // 150)):
                base[r.randrange(len(base))] = r.choice(vocabulary)
            texts.append(" ".join(base))
    texts += [f"{passage} {' '.join(r.choice(vocabulary) for _ in range(30))}" for _ in range(10)]
    texts += ["one two", "one  two\n", "one", None, "", " ", "a b c d e", "a b c d e", "x " * 50, "x " * 60]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return spark.createDataFrame([(i, t, "k", {"a": i}) for i, t in rows], "doc_id long, text string, key string, m map<string,int>").repartition(5)


def test_classes_equal_all_pairs(copies):
    rows = [(r["doc_id"], r["text"]) for r in copies.collect()]
    want = partition((d, c) for (d, _), c in zip(rows, plain_classes(rows)))
    got = nd.find(copies).collect()
    assert partition((r["doc_id"], r["class_id"]) for r in got) == want
    sizes = Counter(r["class_id"] for r in got)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    assert all(r["class_id"] == min(x["doc_id"] for x in got if x["class_id"] == r["class_id"]) for r in got)


def test_classes_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = partition((d, c) for (d, _), c in zip(rows, plain_classes(rows)))
    assert partition((r["doc_id"], r["class_id"]) for r in nd.find(df).collect()) == want


def test_one_row_of_each_class_stays(copies):
    kept = nd.keep_first(copies)
    assert kept.columns == copies.columns
    want = {r["class_id"] for r in nd.find(copies).collect()}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got) == sorted(want)
    before = {r["doc_id"]: (r["text"], r["key"], r["m"]) for r in copies.collect()}
    assert all(before[r["doc_id"]] == (r["text"], r["key"], r["m"]) for r in kept.collect())


def test_repeated_ids_and_nulls(odd_documents):
    got = nd.find(odd_documents)
    assert got.count() == odd_documents.count()
    cat = got.where("class_size > 1 and n_shingles = 1").collect()
    assert len(cat) == 4 and {r["class_id"] for r in cat} == {5}
    kept = nd.keep_first(odd_documents)
    texts = Counter(r["text"] for r in kept.collect())
    assert texts["the cat"] == 1 and texts[None] == texts[""] == texts[" "] == 1
    assert nd.find(odd_documents.limit(0)).count() == 0 and nd.keep_first(odd_documents.limit(0)).count() == 0


def test_registers_agree_as_often_as_weights_do():
    r = np.random.default_rng(0)
    n, m = 40, 2000
    h = r.integers(1, 1 << 40, n, dtype=np.uint64)
    x, y = r.integers(0, 4, n), r.integers(0, 4, n)
    both = [(np.flatnonzero(w), w[w > 0]) for w in (x, y)]
    doc = np.concatenate([np.full(len(at), i) for i, (at, _) in enumerate(both)])
    sig = nd.prob_minhash(doc, np.concatenate([h[at] for at, _ in both]), np.concatenate([w for _, w in both]), 2, m)
    want = sum(1 / sum(max(x[k] / x[d], y[k] / y[d]) for k in range(n)) for d in range(n) if x[d] and y[d])
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_shingles_count_places():
    doc, h, weight = nd.shingles(words_of([b"a b c d e a b c d e", b"", b"x y", b"x y"]))
    assert Counter(doc.tolist()) == {0: 5, 2: 1, 3: 1} and sorted(weight[doc == 0].tolist()) == [1, 1, 1, 1, 2]
    assert h[doc == 2] == h[doc == 3]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201)]
    r = random.Random(1)
    names = {i: r.randbytes(16) for e in edges for i in e}
    df = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a binary, b binary")
    label, _ = nd.components(df)
    back = {v: k for k, v in names.items()}
    groups = partition((back[bytes(r["key"])], bytes(r["label"])) for r in label.collect())
    assert groups == [list(range(41)), list(range(100, 160)), [200, 201]]


def test_components_of_an_ordered_path_need_few_rounds(spark, monkeypatch):
    """Keys in ascending order along a path: rounds grow as the logarithm of its length."""
    rounds = []
    write = nd.write_table
    monkeypatch.setattr(nd, "write_table", lambda df, what, *a, **k: (rounds.append(what), write(df, what, *a, **k))[1])
    edges = [(i.to_bytes(4, "big"), (i + 1).to_bytes(4, "big")) for i in range(128)]
    label, _ = nd.components(spark.createDataFrame(edges, "a binary, b binary"))
    assert label.select("label").distinct().count() == 1 and label.count() == 129
    assert rounds.count("edges") <= 14


def test_groups_of_variants_that_meet_in_common_buckets(spark, copies):
    """Several groups of variants of one passage, beside the other copies."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(x["doc_id"], x["text"]) for x in copies.collect()]
    for group in range(3):
        own = [f"g{group}x{i}" for i in range(25)]
        for _ in range(10):
            words = passage + own
            words[r.randrange(len(words))] = f"v{r.randrange(10**6)}"
            rows.append((1000 + len(rows), " ".join(words)))
    want = partition((d, c) for (d, _), c in zip(rows, plain_classes(rows)))
    got = nd.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert partition((x["doc_id"], x["class_id"]) for x in got) == want


def test_repetitions_do_not_part_links(spark):
    # each pair has nearly equal sets of shingles, of which the second text repeats some 40 times
    rows = []
    for i in range(30):
        whole = [f"w{i}x{j}" for j in range(104)]
        rows += [(2 * i, " ".join(whole)), (2 * i + 1, " ".join(whole + whole[:24] * 40))]
    got = {r["doc_id"]: r["class_id"] for r in nd.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingle_set(t) for _, t in rows]
    assert all(len(x & y) >= 0.8 * len(x | y) for x, y in zip(sets[::2], sets[1::2]))
    assert got == {d: d - d % 2 for d, _ in rows}
