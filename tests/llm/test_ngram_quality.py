"""Operator 4: counts against plain Python, the model against plain Kneser-Ney, verdicts."""

import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import ngram_quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def rows(data):
    made = q.rule_counts(data)
    return list(zip(*(made[c].tolist() for c in (*q.COUNTS, "base_failed"))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\r\t\x0b\x1c #|日")), max_size=5))
def test_rule_counts(texts):
    assert rows([t.encode() for t in texts]) == [plain_counts(t) for t in texts] if texts else True


def test_rule_counts_of_tables(documents, odd_documents):
    for df in (documents, odd_documents):
        texts = [t or "" for (t,) in df.select("text").collect()]
        assert rows([t.encode() for t in texts]) == [plain_counts(t) for t in texts]


def plain_discounts(counts):
    n1, n2, n3, n4 = (counts[i] for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, d2), (3, d3)))


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney of bytes, computed the plain way."""
    top = Counter()
    for t in texts:
        b = b"\xff" * (order - 1) + t + b"\xff"
        top.update(b[i : i + order] for i in range(len(b) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {k: plain_discounts(Counter(c.values())) for k, c in counts.items()}
    by_context = defaultdict(dict)
    for c in counts.values():
        for g, n in c.items():
            by_context[g[:-1], len(g)][g] = n

    @lru_cache(maxsize=None)
    def prob(gram):
        if not gram:
            return 1 / 256
        table = by_context.get((gram[:-1], len(gram)))
        lower = prob(gram[1:])
        if not table:
            return lower
        d, total = discounts[len(gram)], sum(table.values())
        gamma = sum(d[min(n, 3) - 1] for n in table.values()) / total
        own = max(table[gram] - d[min(table[gram], 3) - 1], 0) / total if gram in table else 0
        return own + gamma * lower

    return prob


def plain_cost(prob, data, order):
    b = b"\xff" * (order - 1) + data + b"\xff"
    return -sum(math.log10(prob(b[i : i + order])) for i in range(len(b) - order + 1)) / (len(data) + 1)


def test_plain_model_sums_to_one():
    prob = plain_model([b"abracadabra", b"abba", b"", b"cab abra"], 3)
    for context in (b"\xff\xff", b"br", b"zz", b"ab", b"\xffa"):
        assert math.isclose(sum(prob(context + bytes([x])) for x in range(256)), 1, rel_tol=1e-9)


@pytest.mark.parametrize("hot", [0, 200, 1 << 20])
@pytest.mark.parametrize("by_lang", [True, False])
def test_perplexities_equal_plain_kneser_ney(spark, hot, by_lang):
    """Whatever part of the model is broadcast; texts with many symbols are judged but not learnt from."""
    r = random.Random(5)
    words = ["the", "thand", "ing", "éa", "abra", "cad", "über"]
    texts = [" ".join(r.choice(words) + str(r.randrange(40)) for _ in range(r.randrange(5, 40))) for _ in range(60)]
    texts += [" ".join(f"w{i}%%%" for i in range(15)), " ".join(f"x{i * 7}" for i in range(1, 30)), "日本 " + texts[0], texts[1], texts[1]]
    rows = [(i, t, [None, "en", "fr"][i % 3]) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in q.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lang="lang" if by_lang else None, order=3, hot=hot).collect()}
    learnt = defaultdict(list)
    for i, t, lang in rows:
        n_words, _, symbols, _, _, failed = plain_counts(t)
        if not failed and symbols * 10 <= n_words:
            learnt[lang if by_lang else None].append(t.encode())
    models = {k: plain_model(v, 3) for k, v in learnt.items()}
    ppl = {}
    for i, t, lang in rows:
        if plain_counts(t)[5]:
            assert got[i]["log10_ppl"] is None and not got[i]["kept"]
        else:
            ppl[i] = plain_cost(models[lang if by_lang else None], t.encode(), 3)
            assert math.isclose(got[i]["log10_ppl"], ppl[i], abs_tol=1e-6)
    # bands, over distinct texts
    for lang in learnt:
        mine = {t: ppl[i] for i, t, g in rows if i in ppl and (g == lang or not by_lang)}
        x = sorted(round(p * q.BIN) for p in mine.values())
        middle = x[(len(x) - 1) // 2]
        apart = sorted(abs(v - middle) for v in x)[(len(x) - 1) // 2]
        some = next(got[i] for i, _, g in rows if i in ppl and (g == lang or not by_lang))
        assert math.isclose(some["low"], (middle - q.BELOW * apart) / q.BIN - q.MARGIN, abs_tol=q.BELOW * 2e-4)
        assert math.isclose(some["high"], (middle + q.ABOVE * apart) / q.BIN + q.MARGIN, abs_tol=q.ABOVE * 2e-4)


def test_costs_of_grams_are_a_distribution_s(spark):
    """Every gram's cost is that of plain Kneser-Ney, whose next-byte probabilities sum to 1 (see above)."""
    base = " ".join(f"word{i}" for i in range(12))
    more = [base + chr(c) for c in range(1, 128) if chr(c) not in "#*$%&|<>"] * 2
    df = spark.createDataFrame([(t, 1) for t in more], "text string, grp long")
    costs, _ = q.gram_costs(df, 3)
    rows = costs.collect()
    of = {r["gram"]: r["cost"] for r in rows}
    prob = plain_model([t.encode() for t in more if not plain_counts(t)[5]], 3)
    assert len(of) > 120
    for g, c in of.items():
        assert math.isclose(10 ** (-c / q.UNIT), prob(g.to_bytes(3, "big")), rel_tol=1e-5)


def test_hash_arrays_find_what_is_there():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    a = q.HashArrays(keys[::2], np.arange(len(keys[::2])))
    at = a.find(keys)
    assert (at[1::2] == -1).all() and (a.cost[at[::2]] == np.arange(len(keys[::2]))).all()
    assert (q.HashArrays(keys[:0], np.zeros(0)).find(keys) == -1).all()


def test_verdicts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    noise = spark.range(1).select(
        F.lit(-1).cast("long").alias("doc_id"), F.lit(" ".join("qzx%dkwj@vq~" % i for i in range(300))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars")
    )
    both = df.union(noise)
    got = q.assess(both).toPandas().set_index("doc_id")
    assert not got.loc[-1, "base_failed"] and not got.loc[-1, "kept"]
    assert not (got.kept & got.base_failed).any()
    good = labels.where("quality = 1").toPandas().doc_id
    clean = got.loc[good]
    assert clean.kept[~clean.base_failed].mean() > 0.99
    bad = got.loc[labels.where("quality = 0").toPandas().doc_id]
    assert bad.kept.mean() < 0.1
    for hot in (q.HOT_GRAMS, 2000):
        assert {r["doc_id"] for r in q.keep_good(both, hot=hot).collect()} == set(got.index[got.kept])


def test_verdicts_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = [{r["doc_id"]: (r["log10_ppl"], r["low"], r["high"], r["kept"]) for r in q.assess(d, hot=hot).collect()} for d, hot in ((df, 1 << 20), (df.repartition(7), 3000))]
    assert made[0] == made[1]


def test_junk_and_copies_do_not_move_the_band(spark):
    """A fifth of junk, and a third of all rows one text: both leave clean texts alone, and junk goes."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    clean = q.assess(df).where("kept").select("doc_id").join(df, "doc_id")
    n = clean.count()
    junk = clean.limit(n // 4).select((-F.col("doc_id") - 1).alias("doc_id"), F.regexp_replace("text", r"(\w)\s", "$1&&& ").alias("text"), "lang")
    one = clean.orderBy("doc_id").limit(1).crossJoin(spark.range(n // 2).withColumnRenamed("id", "k")).select((F.lit(1_000_000) + F.col("k")).alias("doc_id"), "text", "lang")
    got = q.assess(clean.union(junk).union(one)).toPandas().set_index("doc_id")
    assert got.kept[got.index >= 0].mean() > 0.99 and got.kept[got.index < 0].mean() < 0.05


def test_odd_rows(odd_documents):
    got = q.assess(odd_documents).collect()
    texts = [t or "" for (t,) in odd_documents.select("text").collect()]
    assert sorted(tuple(r)[1:7] for r in got) == sorted(plain_counts(t) for t in texts)
    more = odd_documents.withColumn("tag", F.lit("x")).withColumn("base_failed", F.lit("y"))
    assert q.keep_good(more).columns == more.columns
    assert q.assess(odd_documents.limit(0)).count() == 0 and q.keep_good(odd_documents.limit(0)).count() == 0
