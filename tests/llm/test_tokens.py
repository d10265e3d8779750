"""Operators 1, 2, 6 and 8 against the tokenizers' own libraries."""

import bisect
import hashlib
import itertools
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import common, packing, sentencepiece_codec, token_counts, token_store
from millrace.llm.byte_bpe import byte_bpe


def pack32(ids):
    return np.array(ids, "<u4").tobytes()


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_sentencepiece_equals_library(which, request):
    df = request.getfixturevalue(which)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = Counter()
    for d, t in rows_of(df):
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want[d, len(ids), hashlib.sha256(pack32(ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    got = sentencepiece_codec.encode_decode(df, keep=["doc_id"], with_ids=False, check_every=1)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_sentencepiece_keeps_clashing_columns(odd_documents):
    got = sentencepiece_codec.encode_decode(odd_documents, keep=["doc_id", "n_tokens", "ids_sha256"])
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "_n_tokens", "_ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert all(len(r["ids"]) == r["_n_tokens"] for r in got.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the\n▁é日😀\t<s>0'")))
def test_sentencepiece_any_text(text):
    c = sentencepiece_codec.codec(P.path("piece_bpe_32k.model"))
    ids = c.encode(text, True, True)
    c.check_text(text, ids, c.decode(ids))
    c.check_fresh()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'ves tlld\n\t\r12²½_!é–—€×ª \x1c日")))
def test_byte_bpe_any_text(text):
    b = byte_bpe(P.path("byte_bpe_50k.json"))
    assert b.encode_batch([text]) == [b.whole(text)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'VeS tLld\n\t\r12²½_!éÉ–—€×ª \x1c日İΣ")))
def test_pre_tokens_any_text(text):
    p = token_counts.pre_tokens(P.path("word_bpe_49k.json"))
    assert sum(p.pieces(p.cut(text)[0])) == len(p.library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
@pytest.mark.parametrize("shards", [1, 5])
def test_token_store_round_trip(which, shards, request, spark, byte_library, tmp_path):
    df = request.getfixturevalue(which)
    path = token_store.write_store(df, str(tmp_path / "store"), shards=shards)
    got = token_store.read_store(spark, path).collect()
    want = Counter()
    sizes = defaultdict(int)
    for d, t in rows_of(df):
        ids = [*byte_library.encode(t, add_special_tokens=False).ids, 0]
        want[d, len(ids), zlib.crc32(pack32(ids)), tuple(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_token_store_short_access_and_damage(spark, documents, tmp_path):
    path = token_store.write_store(documents, str(tmp_path / "s"))
    whole = {r["doc_id"]: r for r in token_store.read_store(spark, path).collect()}
    some = token_store.read_store(spark, path, doc_ids=[3, 77]).collect()
    assert {r["doc_id"]: r for r in some} == {d: whole[d] for d in (3, 77)}
    other = token_store.write_store(documents.limit(60), str(tmp_path / "o"))
    spark.read.parquet(f"{other}/dictionary").write.parquet(f"{tmp_path}/x/dictionary")
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{tmp_path}/x/blocks")
    with pytest.raises(Exception, match="dictionary"):
        token_store.read_store(spark, f"{tmp_path}/x").collect()


def test_a_store_of_string_ids_is_in_their_order(spark, documents, tmp_path):
    df = documents.limit(120).withColumn("doc_id", F.when(F.col("doc_id") % 10 == 3, F.lit(None)).otherwise(F.concat(F.lit("é"), F.col("doc_id").cast("string"))))
    path = token_store.write_store(df, str(tmp_path / "strings"), shards=7)
    got = token_store.read_store(spark, path, with_ids=False).orderBy("start").collect()
    names = [r["doc_id"] for r in got]
    assert names == sorted(names, key=lambda d: (d is not None, d or "")) and len(names) == 120
    assert spark.read.parquet(f"{path}/blocks").select("shard").distinct().count() > 3
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_kinds_of_pieces():
    path = P.path("piece_bpe_32k.model")
    assert 1 in sentencepiece_codec.piece_kinds(path) and sentencepiece_codec.USER_DEFINED not in sentencepiece_codec.piece_kinds(path)
    piece = b"\x0a\x02ab\x15\x00\x00\x80\x3f\x18\x04"
    assert dict(sentencepiece_codec._fields(piece)) == {1: b"ab", 2: b"\x00\x00\x80\x3f", 3: 4}


def test_results_can_be_dropped(spark, documents):
    made = packing.pack_documents(documents.limit(5))
    assert made.count() and made.inputFiles()
    common.drop_results(spark)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in made.inputFiles())


def test_empty_tables(spark, documents, tmp_path):
    none = documents.limit(0)
    assert sentencepiece_codec.encode_decode(none).count() == 0
    assert token_store.read_store(spark, token_store.write_store(none, str(tmp_path / "e"))).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
@pytest.mark.parametrize("capacity", [1024, 7])
def test_packing_places_every_piece_once(which, capacity, request, byte_library):
    df = request.getfixturevalue(which)
    got = packing.pack_documents(df, capacity).collect()
    want = Counter()
    for d, t in rows_of(df):
        ids = [*byte_library.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[d, i, lo, hi - lo, zlib.crc32(pack32(ids[lo:hi]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= best_fit_decreasing([r["length"] for r in got], capacity)


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    """Sequences that plain best fit needs, piece by piece."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - x)
    return len(gaps)


def fewest(lengths: list[int], capacity: int) -> int:
    """Sequences at least needed, by trying every way."""
    lengths = sorted(lengths, reverse=True)
    best = best_fit_decreasing(lengths, capacity)

    def put(i: int, gaps: tuple[int, ...]) -> None:
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for g in set(gaps):
            if g >= lengths[i]:
                rest = list(gaps)
                rest.remove(g)
                put(i + 1, tuple(sorted([*rest, g - lengths[i]])))
        put(i + 1, tuple(sorted([*gaps, capacity - lengths[i]])))

    put(0, ())
    return best


def sequences_of(lengths: list[int], capacity: int) -> int:
    return sum(n for _, n in packing.plan(Counter(lengths), capacity))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plan_is_near_the_fewest_sequences(lengths):
    assert sequences_of(lengths, 20) <= fewest(lengths, 20) + 1


@pytest.mark.parametrize("low, high", [(1, 1023), (200, 700), (250, 400), (300, 380), (1, 200)])
def test_plan_is_no_worse_than_best_fit(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 3000).tolist()
    n = sequences_of(lengths, 1024)
    assert -(-sum(lengths) // 1024) <= n <= best_fit_decreasing(lengths, 1024)


def test_sum_index_finds_what_all_combinations_have():
    counts = np.zeros(41, np.int64)
    for x in np.random.default_rng(3).integers(1, 20, 9).tolist():
        counts[x] += 1
    have = [x for x in range(41) for _ in range(counts[x])]
    index = packing.SumIndex(counts)
    for total in range(1, 40):
        size = next((k for k in (1, 2, 3) if any(sum(c) == total for c in itertools.combinations(have, k))), None)
        found = index.find(total)
        assert (len(found) if found else None) == size
        assert not found or sum(found) == total and not Counter(found) - Counter(have)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_uses_each_length_as_often_as_it_stands(lengths):
    made = packing.plan(Counter(lengths), 30)
    used = Counter()
    for content, n in made:
        assert sum(content) <= 30
        for x in content:
            used[x] += n
    assert used == Counter(lengths)
    bins = sum(n for _, n in made)
    assert bins >= -(-sum(lengths) // 30) and bins <= 1.7 * max(1, -(-sum(lengths) // 30)) + 1


def test_exact_complements_fill_sequences():
    made = packing.plan({700: 2, 324: 1, 200: 1, 124: 1, 500: 1, 300: 1, 150: 1, 74: 1}, 1024)
    assert sorted(sorted(c) for c, _ in made) == [[74, 150, 300, 500], [124, 200, 700], [324, 700]]


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
@pytest.mark.parametrize("hot", [0, 50, 1 << 18])
def test_token_counts_equal_library(which, hot, request):
    df = request.getfixturevalue(which)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in rows_of(df):
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want[d, len(t.encode()), n, n > 100] += 1
    got = token_counts.count_tokens(df, limit=100, hot=hot)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want
