import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and ids, odd characters, and columns with clashing names."""
    r = random.Random(7)
    long = " ".join(r.choice(["the", "thand", "ingness", "ñandú", "co-op", "x1", "!!", "über"]) for _ in range(30_000))
    texts = [
        None, "", " ", "\n\n", "a", "the cat", "the cat", "  two  spaces ", "tab\tand\r\nline", "It's we'll THEY'RE 12345 x² ½",
        "<|endoftext|>", "pre <|endoftext|> post <|startoftext|>x", "<s> </s> <unk> <0x41>", "日本語のテキスト", "é ẛ̣ ﬁ İ ΣΑΣ", "  　nbsp", "😀👍🏽 emoji",
        "null\x00byte\x1c\x85", "_under__score_ #a $b", "a▁b▁▁c", long, long, "ab" * 3000,
    ]
    rows = [(i if i % 7 else None, t, "en" if i % 3 else None, "src0", None if t is None else len(t), i, "x") for i, t in enumerate(texts)]
    rows += [(5, "the cat", "en", "src0", 7, 5, "x"), (5, "the cat", "en", "src0", 7, 5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, ids_sha256 string")
