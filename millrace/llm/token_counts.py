"""Operator 8: token counts without token ids.

A text's tokens are those of its pre-tokens, so a pre-token's pieces need counting only once, however
often it stands.  The corpus is read for its distinct pre-tokens and their frequencies; the tokenizers
library counts the pieces of each distinct one; the counts are joined to each document's pre-token
frequencies and summed.  Common pre-tokens are looked up in a bounded broadcast, all others are joined
by a shuffle (see ``vocabulary``).

Special tokens' strings are cut out before normalising, as the library does, and count one each.
Plain texts are normalised and cut here; texts with other characters by the library's own normalizer
and pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import LETTERS, ODD
from .common import drop_table, keeps, map_batches, text_column, texts, tokenizer_path, write_result, write_table
from .vocabulary import HOT_TERMS, count_terms, hot_bound, hot_terms

#: What the word vocabulary's Split pattern takes from a plain text in lower case.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9 \\t\\n\\r]+")
#: The normalizer and pattern that WORD stands for (fixed values of the vocabulary's file).
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PreTokens:
    """Cuts texts into pre-tokens, and counts a pre-token's pieces, as one vocabulary's file says."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        kind = json.loads(lib.to_str())
        special = [t["content"] for t in kind["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in kind["added_tokens"]):
            raise ValueError("only added tokens that stand as they are are supported")
        if lib.pre_tokenizer is None:
            raise ValueError("a vocabulary without a pre-tokenizer has no pre-tokens to count")
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        steps = [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", [])]
        cuts = (kind["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = steps == WORD_NORMALIZERS and cuts[0].get("pattern", {}).get("Regex") == WORD_PATTERN

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special tokens stand in it."""
        if self.special is None or not self.special.search(text):
            return self._cut(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self._cut(p)], len(parts) - 1

    def _cut(self, text: str) -> list[str]:
        if self.plain and not ODD.search(text):
            return WORD.findall(text.lower())
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [("\x00" + t) for t, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, tokens: list[str]) -> list[int]:
        """Pieces of each pre-token.  One that the library cut is in its byte alphabet already (marked by \\x00)."""
        out = [0] * len(tokens)
        plain = [i for i, t in enumerate(tokens) if t[:1] != "\x00"]
        for i, e in zip(plain, self.library.encode_batch_fast([tokens[i] for i in plain], add_special_tokens=False)):
            out[i] = len(e.ids)
        for i, t in enumerate(tokens):
            if t[:1] == "\x00":
                out[i] = len(self.library.model.tokenize(t[1:]))
        return out


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


keeps("token_counts", pre_tokens.cache_clear)


def distinct_pieces(df: DataFrame, tokenizer: str) -> DataFrame:
    """term, n (its frequency in the corpus) and pieces of each distinct pre-token of df's column `text`."""

    def cut(b: pa.RecordBatch) -> Iterator[list[str]]:
        p = pre_tokens(tokenizer_path(tokenizer))
        return (p.cut(t)[0] for t in texts(b))

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        made = pre_tokens(tokenizer_path(tokenizer)).pieces(b.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.int32())], names=["term", "n", "pieces"])

    return map_batches(count_terms(df, cut, binary=False), count, T._parse_datatype_string("term string, n long, pieces int"))


def count_tokens(
    df: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    limit: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    hot: int = HOT_TERMS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_pre_tokens and over_limit (n_tokens > limit) of every row of df.

    A null text counts as empty: no bytes, no tokens.  Ids may be null or repeated; each row counts
    for itself.  Other columns are left out.  An empty table gives no rows.
    """
    spark = df.sparkSession
    doc_id = text_column(df, doc_id)
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text_column(df, text)}`").alias("text"))
    vocabulary, vocabulary_path = write_table(distinct_pieces(rows.select("text"), tokenizer), "pieces")
    bound = hot_bound(vocabulary, hot)
    known = spark.sparkContext.broadcast(hot_terms(vocabulary, "pieces", bound))  # `hot` terms at most
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", df.schema[doc_id].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_pre_tokens", T.LongType()),
            T.StructField("hot_tokens", T.LongType()),
            T.StructField("rest", T.MapType(T.StringType(), T.IntegerType())),
        ]
    )

    def look_up(b: pa.RecordBatch) -> pa.RecordBatch:
        p, table = pre_tokens(tokenizer_path(tokenizer)), known.value
        get = table.get
        n_bytes, n_pre, n_hot, rest = [], [], [], []
        for t in texts(b):
            tokens, special = p.cut(t)
            found = list(map(get, tokens))
            cold = [x for x, k in zip(tokens, found) if k is None] if None in found else ()
            n_bytes.append(len(t.encode()))
            n_pre.append(len(tokens) + special)
            n_hot.append(special + sum(filter(None, found)))
            rest.append(list(Counter(cold).items()))
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n_bytes, n_pre, n_hot)), pa.array(rest, pa.map_(pa.string(), pa.int32()))],
            names=schema.fieldNames(),
        )

    docs, docs_path = write_table(map_batches(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), look_up, schema), "counts")
    cold = docs.select("row", F.explode("rest").alias("term", "k"))
    rare = vocabulary.where(F.col("n") < bound).select("term", "pieces")
    sums = cold.join(rare, "term").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("cold_tokens"))
    n_tokens = F.col("hot_tokens") + F.coalesce("cold_tokens", F.lit(0).cast("long"))
    out = write_result(
        docs.select("row", "doc_id", "n_bytes", "n_pre_tokens", "hot_tokens")
        .join(sums, "row", "left")
        .select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), "n_pre_tokens", (n_tokens > limit).alias("over_limit")),
        "token_counts",
    )
    drop_table(spark, vocabulary_path, docs_path)
    known.unpersist()
    return out
