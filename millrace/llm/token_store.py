"""Operator 2: token ids in a binary store of short documents.

Layout.  A store is a folder with two tables that Spark writes and reads wherever it can write, so
that committing, retrying and losing executors is Spark's business:

* ``dictionary``: one row with the zstandard dictionary, its sha256 and the width of an id;
* ``blocks``: one row for each block of up to BLOCK_BYTES of frames: ``shard``, ``block`` (number in
  the shard), ``dict_sha256``, ``doc_ids``, ``starts`` (ids of all documents of the shard before each one),
  ``n_tokens``, ``offsets`` (place of each document's frame in the payload, and one end), ``payload``.

Each document is a zstandard frame of its own, compressed with the one shared dictionary, which is
trained on serialized id arrays.  A short document is read by its block's offsets and one frame; the
rest of the payload is not decompressed, and without ids wanted the payload column is not read at all.

Order.  Shards are ranges of doc_id, cut at quantiles of the doc_id column; in a shard rows are sorted
by doc_id, nulls first, and equal ids by their frames.  Rows of one id stay in one shard; a task finds a
row's shard by bisection.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .common import binaries, input_bytes, map_batches, slices, text_column, texts, tokenizer_path

BLOCK_BYTES = 1 << 20
#: Documents that the dictionary is trained on, how many ids one of them may have, and the dictionary's size.
TRAIN_DOCS, TRAIN_TOKENS, DICT_BYTES = 2000, 4096, 64 * 1024
#: Input bytes of a shard; shards are larger once there would be more than MOST_SHARDS, whose bounds go to every task.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 100_000
#: Ids for each shard that bounds are taken from where ids are no numbers, and such ids at most.
BOUND_IDS, MOST_BOUND_IDS = 64, 1_000_000
#: A file's row groups, which readers take one at a time.
ROW_GROUP_BYTES = 16 << 20


@lru_cache(maxsize=4)
def _coder(dictionary: bytes, level: int):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (
        zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=False, write_dict_id=False),
        zstandard.ZstdDecompressor(dict_data=d),
    )


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary for serialized id arrays; empty if there is too little to train on."""
    import zstandard

    samples = [s for s in samples if s]
    if len(samples) < 16 or sum(map(len, samples)) < 10 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # samples that have nothing in common
        return b""


def _encoded(df: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, dictionary: bytes, level: int, bounds: list | None = None) -> DataFrame:
    """doc_id, n_tokens, the compressed frame of each text's ids with the end id, and how many of the sorted bounds its id has reached."""
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("frame", T.BinaryType()), T.StructField("shard", T.IntegerType())])
    cuts = df.sparkSession.sparkContext.broadcast(bounds or [])  # MOST_SHARDS ids at most

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = byte_bpe(tokenizer_path(tokenizer))
        end = np.array([end_id], bpe.dtype).tobytes()
        compress = _coder(dictionary, level)[0].compress
        frames, counts = [], []
        for packed in bpe.encode_batch(texts(b, "text")):
            packed += end
            counts.append(len(packed) // bpe.dtype.itemsize)
            frames.append(compress(packed))
        shards = [0 if d is None else bisect.bisect_right(cuts.value, d) for d in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), binaries(frames), pa.array(shards, pa.int32())], names=schema.fieldNames())

    return map_batches(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), work, schema)


def shard_bounds(ids: DataFrame, shards: int) -> list:
    """At most shards - 1 ids, sorted and distinct, that cut the ids of column doc_id into parts of about equal size."""
    if shards < 2:
        return []
    if isinstance(ids.schema["doc_id"].dataType, T.NumericType) and not isinstance(ids.schema["doc_id"].dataType, T.DecimalType):
        return sorted(set(ids.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 100_000)).first()[0] or []))
    # the ids whose hashes are smallest, whatever they are
    some = sorted(r[0] for r in ids.where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id")).limit(min(BOUND_IDS * shards, MOST_BOUND_IDS)).collect())
    return sorted({some[len(some) * i // shards] for i in range(1, shards)}) if some else []


def write_store(
    df: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
    train_docs: int = TRAIN_DOCS,
    level: int = 3,
) -> str:
    """Write the ids of every text of df, with end_id after each, in ascending doc_id order.

    A null or empty text has the end id only; a null id comes first; repeated ids keep all their rows,
    in one shard, equal rows in any order.  Other columns are not looked at.  An empty table gives a
    store without blocks.  Ids may be of any type that has an order.  The dictionary is trained on those of
    the `train_docs` documents whose ids' hashes are smallest that have TRAIN_TOKENS ids at most; it
    changes the files' size only, never what is read back, and so do the shards.
    """
    spark = df.sparkSession
    doc_id, text = text_column(df, doc_id), text_column(df, text)
    ids = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # the smallest hashes' bound first, from the id column alone; then only those rows' texts are read
    least = ids.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    samples: list[bytes] = []
    if least is not None:
        chosen = ids.where(F.xxhash64("doc_id") <= F.lit(least)).limit(4 * train_docs)
        raw = _encoded(chosen, "doc_id", "text", tokenizer, end_id, b"", 1).where(F.col("n_tokens") <= TRAIN_TOKENS).select("frame")
        back = _coder(b"", 1)[1]
        samples = [back.decompress(bytes(r[0])) for r in raw.toLocalIterator()]
    dictionary = train_dictionary(samples)
    sha = hashlib.sha256(dictionary).hexdigest()
    width = byte_bpe(tokenizer_path(tokenizer)).dtype.itemsize
    spark.createDataFrame([(dictionary, sha, width)], "dictionary binary, dict_sha256 string, id_bytes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")

    shards = shards or max(1, min(MOST_SHARDS, input_bytes(df) // SHARD_BYTES), spark.sparkContext.defaultParallelism)
    bounds = shard_bounds(ids.select("doc_id"), shards)
    encoded = _encoded(ids, "doc_id", "text", tokenizer, end_id, dictionary, level, bounds)
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame")
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("block", T.LongType()),
            T.StructField("dict_sha256", T.StringType()),
            T.StructField("doc_ids", T.ArrayType(df.schema[doc_id].dataType)),
            T.StructField("starts", T.ArrayType(T.LongType())),
            T.StructField("n_tokens", T.ArrayType(T.LongType())),
            T.StructField("offsets", T.ArrayType(T.LongType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, start = None, 0, 0
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, number, start
            counts = [h[1] for h in held]
            starts = [start + x for x in np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)]).tolist()]
            offsets = np.concatenate([[0], np.cumsum([len(h[2]) for h in held], dtype=np.int64)]).tolist()
            row = [[now], [number], [sha], [[h[0] for h in held]], [starts], [counts], [offsets], [b"".join(h[2] for h in held)]]
            start += sum(counts)
            number += 1
            held, size = [], 0
            return pa.RecordBatch.from_pydict(dict(zip(schema.fieldNames(), row)), schema=arrow)

        arrow = _arrow(schema)
        for b in slices(batches):
            for d, n_tokens, frame, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and (s != now or size + len(frame) > BLOCK_BYTES):
                    yield out()
                if s != now:
                    now, number, start = s, 0, 0
                held.append((d, n_tokens, frame))
                size += len(frame)
        if held:
            yield out()

    ordered.select("doc_id", "n_tokens", "frame", "shard").mapInArrow(blocks, schema).write.mode("overwrite").option("compression", "none").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/blocks")
    return path


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def shard_bases(blocks: DataFrame) -> DataFrame:
    """shard and base: ids of all shards before it.  One row a shard, from the small columns alone."""
    sizes = blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    total = 0
    rows = []
    for r in sizes.orderBy("shard").collect():
        rows.append((r["shard"], total))
        total += r["n"]
    return blocks.sparkSession.createDataFrame(rows, "shard int, base long")


def read_store(spark: SparkSession, path: str, with_ids: bool = True, doc_ids: list | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a store, and with_ids its ids.

    With doc_ids, only those documents: their blocks are found by the block's ids and only their own
    frames are decompressed.  Fails if a block was written with another dictionary.
    """
    meta = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, sha, width = bytes(meta["dictionary"]), meta["dict_sha256"], meta["id_bytes"]
    if hashlib.sha256(dictionary).hexdigest() != sha:
        raise ValueError(f"the dictionary of {path} is damaged")
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType
    bases = shard_bases(blocks)
    if doc_ids is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(d).cast(kind) for d in doc_ids])))
    wanted = None if doc_ids is None else set(doc_ids)
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        back = _coder(dictionary, 3)[1]
        for b in slices(batches, 1):
            for s, have, ids, starts, counts, offsets, payload in zip(*(b.column(i).to_pylist() for i in range(7))):
                if have != sha:
                    raise ValueError(f"a block needs dictionary {have}, the store has {sha}")
                rows = []
                for i, d in enumerate(ids):
                    if wanted is None or d in wanted:
                        packed = np.frombuffer(back.decompress(payload[offsets[i] : offsets[i + 1]]), f"<u{width}").astype("<u4")
                        if len(packed) != counts[i]:
                            raise ValueError(f"document {d} has {len(packed)} ids, its block says {counts[i]}")
                        rows.append((s, d, starts[i], counts[i], zlib.crc32(packed.tobytes()), *([packed.astype(np.int32)] if with_ids else [])))
                for k in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 256]), arrow)], schema=arrow)

    docs = blocks.select("shard", "dict_sha256", "doc_ids", "starts", "n_tokens", "offsets", "payload").mapInArrow(work, schema)
    # bases has one row a shard, and shards are at most MOST_SHARDS
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), *schema.fieldNames()[3:])
