"""What the operators share: places for intermediate tables, text arrays, and bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints/millrace"

#: Texts are worked on in groups of about so many bytes, so that memory does not follow batch size.
CHUNK_BYTES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/millrace"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, what: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: lineage is cut, and a lost executor costs nothing.

    Returns the reread frame and the path, which the caller drops when it is done with it.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Tables that hold results which operators have returned, by application.
_results: dict[str, list[str]] = {}


def write_result(df: DataFrame, what: str) -> DataFrame:
    """write_table for a table that what an operator returns is read from: it stays until drop_results is called."""
    out, path = write_table(df, what)
    _results.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return out


def drop_results(spark: SparkSession) -> None:
    """Delete the tables behind all that operators have returned to this application so far; call it once that is used."""
    drop_table(spark, *_results.pop(spark.sparkContext.applicationId, []))


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Delete tables that write_table made."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def column_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores in front until no column of df has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_column(df: DataFrame, name: str) -> str:
    """The column of df that has this name, whatever its case; KeyError if there is none."""
    for c in df.columns:
        if c == name:
            return c
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise KeyError(f"no column {name!r} in {df.columns}")


def input_bytes(df: DataFrame) -> int:
    """Bytes of df as the optimizer's statistics have them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; a null is an empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def groups_of(values: list, size: Callable = len, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values whose sizes sum to about `most`; a longer value stands alone."""
    start, total = 0, 0
    for i, v in enumerate(values):
        n = size(v)
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


#: Rows that are turned into Python objects, or sent back, at a time.
SLICE_ROWS = 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of so many rows at most; empty ones are passed over."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """df with fn applied to slices of each Arrow batch."""
    return df.mapInArrow(lambda batches: map(fn, slices(batches)), schema)


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def crc32_of(df: DataFrame, doc_id: str) -> "F.Column":
    """crc32 of the id as text, as a non-negative long; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the package that holds the files is asked on first use."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gaps(values: list) -> list[int]:
    """Places of None in values."""
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


#: How to drop what a Python worker keeps for each operator, and the operator that the worker serves.
_kept: dict[str, Callable[[], None]] = {}
_serves: list[str] = [""]


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Say how to drop a worker's models or vocabularies of one operator."""
    _kept[operator] = drop


def give_back() -> None:
    """Return freed memory to the system: what many small arrays have left behind, in the driver or a worker."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def serve(operator: str) -> None:
    """Called by a worker's functions: what other operators have left in the worker is dropped when it changes hands."""
    if _serves[0] == operator:
        return
    _serves[0] = operator
    for name, drop in _kept.items():
        if name != operator:
            drop()
    give_back()


class Memo:
    """A bounded memo of two generations: when the young one is full it becomes the old one, which goes.

    What is asked for often passes from the old to the young generation and so stays.
    """

    def __init__(self, most: int):
        self.half = most // 2
        self.young: dict = {}
        self.old: dict = {}

    def recall(self, key):
        """The value of a key that the young generation lacks, or None; found in the old, it is young again."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[key] = value
