"""Numeric tables from CSV files and Arrow data."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors
from ..dataset import Dataset

_NUMBERS = (pa.types.is_floating, pa.types.is_integer)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows of files with their numbers as row_id, in order of the files' paths and of places in them.

    A block of a file is read by one task, one row after another: a row's number is the number of rows in
    blocks before its own, of which there is one count a block, and its place in the block.
    """
    block = ["_file", "_block"]
    read = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    blocks = read.groupBy(*block).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return read.join(F.broadcast(bases), block).withColumn("row_id", F.col("_place") - F.col("_first") + F.col("_base")).drop(*block, "_place", "_first", "_base")


def dataset_from_csv(spark: SparkSession, path: str, target_column: int, has_headers: bool = True, target_type: str = "double", multi_line: bool = False) -> Dataset:
    """A dataset of the numbers in a CSV file, with its row numbers, from 0, as row_id; fields are trimmed.

    Quoted fields may hold line ends if multi_line is set; a file is then read by one task.

    Rows with more or fewer fields, fields that are no numbers and a target column that does not
    exist are errors.
    """
    try:
        lines = spark.read.option("header", False).csv(path, enforceSchema=True, multiLine=multi_line, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)
        first = lines.first()
    except Exception as e:
        raise errors.CsvError(reason=str(e).splitlines()[0]) from None
    if first is None or (has_headers and lines.limit(2).count() < 2):
        raise errors.EmptySamples()
    width = len(first)
    if not 0 <= target_column < width:
        raise errors.CsvError(reason=f"there is no column {target_column}")
    names = [f"f{i}" for i in range(width)]
    schema = ", ".join(f"{n} string" for n in names) + ", _broken string"
    rows = spark.read.option("header", has_headers).option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE").schema(schema).csv(path, enforceSchema=True, multiLine=multi_line)
    numbered = _numbered(rows)
    target = names.pop(target_column)
    made = numbered.select(
        "row_id",
        "_broken",
        *[F.trim(n).try_cast("double").alias(n) for n in names],
        F.trim(target).try_cast(target_type).alias("target"),
    ).cache()
    bad = made.where(F.col("_broken").isNotNull() | F.greatest(*[F.col(n).isNull().cast("int") for n in [*names, "target"]], F.lit(0)).cast("boolean")).select("row_id").orderBy("row_id").limit(1).collect()
    if bad:
        made.unpersist()
        raise errors.CsvError(reason=f"row {bad[0][0]} is broken or has a field that is no number")
    data = Dataset(made.drop("_broken"), names, "target", "row_id")
    data.validate()
    return data


def arrays_from_arrow(spark: SparkSession, table: pa.Table | pa.RecordBatch, target_column: int) -> Dataset:
    """A dataset of Arrow data: nulls among the features become NaN, a null target is an error.

    The result is not checked for missing values, so that an imputer can fill them.
    """
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    if not 0 <= target_column < table.num_columns:
        raise errors.ArrowError(reason=f"there is no column {target_column}")
    target = table.column(target_column)
    if target.null_count:
        raise errors.ArrowError(reason="the target has nulls")
    columns, names = [pa.array(range(table.num_rows), pa.int64())], ["row_id"]
    for i, f in enumerate(table.schema):
        if i != target_column:
            if not any(t(f.type) for t in _NUMBERS):
                raise errors.ArrowError(reason=f"column {f.name!r} has type {f.type}")
            columns.append(pa.compute.fill_null(table.column(i).cast(pa.float64()), float("nan")))
            names.append(f.name)
    df: DataFrame = spark.createDataFrame(pa.table([*columns, target], names=[*names, table.schema.field(target_column).name]))
    return Dataset(df, names[1:], table.schema.field(target_column).name, "row_id")
