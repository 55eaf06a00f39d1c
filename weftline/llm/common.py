"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import trim

#: Rows in an Arrow batch handed to Python: bounds a worker's memory with texts of up to megabytes. More rows take longer each,
#: as Spark sizes the whole batch at every row.
BATCH_ROWS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small; long texts would otherwise fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with the worker's freed memory given back to the system at its end: workers idle on beside others."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(df: DataFrame, *kept: str) -> DataFrame:
    """df with all but the columns kept renamed by place, so that no name (with a dot, or one that an operator uses) is in the way."""
    return df.toDF(*(c if c in kept else f"c{k}" for k, c in enumerate(df.columns)))


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the column as text, modulo m; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % m, F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
