"""Scans and sinks: strict CSV, hash-verified reads, exclusive writes, partitioned tables and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, empty strings kept apart from nothing, header checked."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "\u0000").option("emptyValue", "").schema(schema).csv(path)
    return raw.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns))


def read_typed_csv(spark: SparkSession, path: str, ddl: str, null: str = "NA") -> DataFrame:
    """A CSV by its declared schema; a row that doesn't fit fails the scan."""
    return spark.read.option("header", True).option("nullValue", null).option("mode", "FAILFAST").schema(ddl).csv(path)


def write_csv(df: DataFrame, path: str, null: str = "NA", partition_by: tuple[str, ...] = ()) -> None:
    """Fails if the path is there already."""
    writer = df.write.mode("errorifexists").option("header", True).option("nullValue", null)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_partition(spark: SparkSession, path: str, column: str, value: object) -> DataFrame:
    """One partition of a table written with partition_by: only its folder is listed and read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def refuse_existing(spark: SparkSession, paths: list[str]) -> None:
    """Fail before any work if an output is there already."""
    found = [p for p in paths if exists(spark, p)]
    if found:
        raise FileExistsError(", ".join(found))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files below a folder, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were added, removed or changed between two manifests."""
    both = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full")
    return both.where("old IS DISTINCT FROM new").select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("what"))


def read_verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """A Parquet table whose files have to be those of a manifest."""
    bad = changed(expected, manifest(spark, path, "*.parquet"))
    if not bad.isEmpty():
        raise ValueError(f"{path}: files differ from the manifest")
    return spark.read.parquet(path)


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, duplicates counted: empty if what was written reads back."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_report(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("errorifexists").text(path)
