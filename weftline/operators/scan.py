"""Running sums over a whole column, or over keys of any size, without one task for all rows.

Rows are dealt by ranges of their order, so equal values stay together; each range is summed by itself, and what the ranges before it add
up to (a row for each range and key) is joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], *keys: str) -> DataFrame:
    """df with the running sums of columns, the row itself included, by order within keys. Rows that are equal in order are in any order
    among themselves. Nulls among keys are a key; null summands count nothing."""
    dealt = cut(df.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = dealt.groupBy("_range", *keys).agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    carried = totals.select("_range", *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(F.sum(f"_{n}").over(earlier).alias(f"_before_{n}") for n in sums)).withColumnRenamed("_range", "_of")
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    local = dealt.select(*df.columns, "_range", *(F.sum(f"_{n}").over(within).alias(f"_own_{n}") for n in sums))
    value = lambda n: F.coalesce(F.col(f"_own_{n}"), F.lit(0)) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))
    return local.join(carried, same).select(*df.columns, *(value(n).alias(n) for n in sums))


def last_known(df: DataFrame, order: list[str], value: str, name: str, *keys: str) -> DataFrame:
    """df with the last value that isn't null, by ascending order within keys, the row itself included.

    Rows are dealt by ranges of keys and order, so a key with most of the rows is in many ranges. As ranges follow each other, one key at
    most goes on from the ranges before into each, so the table of what is carried has a row for each range at most and is broadcast.
    """
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = dealt.groupBy("_range", *keys).agg(F.max_by(value, place).alias("_end"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    carried = ends.select(F.col("_range").alias("_of"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.last("_end", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null")
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    local = dealt.withColumn("_own", F.last(value, ignorenulls=True).over(within))
    return local.join(F.broadcast(carried), same, "left").select(*df.columns, F.coalesce("_own", "_before").alias(name))
