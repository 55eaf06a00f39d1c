"""Binning rules that differ at their edges, and scaling."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_width(x: Column, lo: float, hi: float, bins: int) -> Column:
    """[a, b) bins, the last one closed."""
    return F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) * bins / (hi - lo)), F.lit(bins - 1)))


def right_closed(x: Column, edges: list[float]) -> Column:
    """(a, b] bins, the first one closed on both sides; null outside."""
    out = F.when((x < edges[0]) | (x > edges[-1]) | x.isNull(), F.lit(None).cast("int"))
    for k, e in enumerate(edges[1:]):
        out = out.when(x <= e, F.lit(k))
    return out


def grid_index(n: int, most: int = 501) -> list[int]:
    """At most so many evenly spaced places from 0 to n."""
    return sorted({int(n * k / (most - 1)) for k in range(most)})


def place(edges: list[float], x: float) -> int:
    return bisect_left(edges, x)


def min_max(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Scales a column to [0, 1] by one small aggregate; a constant column becomes 0."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")) if keys else df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    both = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))
    return both.withColumn(column, F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")
