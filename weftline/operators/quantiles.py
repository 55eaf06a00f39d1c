"""Exact quantiles of groups of any size: no task holds a group's values.

Equal values are counted first, the counts are summed up along the values by ranges (`scan.running`), and only the values at the places that
a quantile lies between are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.scan import running


def _matched(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """left with the columns of right, which has a row for each key, nulls among keys being a key; without keys right is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(other[f"_k{i}"])
    return left.join(other, same).drop(*(f"_k{i}" for i in range(len(keys))))


def quantiles(df: DataFrame, value: str, places: dict[str, float], *keys: str) -> DataFrame:
    """(keys, a column for each of places): quantiles between the two nearest values, in proportion.

    Nulls don't count; a key with nulls only has no row, and a table without values gives one row of nulls if there are no keys. NaN is
    above all numbers.
    """
    counts = df.select(*keys, F.col(value).cast("double").alias("_x")).where("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    ranked = running(counts, [F.col("_x")], {"_to": F.col("_n")}, *keys)
    rows = ranked.groupBy(*keys).agg(F.max("_to").alias("_all"))
    at = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    holds = lambda place: (F.col("_to") - F.col("_n") <= place) & (place < F.col("_to"))

    ends = {}
    for i, p in enumerate(places.values()):
        ends |= {f"_lo{i}": F.floor(at(p)), f"_hi{i}": F.ceil(at(p))}
    wanted = F.lit(False)
    for place in ends.values():
        wanted = wanted | holds(place)
    near = _matched(ranked, rows, keys).where(wanted)
    found = near.groupBy(*keys).agg(F.max("_all").alias("_all"), *(F.max(F.when(holds(place), F.col("_x"))).alias(n) for n, place in ends.items()))

    def between(i: int, p: float) -> Column:
        part = at(p) - F.floor(at(p))
        return F.when(part == 0, F.col(f"_lo{i}")).otherwise((1 - part) * F.col(f"_lo{i}") + part * F.col(f"_hi{i}"))

    return found.select(*keys, *(between(i, p).alias(n) for i, (n, p) in enumerate(places.items())))


def describe(df: DataFrame, value: str, places: dict[str, float], *keys: str) -> DataFrame:
    """(keys, n, mean, sd, lo, hi, a column for each of places) of each key's values; sd has n - 1 below it."""
    x = F.col(value).cast("double")
    plain = df.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return _matched(plain, quantiles(df, value, places, *keys), keys)


def binned(df: DataFrame, value: str, places: list[float]) -> DataFrame:
    """df with bin: how many of the quantiles, equal ones once, lie below the value; null for a null value. The cut points are one row."""
    names = {f"_q{i}": p for i, p in enumerate(places)}
    cuts = quantiles(df, value, names).select(F.array_distinct(F.array(*names)).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda q: q < F.col(value)))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bin", F.when(F.col(value).isNotNull(), below)).drop("_cuts")
