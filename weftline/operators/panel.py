"""Panels, strictly lagged features, as-of joins, labels, cohorts and rolling origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.scan import last_known


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the values of the last right row of its key before it (or at its time, if not strict).

    A union in the order of key and time, dealt by ranges, with last values carried from range to range; nothing is paired, and a key of
    any size is spread over tasks. Right rows are expected to be unique in (key, time).
    """
    carried = F.struct(F.col(time).alias("_at"), *value)
    a = left.withColumns({"_right": F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType), "_order": F.lit(0 if strict else 1)})
    b = right.select(key, time, carried.alias("_right"), F.lit(1 if strict else 0).alias("_order"))
    both = last_known(a.unionByName(b, allowMissingColumns=True), [time, "_order"], "_right", "_last", key)
    mine = F.col("_order") == (0 if strict else 1)
    return both.where(mine).select(*left.columns, *(F.col("_last")[v].alias(v) for v in value), F.col("_last")["_at"].alias("matched_at"))


def balanced_panel(rows: DataFrame, unit: str, period: str, values: list[str]) -> DataFrame:
    """Every unit in every period, with zeros where it has no row. Periods are few and broadcast by their number."""
    units, periods = rows.select(unit).distinct(), rows.select(period).distinct()
    return units.crossJoin(F.broadcast(periods)).join(rows, [unit, period], "left").na.fill(0, values)


def lagged_degrees(weekly: DataFrame) -> DataFrame:
    """(week, node, in/out degree and strength) strictly before each week, for all nodes known before it.

    From weekly pair counts (week, src, dst, w): a pair adds to degrees in its first week only; the rest are running
    sums per node over the weeks of the calendar.
    """
    first = weekly.groupBy("src", "dst").agg(F.min("week").alias("week")).withColumn("new", F.lit(1))
    rows = weekly.join(first, ["src", "dst", "week"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    out = rows.groupBy("week", F.col("src").alias("node")).agg(F.sum("new").alias("od"), F.sum("w").alias("ow"))
    into = rows.groupBy("week", F.col("dst").alias("node")).agg(F.sum("new").alias("id"), F.sum("w").alias("iw"))
    sums = out.join(into, ["week", "node"], "full").na.fill(0)
    weeks = weekly.select("week").distinct()
    begun = sums.groupBy("node").agg(F.min("week").alias("begun"))
    spine = begun.join(F.broadcast(weeks), F.col("week") >= F.col("begun")).select("week", "node")
    before = Window.partitionBy("node").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    dense = spine.join(sums, ["week", "node"], "left").na.fill(0)
    names = {"in_degree": "id", "out_degree": "od", "in_strength": "iw", "out_strength": "ow"}
    got = dense.select("week", "node", *(F.sum(c).over(before).alias(n) for n, c in names.items()))
    return got.where("in_degree is not null")


def majority_label(zeros: Column, ones: Column) -> Column:
    """0 or 1 by majority, null for a tie."""
    return F.when(ones > zeros, F.lit(1)).when(zeros > ones, F.lit(0))


def history(labels: DataFrame, key: str, period: str, label: str) -> DataFrame:
    """Features from strictly earlier labels: last one, whether there is one, past rates, count and periods since."""
    w = Window.partitionBy(key).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(label).over(w)
    ones = F.sum(label).over(w)
    last = F.last(label, ignorenulls=True).over(w)
    at = F.last(F.when(F.col(label).isNotNull(), F.col(period)), ignorenulls=True).over(w)
    return labels.select(
        key,
        period,
        label,
        last.alias("previous_label"),
        last.isNotNull().alias("previous_available"),
        F.try_divide(n - ones, n).alias("past_rate_0"),
        F.try_divide(ones, n).alias("past_rate_1"),
        n.alias("past_count"),
        F.months_between(period, at).cast("int").alias("periods_since"),
    )


def rolling_origins(periods: DataFrame, period: str, least_train: int = 8) -> DataFrame:
    """(origin, train_until, validation, test): expanding windows over periods, which are few."""
    w = Window.orderBy(period)
    ranked = periods.select(period).distinct().withColumn("i", F.row_number().over(w) - 1)
    got = ranked.select(F.col("i").alias("origin"), F.lag(period, 2).over(w).alias("train_until"), F.lag(period, 1).over(w).alias("validation"), F.col(period).alias("test"))
    return got.where(F.col("origin") >= least_train + 1)


def cohorts(rows: DataFrame, period: str, label: str, known: str) -> DataFrame:
    """Per period: active = evaluated + cold start + ties."""
    l, k = F.col(label), F.col(known)
    return rows.groupBy(period).agg(
        F.count("*").alias("active"),
        F.count_if(l.isNotNull() & k).alias("evaluated"),
        F.count_if(l.isNotNull() & ~k).alias("cold_start"),
        F.count_if(l.isNull()).alias("ties"),
    )
