"""Structured Streaming twins of the weekly batch operators: event-time weeks, watermarks, running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def monday_weeks(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by kind in closed Monday weeks: with append mode a week comes out once the watermark has passed it."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(week.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "kind", "n")


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with a reason."""
    reason = F.when(F.col("ts").isNull(), "no time").when(F.col("src").isNull() | F.col("dst").isNull(), "no endpoint")
    marked = batch.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def write_split(events: DataFrame, valid: str, rejected: str, checkpoint: str):
    """A query that writes both sides of each micro-batch; a repeated batch overwrites its own folder."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        good, bad = split_valid(batch)
        good.write.mode("overwrite").parquet(f"{valid}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_labels(labels: DataFrame) -> DataFrame:
    """The last label of each user so far, in update mode."""
    return labels.groupBy("u").agg(F.max_by("y", "ts").alias("y"), F.max("ts").alias("ts"))


def lagged_totals(weekly: DataFrame) -> DataFrame:
    """(node, week, before): each node's total strictly before the week, kept as state between micro-batches.

    weekly has (node, week, n) of closed weeks, in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(frames)).sort_values("week").itertuples():
            out.append((key[0], row.week, total))
            total += row.n
        state.update((total,))
        yield pd.DataFrame(out, columns=["node", "week", "before"])

    return weekly.groupBy("node").applyInPandasWithState(step, "node bigint, week timestamp, before bigint", "total bigint", "append", GroupStateTimeout.NoTimeout)


def flagged_weeks(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Monday weeks so far, in update mode, with the first and last time seen in each; a week beyond them is partial."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(week.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select(F.col("w.start").alias("week"), "n", "first", "last")


def sliding(events: DataFrame, length: str, step: str, late: str = "1 day") -> DataFrame:
    """Events by kind in closed windows that overlap; rows later than the watermark allows are dropped."""
    w = F.window("ts", length, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Closed sessions of each user: events less than a gap apart."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "u").agg(F.count("*").alias("n")).select("u", F.col("w.start").alias("start"), "n")


def matched(left: DataFrame, right: DataFrame, within: str, late: str = "1 day") -> DataFrame:
    """Rows of two streams (u, ts, ...) of one user, right at most so long before left; state older than the watermarks need goes."""
    a = left.withWatermark("ts", late).withColumnRenamed("u", "a_u").withColumnRenamed("ts", "a_ts")
    b = right.withWatermark("ts", late).withColumnRenamed("u", "b_u").withColumnRenamed("ts", "b_ts")
    return a.join(b, F.expr(f"a_u = b_u AND b_ts <= a_ts AND b_ts >= a_ts - INTERVAL {within}"))
