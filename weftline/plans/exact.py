"""Exact quantiles, and steps along edges, whose SQL is the other engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import expansion, quantiles
from weftline.plans.registry import query
from weftline.plans.sql import duck, view


@query("a09_describe", duck("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lo, round($pct(value; 0.25)$, 6) AS q25, round($pct(value; 0.5)$, 6) AS q50, round($pct(value; 0.75)$, 6) AS q75, max(value) AS hi FROM events"))
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and quartiles of all values."""
    got = quantiles.describe(view(spark, sf_dir, "post"), "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return got.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "sd")), "lo", *(F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")), "hi")


@query("a24_quantile_summary", duck("SELECT kind, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round($pct(value; 0.5)$, 6) AS median, round($pct(value; 0.75)$ - $pct(value; 0.25)$, 6) AS iqr FROM post GROUP BY kind", ("post",)))
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments, median and interquartile range by kind."""
    got = quantiles.describe(view(spark, sf_dir, "post"), "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, "kind")
    near = {"mean": F.col("mean"), "sd": F.col("sd"), "median": F.col("median"), "iqr": F.col("q75") - F.col("q25")}
    return got.select("kind", "n", *(F.round(c, 6).alias(n) for n, c in near.items()))


@query("a29_percentile_band", duck("SELECT week, round($pct(n; 0.05)$, 6) AS p05, round($pct(n; 0.95)$, 6) AS p95 FROM (SELECT week, u, CAST(count(*) AS DOUBLE) AS n FROM post GROUP BY week, u) x GROUP BY week", ("post",)))
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of users' weekly counts."""
    weekly = view(spark, sf_dir, "post").groupBy("week", "u").agg(F.count("*").alias("n"))
    got = quantiles.quantiles(weekly, "n", {"p05": 0.05, "p95": 0.95}, "week")
    return got.select("week", F.round("p05", 6).alias("p05"), F.round("p95", 6).alias("p95"))


@query("j19_neighbour_expansion", duck("SELECT a.src AS seed, b.dst AS node, count(*) AS ways, CAST(sum(a.w * b.w) AS BIGINT) AS weight FROM pairs a JOIN pairs b ON a.dst = b.src GROUP BY a.src, b.dst", ("pairs",)))
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps from every node."""
    pairs = view(spark, sf_dir, "pairs")
    return expansion.expand(pairs.select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.col("w").alias("weight")), pairs)


@query("m12_quantile_bins", duck("WITH q AS (SELECT $pct(d; 0.25)$ AS a, $pct(d; 0.5)$ AS b, $pct(d; 0.75)$ AS c FROM (SELECT src, CAST(count(*) AS DOUBLE) AS d FROM pairs GROUP BY src) x) SELECT src, CASE WHEN d > a THEN 1 ELSE 0 END + CASE WHEN d > b AND b > a THEN 1 ELSE 0 END + CASE WHEN d > c AND c > b THEN 1 ELSE 0 END AS bin FROM (SELECT src, CAST(count(*) AS DOUBLE) AS d FROM pairs GROUP BY src) y CROSS JOIN q", ("pairs",)))
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by quartile of their number of targets."""
    degrees = view(spark, sf_dir, "pairs").groupBy("src").agg(F.count("*").alias("d"))
    return quantiles.binned(degrees, "d", [0.25, 0.5, 0.75]).select("src", "bin")
