"""Scores of nodes and edges over whole columns: extremes and totals are one row, ranks come from running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph, stats
from weftline.plans.registry import query
from weftline.plans.sql import duck, view


def _strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, k, s): out-degree and out-strength."""
    return view(spark, sf_dir, "pairs").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"), F.sum("w").alias("s"))


@query("a26_top_share", duck("WITH s AS (SELECT dst, CAST(sum(w) AS DOUBLE) AS x FROM pairs GROUP BY dst), r AS (SELECT x, row_number() OVER (ORDER BY x DESC, dst) AS i, count(*) OVER () AS n FROM s) SELECT round(sum(CASE WHEN i <= greatest(1, ceil(0.01E0 * n)) THEN x ELSE 0 END) / sum(x), 9) AS share FROM r", ("pairs",)))
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_share(view(spark, sf_dir, "pairs").groupBy("dst").agg(F.sum("w").alias("s")), "s", 0.01).select(F.round("top_share", 9).alias("share"))


@query("w10_min_max", duck("SELECT src, round(coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), 0), 9) AS scaled FROM (SELECT src, CAST(sum(w) AS DOUBLE) AS s FROM pairs GROUP BY src) x", ("pairs",)))
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.min_max(_strength(spark, sf_dir), "s").select(F.col("node").alias("src"), F.round("scaled_s", 9).alias("scaled"))


@query("g15_composite_score", duck("WITH d AS (SELECT src AS node, CAST(count(*) AS DOUBLE) AS k, CAST(sum(w) AS DOUBLE) AS s FROM pairs GROUP BY src) SELECT node, round(0.6E0 * coalesce((k - min(k) OVER ()) / nullif(max(k) OVER () - min(k) OVER (), 0), 0) + 0.4E0 * coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), 0), 9) AS trust FROM d", ("pairs",)))
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.min_max(_strength(spark, sf_dir), "k", "s").select("node", F.round(0.6 * F.col("scaled_k") + 0.4 * F.col("scaled_s"), 9).alias("trust"))


@query("g16_structural_influence", duck("WITH d AS (SELECT src AS node, CAST(count(*) AS DOUBLE) AS k, CAST(sum(w) AS DOUBLE) AS s FROM pairs GROUP BY src), r AS (SELECT node, (rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0E0) / count(*) OVER () AS pk, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0E0) / count(*) OVER () AS ps FROM d) SELECT node, round(0.6E0 * ps + 0.4E0 * pk, 9) AS influence FROM r", ("pairs",)))
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From ranks as shares of the number of nodes."""
    d = _strength(spark, sf_dir)
    ranked = stats.average_rank(stats.average_rank(d, "k"), "s").crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))
    return ranked.select("node", F.round(0.6 * F.col("rank_s") / F.col("n") + 0.4 * F.col("rank_k") / F.col("n"), 9).alias("influence"))


@query("x01_weight_normalisation", duck("SELECT src, dst, round(w / CAST(max(w) OVER () AS DOUBLE), 9) AS by_max, round(ln(1.0E0 + w) / ln(1.0E0 + max(w) OVER ()), 9) AS by_log FROM pairs", ("pairs",)))
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "pairs")
    both = edges.crossJoin(F.broadcast(edges.agg(F.max("w").alias("top"))))
    return both.select("src", "dst", F.round(F.col("w") / F.col("top"), 9).alias("by_max"), F.round(F.log1p("w") / F.log1p("top"), 9).alias("by_log"))


@query("x13_mean_preserving_flattening", duck("SELECT src, dst, round(avg(CAST(w AS DOUBLE)) OVER (), 9) AS flat FROM pairs", ("pairs",)))
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "pairs")
    return edges.crossJoin(F.broadcast(edges.agg(F.round(F.avg("w"), 9).alias("flat")))).select("src", "dst", "flat")


@query("x03_seed_strategies", duck("WITH d AS (SELECT src AS node, CAST(sum(w) AS BIGINT) AS s, count(*) AS k FROM pairs GROUP BY src), a AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY s DESC, node) AS r FROM d) x WHERE r <= 5), b AS (SELECT node FROM (SELECT d.node, row_number() OVER (ORDER BY d.k DESC, d.node) AS r FROM d LEFT JOIN a ON d.node = a.node WHERE a.node IS NULL) x WHERE r <= 5) SELECT 'strength' AS strategy, node FROM a UNION ALL SELECT 'degree', node FROM b", ("pairs",)))
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seeds by strength, and five by degree that aren't among them; ties to the lesser node."""
    d = _strength(spark, sf_dir)
    first = d.orderBy(F.desc("s"), "node").limit(5).select("node")
    second = d.join(F.broadcast(first), "node", "left_anti").orderBy(F.desc("k"), "node").limit(5)
    return first.select(F.lit("strength").alias("strategy"), "node").unionByName(second.select(F.lit("degree").alias("strategy"), "node"))
