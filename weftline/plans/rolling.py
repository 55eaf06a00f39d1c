"""Weekly snapshots with all statistics, fits by rolling origin, and intervals from shared draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import draws, graph, metrics, origins, panel
from weftline.plans.panels import _forecasts, t11
from weftline.plans.registry import query
from weftline.plans.sql import duck, view

_SNAPSHOTS = """WITH u AS (SELECT week, src AS a, dst AS b FROM weekly UNION SELECT week, dst, src FROM weekly),
 r(week, node, low) AS (SELECT week, a, a FROM u UNION SELECT r.week, u.b, r.low FROM r JOIN u ON u.week = r.week AND u.a = r.node WHERE r.low < u.b),
 lw AS (SELECT week, max(n) AS largest_weak FROM (SELECT week, c, count(*) AS n FROM (SELECT week, node, min(low) AS c FROM r GROUP BY week, node) q GROUP BY week, c) x GROUP BY week),
 f(week, a, b) AS (SELECT week, src, dst FROM weekly UNION SELECT f.week, f.a, w.dst FROM f JOIN weekly w ON w.week = f.week AND w.src = f.b),
 n AS (SELECT DISTINCT week, a AS node FROM u),
 s AS (SELECT n.week, n.node, least(n.node, coalesce(min(x.b), n.node)) AS c FROM n LEFT JOIN (SELECT p.week, p.a, p.b FROM f p JOIN f q ON q.week = p.week AND q.a = p.b AND q.b = p.a) x ON x.week = n.week AND x.a = n.node GROUP BY n.week, n.node),
 ls AS (SELECT week, max(k) AS largest_strong FROM (SELECT week, c, count(*) AS k FROM s GROUP BY week, c) x GROUP BY week),
 c AS (SELECT t.week, count(*) AS edges, CAST(sum(t.w) AS BIGINT) AS events, count_if(t.src <> t.dst) AS plain, count_if(t.src <> t.dst AND b.src IS NOT NULL) AS mutual FROM weekly t LEFT JOIN weekly b ON b.week = t.week AND b.src = t.dst AND b.dst = t.src GROUP BY t.week),
 k AS (SELECT week, count(*) AS nodes FROM n GROUP BY week)
 SELECT week, nodes, edges, events, round(CASE WHEN nodes < 2 THEN 0.0E0 ELSE plain / CAST(nodes * (nodes - 1) AS DOUBLE) END, 9) AS density, round(mutual / CAST(nullif(plain, 0) AS DOUBLE), 9) AS reciprocity, largest_weak, largest_strong, round(edges / CAST(nodes AS DOUBLE), 9) AS mean_in_degree, round(edges / CAST(nodes AS DOUBLE), 9) AS mean_out_degree, round(events / CAST(nodes AS DOUBLE), 9) AS mean_in_strength, round(events / CAST(nodes AS DOUBLE), 9) AS mean_out_strength FROM c JOIN k USING (week) JOIN lw USING (week) JOIN ls USING (week)"""


@query("t05_snapshot_statistics", duck(_SNAPSHOTS, ("weekly",)).replace("WITH ix", "WITH RECURSIVE ix", 1))
def t05_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of each week's graph."""
    got = graph.snapshot_statistics(view(spark, sf_dir, "weekly"), "week")
    near = ("density", "reciprocity", "mean_in_degree", "mean_out_degree", "mean_in_strength", "mean_out_strength")
    return got.withColumns({c: F.round(c, 9) for c in near})


@query("ml06_logistic_grid")
def ml06_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test predictions of each origin, by the penalty that its validation period chose."""
    features = ["past_rate_1", "past_count", "periods_since"]
    rows = t11(spark, sf_dir).where("y is not null and past_count > 0").select("u", "m", "y", *features)
    fits = origins.logistic_grid(rows, panel.rolling_origins(rows, "m"), features, "y", "m")
    chosen = origins.selected(fits, rows, features, "y", "m")
    return origins.predicted(chosen, rows, features, "m").select("origin", "u", "m", "y", "c", F.round("macro_f1", 9).alias("macro_f1"), F.round("p1", 6).alias("p1"))


_METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "f1_0", "f1_1", "mcc", "brier")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, metric, m, value) of three forecasts by period: past share, its majority, and one half for everyone."""
    rows = _forecasts(spark, sf_dir)
    ways = {"history": F.col("p"), "majority": (F.col("p") > 0.5).cast("double"), "half": F.lit(0.5)}
    every = reduce(DataFrame.unionByName, (rows.select(F.lit(n).alias("model"), "m", "y", p.alias("p")) for n, p in ways.items()))
    wide = metrics.scores(metrics.confusion(every, "model", "m"), "model", "m")
    return wide.unpivot(["model", "m"], list(_METRICS), "metric", "value")


@query("st03_shared_draws_by_model")
def st03_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and interval of each model and metric over periods, from 10,000 draws of periods that all of them share."""
    got = draws.shared_draws(_scored(spark, sf_dir), "m", "value", "model", "metric")
    return got.select("model", "metric", "units", *(F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")))


@query("st05_paired_differences")
def st05_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences of models by the same draws, and the periods that the first one wins (less, for Brier scores)."""
    d = draws.paired(_scored(spark, sf_dir), "m", "model", "value", [("history", "majority"), ("history", "half"), ("majority", "half")], "metric")
    spread = draws.shared_draws(d, "m", "difference", "model_a", "model_b", "metric")
    better = F.when(F.col("metric") == "brier", F.col("difference") < -1e-12).otherwise(F.col("difference") > 1e-12)
    wins = d.groupBy("model_a", "model_b", "metric").agg(F.count_if(better).alias("wins"))
    return spread.join(wins, ["model_a", "model_b", "metric"]).select("model_a", "model_b", "metric", "units", *(F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")), "wins")
