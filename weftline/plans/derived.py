"""Further graph, panel, sequence, simulation, statistics and model queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import checks, text
from weftline.operators import arrival, communities, graph, metrics, models, panel, simulate, spectral, stats
from weftline.operators.scan import running
from weftline.operators.stats import block_means
from weftline.operators.components import connected_components
from weftline.plans.graphs import _grid, x06
from weftline.plans.panels import _FC, _LAB, _forecasts, _labels, _posts, t11
from weftline.plans.registry import query
from weftline.plans.sql import both, duck, view
from weftline.session import cut

# plain SQL for both engines
both("k10_first_targets", "SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM pairs) x WHERE r <= 20", ("pairs",))
both("a14_pivot", "SELECT u, max(CASE WHEN kind = 'view' THEN n END) AS n_view, max(CASE WHEN kind = 'click' THEN n END) AS n_click, max(CASE WHEN kind = 'error' THEN n END) AS n_error FROM (SELECT u, kind, count(*) AS n FROM post GROUP BY u, kind) x GROUP BY u", ("post",))
both("w13_running_max", "SELECT kind, week, max(n) OVER (PARTITION BY kind ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM (SELECT kind, week, count(*) AS n FROM post GROUP BY kind, week) x", ("post",))
both("d08_epoch_seconds", "SELECT event_id, $epoch(ts)$ AS seconds FROM events")
both("m03_rounding", "SELECT event_id, CAST(floor(value) AS BIGINT) AS f, $ceil(value)$ AS c, CAST(round(value * 10 + 0.05E0) AS BIGINT) AS r FROM events")
both("g01_graph_from_list", "SELECT src, dst, CAST(sum(w) AS BIGINT) AS w FROM weekly GROUP BY src, dst", ("weekly",))
both("g05_strength", "SELECT node, CAST(sum(s) AS BIGINT) AS strength FROM (SELECT src AS node, w AS s FROM pairs UNION ALL SELECT dst, w FROM pairs) x GROUP BY node", ("pairs",))
both("t03_cumulative_panel", "WITH p AS (SELECT a.u, b.m, coalesce(l.k1, 0) AS k1, coalesce(l.k0, 0) AS k0 FROM (SELECT DISTINCT u FROM lab) a CROSS JOIN (SELECT DISTINCT m FROM lab) b LEFT JOIN lab l ON l.u = a.u AND l.m = b.m) SELECT u, m, CAST(sum(k1) OVER (PARTITION BY u ORDER BY m) AS BIGINT) AS ones, CAST(sum(k0) OVER (PARTITION BY u ORDER BY m) AS BIGINT) AS zeros FROM p", ("lab",))
both("st03_shared_draws_bootstrap", "WITH w AS (SELECT row_number() OVER (ORDER BY m) - 1 AS i, m, avg(CAST(k1 AS DOUBLE) / (k1 + k0)) AS a, avg(CASE WHEN k1 > k0 THEN 1.0E0 ELSE 0.0E0 END) AS b FROM lab GROUP BY m), n AS (SELECT count(*) AS n FROM w), d AS (SELECT $numbers(1; 200)$ AS draw), p AS (SELECT draw, (draw * 7919 + w.i * 104729 + draw * w.i * 31) % n AS pick FROM d CROSS JOIN w CROSS JOIN n), s AS (SELECT draw, avg(w.a) AS a, avg(w.b) AS b, avg(w.a - w.b) AS difference FROM p JOIN w ON p.pick = w.i GROUP BY draw) SELECT round($pct(a; 0.025)$, 7) AS a_lo, round($pct(a; 0.975)$, 7) AS a_hi, round($pct(b; 0.025)$, 7) AS b_lo, round($pct(b; 0.975)$, 7) AS b_hi, round($pct(difference; 0.025)$, 7) AS difference_lo, round($pct(difference; 0.975)$, 7) AS difference_hi FROM s", ("lab",))
both("st05_paired_wins", "WITH x AS (SELECT week, count_if(y = 1) AS a, count_if(y = 0) AS b FROM post GROUP BY week) SELECT count_if(a - b > 1e-12) AS wins, count_if(b - a > 1e-12) AS losses, count_if(abs(a - b) <= 1e-12) AS ties FROM x", ("post",))
both("st17_established", "SELECT kind, lo > 0 AND p < 0.05 AS established FROM (SELECT kind, avg(value) - 1.96E0 * stddev_samp(value) / sqrt(count(*)) - 5 AS lo, 1.0E0 / count(*) AS p FROM post GROUP BY kind) x", ("post",))
both("v04_chronology", "SELECT count(*) AS violations FROM (SELECT week, node, max(tm) AS last_at FROM (SELECT week, src AS node, $days(week; DATE '2024-01-01')$ AS tm FROM weekly) a GROUP BY week, node) x WHERE last_at > $days(week; DATE '2024-01-01')$", ("weekly",))
both("v05_means_rederived", "SELECT count(*) AS violations FROM (SELECT u, avg(value) AS a FROM post GROUP BY u) x JOIN (SELECT u, sum(value) / count(*) AS b FROM post GROUP BY u) y ON x.u = y.u WHERE abs(a - b) > 1e-10", ("post",))
both("ml23_history_cohort", "WITH f AS (SELECT u, min(week) AS first_week FROM post GROUP BY u) SELECT p.week, count(*) AS rows_n, count_if(p.week > f.first_week) AS with_history FROM post p JOIN f ON p.u = f.u GROUP BY p.week", ("post",))


@query("c04_reshares", duck("SELECT o_orderkey AS id, concat('c', CAST(o_custkey AS STRING)) AS handle FROM orders WHERE o_orderkey % 4 = 0"))
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("id", F.explode(text.reshares(F.col("text"))).alias("handle"))


@query("j04_one_to_one", duck("SELECT a.u, a.n, b.m FROM (SELECT u, count(*) AS n FROM post GROUP BY u) a JOIN (SELECT u, max(k) AS m FROM post GROUP BY u) b USING (u)", ("post",)))
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = view(spark, sf_dir, "post")
    return checks.join_one_to_one(post.groupBy("u").agg(F.count("*").alias("n")), post.groupBy("u").agg(F.max("k").alias("m")), ["u"])


@query("f18_f19_schema_checks", duck("SELECT count(*) AS n FROM orders"))
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return checks.assert_schema(orders, ["o_orderkey", "o_custkey"], forbidden=("label", "target")).agg(F.count("*").alias("n"))


@query("r01_r03_arrays", duck("SELECT u, array_to_string(list_slice(list(k ORDER BY ts, event_id), 1, 5), ',') AS first_five, list(k ORDER BY ts, event_id)[-1] AS last_k, count(*) AS n FROM post GROUP BY u", ("post",)))
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "k"))), lambda x: x["k"])
    got = view(spark, sf_dir, "post").groupBy("u").agg(ordered.alias("ks"))
    return got.select("u", F.array_join(F.slice("ks", 1, 5), ",").alias("first_five"), F.element_at("ks", -1).alias("last_k"), F.size("ks").cast("long").alias("n"))


@query("r04_json_vectors", duck("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events"))
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    again = F.to_json(F.from_json("props", "k INT"))
    return events.select("event_id", F.from_json(again, "k INT")["k"].alias("k"))


@query("m04_normal_tail", "SELECT i, round(i / 4.0, 9) AS z FROM range(0, 21) t(i)")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from two-sided tails to z by bisection on the tail: the identity to nine digits."""

    @F.pandas_udf("double")
    def back(z: pd.Series) -> pd.Series:
        out = []
        for p in (math.erfc(v / math.sqrt(2)) for v in z):
            lo, hi = 0.0, 40.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if math.erfc(mid / math.sqrt(2)) > p else (lo, mid)
            out.append((lo + hi) / 2)
        return pd.Series(out)

    return spark.range(21).select(F.col("id").alias("i"), F.round(back(F.col("id") / 4.0), 9).alias("z"))


@query("m07_keyed_uniform")
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def draw(node: pd.Series) -> pd.Series:
        return pd.Series(simulate.keyed_uniform(node.to_numpy(), 0, 0, 0))

    return view(spark, sf_dir, "nodes").select("node", draw("node").alias("u"))


# graphs


@query("g25_layer_overlap_spearman", duck("WITH a AS (SELECT dst AS node, CAST(sum(w) AS DOUBLE) AS s FROM typed WHERE kind = 'view' GROUP BY dst), b AS (SELECT dst AS node, CAST(sum(w) AS DOUBLE) AS s FROM typed WHERE kind = 'click' GROUP BY dst), j AS (SELECT a.s AS x, b.s AS y FROM a JOIN b USING (node)), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM j) SELECT round(corr(x, y), 9) AS spearman, count(*) AS n FROM r", ("typed",)))
def g25(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "typed").groupBy("kind", F.col("dst").alias("node")).agg(F.sum("w").cast("double").alias("s"))
    a, b = d.where("kind = 'view'").select("node", F.col("s").alias("x")), d.where("kind = 'click'").select("node", F.col("s").alias("y"))
    return stats.spearman(a.join(b, "node"), "x", "y").withColumn("spearman", F.round("spearman", 9))


@query("g30_fan_out_rows", duck("WITH x AS (SELECT dst, src, w, row_number() OVER (PARTITION BY dst ORDER BY sha256(concat('42|', CAST(dst AS STRING), '|', CAST(src AS STRING)))) AS r FROM pairs WHERE src <> dst) SELECT dst AS node, count(*) AS neighbours, round(sum(ln(1.0 + w)), 6) AS log_weight FROM x WHERE r <= 16 GROUP BY dst", ("pairs",)))
def g30(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit("42|"), F.col("dst").cast("string"), F.lit("|"), F.col("src").cast("string")), 256)
    w = Window.partitionBy("dst").orderBy(order)
    kept = view(spark, sf_dir, "pairs").where("src <> dst").withColumn("r", F.row_number().over(w)).where("r <= 16")
    return kept.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("neighbours"), F.round(F.sum(F.log1p("w")), 6).alias("log_weight"))


@query("g21_communities")
def g21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.greedy_modularity(view(spark, sf_dir, "pairs"), most_nodes=100)


@query("g32_g34_power_radius")
def g32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_radius(view(spark, sf_dir, "pairs")).agg(F.max("radius").alias("radius")).withColumn("beta_c", F.try_divide(F.lit(0.25), F.nullif(F.round("radius", 12), F.lit(0.0))))


_WEEK_WCC = "e AS (SELECT week, src AS a, dst AS b FROM weekly UNION SELECT week, dst, src FROM weekly), r(week, node, low) AS (SELECT week, a, a FROM e UNION SELECT r.week, e.b, r.low FROM r JOIN e ON e.week = r.week AND e.a = r.node WHERE r.low < e.b), c AS (SELECT week, node, min(low) AS component FROM r GROUP BY week, node)"


@query("t05_weekly_snapshots", duck(f"WITH {_WEEK_WCC} SELECT week, max(n) AS largest, CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components FROM (SELECT week, component, count(*) AS n FROM c GROUP BY week, component) x GROUP BY week", ("weekly",)).replace("WITH ix", "WITH RECURSIVE ix", 1))
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak components of all weeks in one run: a node's id carries its week."""
    weekly = view(spark, sf_dir, "weekly")
    key = lambda c: (F.datediff("week", F.lit("1970-01-01")).cast("long") * 10**11 + F.col(c))
    part = connected_components(weekly.select(key("src").alias("a"), key("dst").alias("b")))
    ends = graph.vertices(weekly, "week").withColumn("node_key", key("node"))
    sizes = ends.join(part.withColumnRenamed("node", "node_key"), "node_key", "left").groupBy("week", F.coalesce("component", "node_key").alias("c")).agg(F.count("*").alias("n"))
    return sizes.groupBy("week").agg(F.max("n").alias("largest"), F.sum("n").alias("nodes"), F.count("*").alias("components"))


# panels and sequences


@query("t12_imputed_history", duck(f"WITH {_LAB}, h AS (SELECT a.u, a.m, a.y, count(b.y) AS n, sum(b.y) AS ones FROM l a LEFT JOIN l b ON a.u = b.u AND b.m < a.m GROUP BY a.u, a.m, a.y), t AS (SELECT avg(CAST(y AS DOUBLE)) AS p FROM h WHERE m < DATE '1996-01-01') SELECT u, m, round(coalesce(round(ones / CAST(nullif(n, 0) AS DOUBLE), 9), p), 6) AS past_rate_1 FROM h CROSS JOIN t", ("lab",)))
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t11(spark, sf_dir)
    got = models.impute(rows.where("m < DATE '1996-01-01'"), rows, "past_rate_1", "periods_since", "y")
    return got.select("u", "m", F.round("past_rate_1", 6).alias("past_rate_1"))


@query("t13_sequences", duck(f"WITH {_LAB} SELECT a.u, a.m, string_agg(CAST(b.y AS STRING), ',' ORDER BY b.m) AS before FROM l a LEFT JOIN l b ON a.u = b.u AND b.m < a.m AND b.y IS NOT NULL GROUP BY a.u, a.m", ("lab",)))
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("u").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list("y").over(w)
    return _labels(spark, sf_dir).select("u", "m", F.nullif(F.array_join(before, ","), F.lit("")).alias("before"))


@query("t16_unique_seeds", duck("SELECT seed, max(n) AS n FROM (SELECT src AS seed, count(*) AS n FROM pairs GROUP BY src UNION ALL SELECT src, count(*) FROM pairs GROUP BY src) x GROUP BY seed", ("pairs",)))
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "pairs").groupBy(F.col("src").alias("seed")).agg(F.count("*").alias("n"))
    return d.unionByName(d).dropDuplicates(["seed"])


_W = "1.959963984540054E0"


@query("t18_weekly_wilson", duck(f"SELECT week, n, round((p + {_W} * {_W} / (2 * n) - {_W} * sqrt(p * (1 - p) / n + {_W} * {_W} / (4.0E0 * n * n))) / (1 + {_W} * {_W} / n), 9) AS lo FROM (SELECT week, count(*) AS n, avg(CAST(y AS DOUBLE)) AS p FROM post GROUP BY week) x", ("post",)))
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "post").groupBy("week").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    return c.select("week", "n", F.round(stats.wilson(F.col("k"), F.col("n"), clamp=False)[0], 9).alias("lo"))


# simulations


@query("x08_single_spread")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spread: the other side can't pass anything on."""
    grid = spark.createDataFrame([("single", 1.0, 0.0, 0.25)], "cell string, beta_0 double, beta_1 double, gamma double")
    return simulate.simulate(view(spark, sf_dir, "pairs"), grid, runs=20, steps=100)


@query("x09_x12_parameter_grid")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [(f"{a}|{b}|{g}", a, b, g) for a in (0.5, 1.0, 1.5) for b in (0.5, 1.0, 1.5) for g in (0.1, 0.25)]
    got = simulate.simulate(view(spark, sf_dir, "pairs"), spark.createDataFrame(values, "cell string, beta_0 double, beta_1 double, gamma double"), runs=5, normalisation="log")
    return got.groupBy("cell").agg(F.avg("secondary_0").alias("mean_0"), F.avg("secondary_1").alias("mean_1"), F.percentile("reached_0", F.lit(0.95)).alias("p95_0"))


@query("x11_x16_direction_contrast")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded against reversed edges, paired by cell and run, which share their draws."""
    edges = view(spark, sf_dir, "pairs")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    total = lambda e, n: simulate.simulate(e, _grid(spark), runs=20).select("cell", "run", (F.col("secondary_0") + F.col("secondary_1")).alias(n))
    d = total(edges, "a").join(total(back, "b"), ["cell", "run"]).withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("cell").agg(F.avg("d").alias("mean"), F.try_divide(F.avg("d"), F.stddev_samp("d")).alias("dz"), F.count_if(F.col("d") > 0).alias("wins"))


@query("x17_amplification")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x06(spark, sf_dir).select("cell", "run", ((F.col("secondary_0") + F.col("secondary_1")) / 10).alias("amplification"))


# statistics


@query("st06_block_bootstrap")
def st06(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = view(spark, sf_dir, "post").groupBy("kind", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("d")["v"].to_numpy()
        out = {"kind": [f["kind"].iloc[0]]}
        for length in (3, 4):
            means = block_means(x, min(length, len(x)), 10_000)
            out |= {f"lo_{length}": [float(np.quantile(means, 0.025))], f"hi_{length}": [float(np.quantile(means, 0.975))]}
        return pd.DataFrame(out)

    return daily.groupBy("kind").applyInPandas(one, "kind string, lo_3 double, hi_3 double, lo_4 double, hi_4 double")


@query("st11_uncentred_permutation")
def st11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "post").groupBy("kind", "u").agg(F.avg("value").alias("x"), F.avg(F.col("y").cast("double")).alias("share"), (F.col("u") % 4).alias("s"))
    return stats.permutation_test(rows, "x", "share", "kind", stratum="s", draws=500, centred=False)


@query("st15_paired_run_bootstrap")
def st15(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = x06(spark, sf_dir).select("cell", (F.col("secondary_0") - F.col("secondary_1")).cast("double").alias("d"))
    return stats.bootstrap(runs, "d", "cell", draws=5000)


# models


@query("ml09_ml14_graph_heads")
def ml09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head trained on propagated features (symmetric, mean of in-neighbours) and on the same with reversed edges."""
    post, edges = view(spark, sf_dir, "post"), view(spark, sf_dir, "pairs")
    own = graph.vertices(edges).join(post.groupBy(F.col("u").alias("node")).agg(F.avg("value").alias("v"), F.avg(F.col("y").cast("double")).alias("s")), "node", "left").na.fill(0.0)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    kinds = {"gcn": graph.propagate(edges, own, ["v", "s"]), "sage": graph.mean_messages(edges, own, ["v", "s"]), "reversed": graph.mean_messages(back, own, ["v", "s"])}
    out = None
    for name, f in kinds.items():
        part = F.when(F.col("node") % 5 < 3, "train").when(F.col("node") % 5 == 3, "validation").otherwise("test")
        rows = f.join(own.select("node", F.col("s").alias("own")), "node").select(F.lit(name).alias("job"), F.col("node").alias("row"), (F.col("own") > 0.5).cast("int").alias("y"), "v", "s", part.alias("part"))
        out = rows if out is None else out.unionByName(rows)
    return models.train_jobs(out, ["v", "s"], "y", "part", "job")


@query("ml20_ml21_metrics_by_model", duck(f"WITH {_FC} SELECT model, count(*) AS n, round(avg((p - y) * (p - y)), 7) AS brier FROM (SELECT 'history' AS model, y, p FROM fc UNION ALL SELECT 'half', y, 0.5 FROM fc) x GROUP BY model", ("lab",)))
def ml20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecasts(spark, sf_dir)
    every = rows.select(F.lit("history").alias("model"), "y", "p").unionByName(rows.select(F.lit("half").alias("model"), "y", F.lit(0.5).alias("p")))
    n = every.groupBy("model").agg(F.count("*").alias("n"))
    return metrics.confusion(every, "model").join(n, "model").select("model", "n", F.round("brier", 7).alias("brier"))


@query("ml08_ml12_sequence_states")
def ml08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last recurrent states over each user's padded label sequences, with fixed weights from a seed."""
    rng = np.random.default_rng(0)
    weights = {"w" + g: rng.normal(size=(1, 4)) for g in "zrh"} | {"u" + g: rng.normal(size=(4, 4)) for g in "zrh"} | {"b" + g: np.zeros(4) for g in "zrh"}
    w = Window.partitionBy("u").orderBy("m").rowsBetween(-25, -1)
    rows = _labels(spark, sf_dir).select("u", "m", F.collect_list("y").over(w).alias("before"))

    def states(frames):
        for f in frames:
            n = np.array([len(x) for x in f["before"]], int)
            x = np.zeros((len(f), max(1, n.max(initial=1)), 1))
            for i, s in enumerate(f["before"]):
                x[i, : len(s), 0] = s
            h = models.gru(x, n, weights)
            yield pd.DataFrame({"u": f["u"], "m": f["m"], "state": list(np.round(h, 6))})

    return rows.mapInPandas(states, "u bigint, m date, state array<double>")


@query("ml11_attention_states")
def ml11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention over each node's up to 16 in-neighbours, itself first, by key; a task holds a slice of receivers."""
    order = Window.partitionBy("dst").orderBy(F.xxhash64("dst", "src"))
    near = view(spark, sf_dir, "pairs").where("src <> dst").withColumn("r", F.row_number().over(order)).where("r <= 16")
    lists = near.groupBy(F.col("dst").alias("node")).agg(F.collect_list(F.struct("src", "w")).alias("near"))
    rng = np.random.default_rng(1)
    w, a, b = rng.normal(size=(2, 2, 3)), rng.normal(size=(2, 3)), rng.normal(size=(2, 3))
    feature = lambda ids: np.stack([np.cos(ids), np.sin(ids)], 1)  # noqa: E731  a node's features follow from its id

    def attend(frames):
        for f in frames:
            out = []
            for node, near in zip(f["node"], f["near"]):
                ids = np.array([node, *(x["src"] for x in near)], float)
                k = ids.size
                got = models.attention(feature(ids), np.arange(k)[None, :].repeat(k, 0), np.log1p(np.array([1.0, *(float(x["w"]) for x in near)]))[None, :].repeat(k, 0), np.ones((k, k), bool), w, a, b)
                out.append((node, np.round(got[0], 6)))
            yield pd.DataFrame(out, columns=["node", "state"])

    return lists.mapInPandas(attend, "node bigint, state array<double>")


_RATIO = "e AS (SELECT DISTINCT src, dst, $epoch(ts)$ AS tm FROM ix), r(seed, node, tm) USING KEY (seed, node) AS (SELECT src, dst, min(tm) FROM e GROUP BY src, dst UNION SELECT r.seed, e.dst, min(e.tm) FROM r JOIN e ON e.src = r.node AND e.tm >= r.tm LEFT JOIN recurring.r c ON c.seed = r.seed AND c.node = e.dst WHERE c.tm IS NULL OR e.tm < c.tm GROUP BY r.seed, e.dst), g AS (SELECT DISTINCT src, dst FROM e), s(seed, node) AS (SELECT src, dst FROM g UNION SELECT s.seed, g.dst FROM s JOIN g ON g.src = s.node), a AS (SELECT seed, count(*) AS n FROM r WHERE node <> seed GROUP BY seed), b AS (SELECT seed, count(*) AS n FROM s WHERE node <> seed GROUP BY seed) SELECT x.src AS seed, coalesce(a.n, 0) / CAST(b.n AS DOUBLE) AS ratio FROM (SELECT DISTINCT src FROM e) x LEFT JOIN a ON a.seed = x.src LEFT JOIN b ON b.seed = x.src"


@query("t15_reach_ratio", duck(f"WITH {_RATIO}", ("ix",)).replace("WITH ix", "WITH RECURSIVE ix", 1))
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reached in time as a share of those reached at all, by seed; null for a seed that reaches none."""
    ix = _timed(spark, sf_dir)
    return _ratios(ix, ix.select(F.col("src").alias("seed")).distinct())


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(view(spark, sf_dir, "ix").select("src", "dst", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")))


def _ratios(ix: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, ratio) of seeds (seed), over all events."""
    seeds = cut(seeds)
    start = ix.agg(F.min("at").alias("start"))
    timed = arrival.reach_sizes(ix, seeds.crossJoin(start)).withColumnRenamed("n", "t")  # a start for all
    static = arrival.reach_sizes(ix.select("src", "dst"), seeds).withColumnRenamed("n", "s")
    return seeds.join(timed, "seed", "left").join(static, "seed", "left").select("seed", F.try_divide(F.coalesce("t", F.lit(0)), F.nullif("s", F.lit(0))).alias("ratio"))


_STRENGTH = duck("SELECT src AS seed, count(*) AS w FROM ix GROUP BY src", ("ix",))
_RATIOS = duck(f"WITH {_RATIO}", ("ix",)).replace("WITH ix", "WITH RECURSIVE ix", 1)
#: Seeds of a stratum at most.
STRATUM = 500


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stratum, seed, ratio): seeds by hash, and those with most events; a seed may be in both. Other seeds aren't followed."""
    ix = _timed(spark, sf_dir)
    strength = cut(ix.groupBy(F.col("src").alias("seed")).agg(F.count("*").alias("w")))
    drawn = strength.orderBy(F.sha2(F.concat(F.lit("42|"), F.col("seed").cast("string")), 256)).limit(STRATUM)
    strong = strength.orderBy(F.desc("w"), "seed").limit(STRATUM)
    both = drawn.select(F.lit("random").alias("stratum"), "seed").unionByName(strong.select(F.lit("high_out_strength").alias("stratum"), "seed"))
    both = cut(both, [strength])
    return both.join(_ratios(ix, both.select("seed").distinct()), "seed")


@query(
    "t15_reach_by_stratum",
    f"WITH w AS ({_STRENGTH}), z AS (SELECT 'random' AS stratum, seed FROM (SELECT seed FROM w ORDER BY sha256('42|' || CAST(seed AS VARCHAR)) LIMIT {STRATUM}) x UNION ALL SELECT 'high_out_strength', seed FROM (SELECT seed FROM w ORDER BY w DESC, seed LIMIT {STRATUM}) y) SELECT stratum, count(*) AS seeds, count(*) - count(ratio) AS zero_static, round(avg(ratio), 9) AS mean_ratio, round(median(ratio), 9) AS median_ratio, round(min(ratio), 9) AS least_ratio FROM z JOIN ({_RATIOS}) q USING (seed) GROUP BY stratum",
)
def t15_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("ratio")
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("seeds"), F.count_if(ratio.isNull()).alias("zero_static"), F.round(F.avg(ratio), 9).alias("mean_ratio"), F.round(F.median(ratio), 9).alias("median_ratio"), F.round(F.min(ratio), 9).alias("least_ratio"))


@query("t15_stratum_bootstrap")
def t15_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median of a stratum's ratios with intervals of 2000 draws of its seeds, STRATUM at most."""
    return stats.bootstrap(_strata(spark, sf_dir).where("ratio is not null"), "ratio", "stratum", draws=2000)


@query("t09_conservation", "SELECT CAST(0 AS BIGINT) AS violations")
def t09c(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.cohorts(t11(spark, sf_dir), "m", "y", "previous_available")
    return rows.where("active <> evaluated + cold_start + ties").agg(F.count("*").alias("violations"))


@query("k01_multi_key_sort", "SELECT c_mktsegment, c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return running(c, [F.col("c_mktsegment"), F.desc("c_acctbal"), F.col("c_custkey")], {"place": F.lit(1)}).select("c_mktsegment", "c_custkey", F.col("place").cast("int").alias("place"))
