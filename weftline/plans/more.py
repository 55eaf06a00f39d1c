"""Further statistics, replay, experiments, model tables and stream queries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph, metrics, models, neural, simulate, spectral, stats
from weftline.plans.io import _drain, _events, _place
from weftline.plans.panels import _FC, _LAB, _forecasts, t11
from weftline.plans.registry import query
from weftline.plans.sql import duck, view
from weftline.session import cut
from weftline.sources import files
from weftline.streaming import weekly

# text, arrays, tails

_NUMBER, _MAIL = "[0-9]{3,}", "[A-Za-z0-9_.]+@[A-Za-z0-9]+[.][a-z]+"


@query("c10_regex_find", f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_NUMBER}')) AS BIGINT) AS numbers, CAST(len(regexp_extract_all(coalesce(text, ''), '{_MAIL}')) AS BIGINT) AS mails, nullif(regexp_extract(coalesce(text, ''), '{_MAIL}'), '') AS first_mail FROM documents")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    found = lambda p: F.regexp_extract_all("text", F.lit(p), 0)
    return docs.select("doc_id", F.size(found(_NUMBER)).cast("long").alias("numbers"), F.size(found(_MAIL)).cast("long").alias("mails"), F.get(found(_MAIL), F.lit(0)).alias("first_mail"))


@query("r02_slices", duck("SELECT u, array_to_string(list_slice(ks, 1, 4), ',') AS first_four, array_to_string(list_slice(ks, -3, -1), ',') AS last_three FROM (SELECT u, list(k ORDER BY ts, event_id) AS ks FROM post GROUP BY u) x", ("post",)))
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "k"))), lambda x: x["k"])
    got = view(spark, sf_dir, "post").groupBy("u").agg(ordered.alias("ks"))
    last = F.slice("ks", F.greatest(F.lit(1), F.size("ks") - 2), F.lit(3))
    return got.select("u", F.array_join(F.slice("ks", 1, 4), ",").alias("first_four"), F.array_join(last, ",").alias("last_three"))


@query("m04_log_tail", "SELECT i AS z, round(log10(2.0) - i * i / (2 * ln(10.0)) - log10(i * sqrt(2 * pi())) + log10(1 - pow(i, -2) + 3 * pow(i, -4) - 15 * pow(i, -6) + 105 * pow(i, -8)), 6) AS log10_p, true AS agrees FROM (SELECT CAST(x AS DOUBLE) AS i FROM range(8, 61) t(x)) q")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided normal tails as logarithms, also where the tail itself is 0 in double precision; near z they agree with erfc."""

    @F.pandas_udf("double")
    def plain(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.log10(p) if (p := math.erfc(v / math.sqrt(2))) > 0 else math.nan)

    z = F.col("z")
    got = spark.range(8, 61).select(F.col("id").cast("double").alias("z")).withColumns({"log10_p": stats.log10_tail(z), "by_erfc": plain("z")})
    return got.select("z", F.round("log10_p", 6).alias("log10_p"), (F.col("by_erfc").isNull() | F.isnan("by_erfc") | (F.abs(F.col("log10_p") - F.col("by_erfc")) < 1e-5)).alias("agrees"))


# graphs

_LAYERS = "t AS (SELECT concat('recorded|', kind) AS layer, src, dst, w FROM typed UNION ALL SELECT concat('reversed|', kind), dst, src, w FROM typed)"
_LAYER_SQL = f"""WITH {_LAYERS}, v AS (SELECT layer, src AS node FROM t UNION SELECT layer, dst FROM t), r(layer, a, b) AS (SELECT layer, src, dst FROM t UNION SELECT r.layer, r.a, t.dst FROM r JOIN t ON t.layer = r.layer AND t.src = r.b),
 u AS (SELECT layer, src AS a, dst AS b FROM t UNION SELECT layer, dst, src FROM t), k(layer, node, low) AS (SELECT layer, a, a FROM u UNION SELECT k.layer, u.b, k.low FROM k JOIN u ON u.layer = k.layer AND u.a = k.node WHERE k.low < u.b),
 wk AS (SELECT layer, max(n) AS largest_weak FROM (SELECT layer, low, count(*) AS n FROM (SELECT layer, node, min(low) AS low FROM k GROUP BY layer, node) q GROUP BY layer, low) z GROUP BY layer),
 m AS (SELECT x.layer, x.a AS node, min(x.b) AS low FROM r x JOIN r y ON x.layer = y.layer AND x.a = y.b AND x.b = y.a GROUP BY x.layer, x.a), s AS (SELECT v.layer, v.node, least(v.node, coalesce(m.low, v.node)) AS component FROM v LEFT JOIN m ON m.layer = v.layer AND m.node = v.node),
 core AS (SELECT layer, component FROM (SELECT layer, component, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, component DESC) AS place FROM s GROUP BY layer, component) q WHERE place = 1),
 g AS (SELECT s.layer, s.node, CASE WHEN s.component = core.component THEN 'core' WHEN a.a IS NOT NULL THEN 'in' WHEN b.b IS NOT NULL THEN 'out' ELSE 'other' END AS region FROM s JOIN core USING (layer) LEFT JOIN r a ON a.layer = s.layer AND a.a = s.node AND a.b = core.component LEFT JOIN r b ON b.layer = s.layer AND b.b = s.node AND b.a = core.component),
 d AS (SELECT layer, node, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(iw) AS DOUBLE) AS iw, CAST(sum(ow) AS DOUBLE) AS ow FROM (SELECT layer, dst AS node, 1 AS i, 0 AS o, w AS iw, 0 AS ow FROM t UNION ALL SELECT layer, src, 0, 1, 0, w FROM t) q GROUP BY layer, node),
 p AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY iw) AS ri, row_number() OVER (PARTITION BY layer ORDER BY ow) AS ro, row_number() OVER (PARTITION BY layer ORDER BY iw DESC) AS top, count(*) OVER (PARTITION BY layer) AS n FROM d),
 e AS (SELECT layer, any_value(n) AS nodes, round(avg(i), 9) AS mean_in_degree, max(i) AS max_in_degree, max(o) AS max_out_degree, round(avg(iw), 9) AS mean_in_strength, CAST(max(iw) AS BIGINT) AS max_in_strength, CAST(max(ow) AS BIGINT) AS max_out_strength, round((2 * sum(ri * iw) - (any_value(n) + 1) * sum(iw)) / (any_value(n) * sum(iw)), 9) AS gini_in_strength, round((2 * sum(ro * ow) - (any_value(n) + 1) * sum(ow)) / (any_value(n) * sum(ow)), 9) AS gini_out_strength, round(sum(CASE WHEN top <= greatest(1, ceil(0.01 * n)) THEN iw ELSE 0 END) / sum(iw), 9) AS top_1pct_in_strength FROM p GROUP BY layer),
 c AS (SELECT t.layer, count(*) AS edges, CAST(sum(t.w) AS BIGINT) AS events, count_if(t.src = t.dst) AS loops, count_if(t.src <> t.dst AND b.src IS NOT NULL) AS mutual FROM t LEFT JOIN t b ON b.layer = t.layer AND b.src = t.dst AND b.dst = t.src GROUP BY t.layer)
 SELECT e.*, c.edges, c.events, c.loops, round(c.edges / CAST(e.nodes * (e.nodes - 1) AS DOUBLE), 9) AS density, round(c.mutual / CAST(c.edges AS DOUBLE), 9) AS reciprocity, wk.largest_weak, x.bow_tie_core, x.bow_tie_in, x.bow_tie_out, x.bow_tie_other, round(x.bow_tie_core / CAST(e.nodes AS DOUBLE), 9) AS core_share FROM e JOIN c USING (layer) JOIN wk USING (layer) JOIN (SELECT layer, count_if(region = 'core') AS bow_tie_core, count_if(region = 'in') AS bow_tie_in, count_if(region = 'out') AS bow_tie_out, count_if(region = 'other') AS bow_tie_other FROM g GROUP BY layer) x USING (layer)"""


@query("g24_all_layer_statistics", duck(_LAYER_SQL, ("typed",)).replace("WITH ix", "WITH RECURSIVE ix", 1))
def g24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind in both directions, all in one run."""
    typed = view(spark, sf_dir, "typed")
    turned = lambda name, a, b: typed.select(F.concat(F.lit(f"{name}|"), "kind").alias("layer"), F.col(a).alias("src"), F.col(b).alias("dst"), "w")
    got = graph.layer_statistics(cut(turned("recorded", "src", "dst").unionByName(turned("reversed", "dst", "src"))), "layer")
    exact = ("nodes", "edges", "events", "loops", "max_in_degree", "max_out_degree", "max_in_strength", "max_out_strength", "largest_weak", "bow_tie_core", "bow_tie_in", "bow_tie_out", "bow_tie_other")
    near = ("mean_in_degree", "mean_in_strength", "gini_in_strength", "gini_out_strength", "top_1pct_in_strength", "density", "reciprocity", "core_share")
    return got.select("layer", *exact, *(F.round(c, 9).alias(c) for c in near))


@query("g33_edge_contributions")
def g33(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "pairs")
    return graph.edge_contributions(edges, spectral.dominant_vector(edges))


_X = "f AS (SELECT node, node % 7 + 1.0E0 AS x FROM nodes)"


@query("ml02_scaled_messages", duck(f"WITH {_X}, t AS (SELECT avg(x) AS a, stddev_pop(x) AS s FROM f WHERE node % 3 <> 0), m AS (SELECT dst, sum(w * x) / sum(w) AS x FROM pairs JOIN f ON src = f.node GROUP BY dst) SELECT n.node, CASE WHEN m.x IS NULL THEN 0.0E0 ELSE round((m.x - t.a) / CASE WHEN t.s > 0 THEN t.s ELSE 1 END, 6) END AS x FROM nodes n CROSS JOIN t LEFT JOIN m ON n.node = m.dst", ("nodes",)))
def ml02(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "pairs")
    features = graph.vertices(edges).withColumn("x", F.col("node") % 7 + 1.0)
    fitted = features.where("node % 3 <> 0").agg(F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("scale_x"))
    return graph.scaled_messages(graph.mean_messages(edges, features, ["x"]), fitted, ["x"]).select("node", F.round("x", 6).alias("x"))


# statistics

#: Student's quantile for five weeks.
_T4 = "2.7764451051977987E0"


@query("st12_t_interval", duck(f"WITH w AS (SELECT kind, week, avg(value) AS v FROM post GROUP BY kind, week), s AS (SELECT kind, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS s FROM w GROUP BY kind) SELECT kind, n, round(mean, 7) AS mean, round(mean - {_T4} * s / sqrt(n), 6) AS lo, round(mean + {_T4} * s / sqrt(n), 6) AS hi FROM s WHERE n = 5", ("post",)))
def st12(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = view(spark, sf_dir, "post").groupBy("kind", "week").agg(F.avg("value").alias("v"))
    got = stats.t_interval(weeks, "v", "kind").where("n = 5")
    return got.select("kind", "n", F.round("mean", 7).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("st04_joint_bootstrap")
def st04(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "post").groupBy("kind", (F.col("u") % 10).alias("seed"), "week").agg(F.avg("value").alias("v"))
    return stats.joint_bootstrap(cells, "v", "seed", "week", "kind")


@query("v06_replayed_metrics", duck(f"WITH {_FC}, c AS (SELECT m, CAST(count_if(y = 1 AND p >= 0.5) AS DOUBLE) AS tp, CAST(count_if(y = 0 AND p >= 0.5) AS DOUBLE) AS fp, CAST(count_if(y = 1 AND p < 0.5) AS DOUBLE) AS fn, CAST(count_if(y = 0 AND p < 0.5) AS DOUBLE) AS tn, avg((p - y) * (p - y)) AS brier FROM fc GROUP BY m) SELECT m, round((coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2, 9) AS macro_f1, round(brier, 9) AS brier, true AS replayed FROM c", ("lab",)))
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that were saved beside their predictions, against those that come from the saved predictions once more."""
    predictions, saved = _place(spark), _place(spark)
    files.write_table(_forecasts(spark, sf_dir), predictions)
    files.write_table(metrics.scores(metrics.confusion(_forecasts(spark, sf_dir), "m"), "m"), saved)
    return metrics.replayed(spark.read.parquet(saved), spark.read.parquet(predictions), "m").select("m", F.round("macro_f1", 9).alias("macro_f1"), F.round("brier", 9).alias("brier"), "replayed")


# experiments


def _cells(spark: SparkSession, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, "cell string, beta_0 double, beta_1 double, gamma double")


#: Cell, chances of passing on of either side, and of recovery: named experiments, and ablations of the first.
EXPERIMENTS = (("balanced", 1.0, 1.0, 0.25), ("zero_stronger", 1.5, 0.75, 0.25), ("one_stronger", 0.75, 1.5, 0.25), ("weak", 0.5, 0.5, 0.25), ("strong", 1.5, 1.5, 0.25))
ABLATIONS = (("slow_recovery", 1.0, 1.0, 0.1), ("fast_recovery", 1.0, 1.0, 0.5), ("no_recovery", 1.0, 1.0, 0.0), ("zero_alone", 1.0, 0.0, 0.25))
#: Configurations that are run in every direction.
CONFIGURATIONS = tuple((f"{a}|{b}|{g}", a, b, g) for a, b in ((1.0, 1.0), (1.5, 0.75), (0.75, 1.5), (0.5, 0.5)) for g in (0.1, 0.25))
DIRECTIONS = ("recorded", "reversed", "layer_aware")


@query("x10_named_experiments")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _cells(spark, list(EXPERIMENTS)).withColumn("runs", F.lit(30)).unionByName(_cells(spark, list(ABLATIONS)).withColumn("runs", F.lit(10)))
    runs = simulate.simulate(view(spark, sf_dir, "pairs"), grid)
    return stats.t_interval(runs.withColumn("d", (F.col("secondary_0") - F.col("secondary_1")).cast("double")), "d", "cell")


@query("x11_all_directions")
def x11(spark: SparkSession, sf_dir: str, runs: int = 2000) -> DataFrame:
    """Eight configurations in three directions, so many runs each; directions share their draws by cell and run."""
    ix, every = cut(view(spark, sf_dir, "ix").select("src", "dst", "kind")), None
    for direction in DIRECTIONS:
        edges = graph.from_events(graph.redirect(ix, direction))
        got = simulate.simulate(edges, _cells(spark, list(CONFIGURATIONS)), runs).select(F.lit(direction).alias("direction"), "cell", "run", (F.col("secondary_0") + F.col("secondary_1")).cast("double").alias("reached"))
        every = got if every is None else every.unionByName(got)
    every = cut(every)
    base = every.where("direction = 'recorded'").select("cell", "run", F.col("reached").alias("base"))
    d = every.join(base, ["cell", "run"]).withColumn("d", F.col("reached") - F.col("base"))
    return d.groupBy("direction", "cell").agg(F.count("*").alias("runs"), F.avg("reached").alias("mean"), F.avg("d").alias("contrast"), F.try_divide(F.avg("d"), F.stddev_samp("d")).alias("dz"))


@query("x12_outcome_map")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wins, over nine by nine chances of passing on."""
    steps = [k / 4 for k in range(9)]
    runs = simulate.simulate(view(spark, sf_dir, "pairs"), _cells(spark, [(f"{a}|{b}", a, b, 0.25) for a in steps for b in steps]), runs=10)
    return runs.groupBy("cell").agg(F.count_if(F.col("outcome") == "zero").alias("zero"), F.count_if(F.col("outcome") == "one").alias("one"), F.count_if(F.col("outcome") == "close").alias("close"), F.avg("signed_secondary").alias("signed"))


def _trust(at: str) -> str:
    return f"(0.5E0 + 0.5E0 * least(1, abs({at}.c_acctbal) / 10000))"


@query("x14_direction_control", duck(f"WITH e AS (SELECT 'recorded' AS direction, src, dst, w FROM pairs UNION ALL SELECT 'reversed', dst, src, w FROM pairs) SELECT direction, src, dst, round(least(1, 0.5E0 * w / 10 * {_trust('a')} * {_trust('b')} * CASE WHEN a.c_acctbal > 5000 THEN 1.5E0 ELSE 1.0E0 END), 9) AS p FROM e JOIN customer a ON src = a.c_custkey JOIN customer b ON dst = b.c_custkey", ("pairs",)))
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of passing on along recorded and reversed edges; the multiplier of sources is that of the new source."""
    customer, pairs = spark.read.parquet(f"{sf_dir}/customer.parquet"), view(spark, sf_dir, "pairs")
    at = lambda c: customer.select(F.col("c_custkey").alias(c), (0.5 + 0.5 * F.least(F.lit(1.0), F.abs(F.col("c_acctbal").cast("double")) / 10000)).alias(f"{c}_trust"), F.when(F.col("c_acctbal") > 5000, 1.5).otherwise(1.0).alias(f"{c}_boost"))
    turned = lambda name, a, b: pairs.select(F.lit(name).alias("direction"), F.col(a).alias("src"), F.col(b).alias("dst"), "w")
    e = turned("recorded", "src", "dst").unionByName(turned("reversed", "dst", "src")).join(at("src"), "src").join(at("dst"), "dst")
    p = F.least(F.lit(1.0), 0.5 * F.col("w") / 10 * F.col("src_trust") * F.col("dst_trust") * F.col("src_boost"))
    return e.select("direction", "src", "dst", F.round(p, 9).alias("p"))


# models


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t11(spark, sf_dir).where("y is not null and past_count > 0")
    part = F.when(F.col("m") < F.lit("1995-06-01").cast("date"), "train").when(F.col("m") < F.lit("1996-01-01").cast("date"), "validation").otherwise("test")
    return rows.select((F.col("u") % 4).alias("job"), F.xxhash64("u", "m").alias("row"), F.col("y").cast("int").alias("y"), "past_rate_1", F.col("past_count").cast("double").alias("past_count"), part.alias("part"))


@query("ml22_resumed_training", "SELECT CAST(4 AS BIGINT) AS jobs, CAST(2 AS BIGINT) AS resumed, CAST(0 AS BIGINT) AS differing")
def ml22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training that stopped after two of four jobs goes on with the others, and gives what one run of all gives."""
    rows, path = cut(_jobs(spark, sf_dir)), _place(spark)
    run = lambda some: models.train_jobs(some, ["past_rate_1", "past_count"], "y", "part", "job")
    first = models.resumed(rows.where("job < 2"), run, path, "job")
    more = models.resumed(rows, run, path, "job")
    every = spark.read.parquet(f"{path}/*")
    differing = files.differing_rows(run(rows), every).count()
    del first
    return spark.createDataFrame([(every.select("job").distinct().count(), more, differing)], "jobs bigint, resumed bigint, differing bigint")


_MODELS = {"majority": "prior", "persistence": "last_y", "history": "rate", "half": "0.5E0", "ones": "1.0E0", "zeros": "0.0E0", "opposite": "1 - last_y", "smoothed": "(ones + 1) / CAST(n + 2 AS DOUBLE)", "blend": "(rate + last_y) / 2"}
_COHORTS = {"all": "n > 0", "long history": "n >= 5", "short history": "n > 0 AND n < 5"}
_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS cohort, '{m}' AS model, y, CAST({p} AS DOUBLE) AS p FROM h CROSS JOIN t WHERE m >= DATE '1996-01-01' AND {where}" for c, where in _COHORTS.items() for m, p in _MODELS.items())


@query("ml24_model_table", duck(f"WITH {_LAB}, h0 AS (SELECT a.m, a.y, count(b.y) AS n, sum(b.y) AS ones, max_by(b.y, b.m) FILTER (WHERE b.y IS NOT NULL) AS last_y FROM l a JOIN l b ON a.u = b.u AND b.m < a.m WHERE a.y IS NOT NULL GROUP BY a.u, a.m, a.y), h AS (SELECT *, ones / CAST(n AS DOUBLE) AS rate FROM h0 WHERE n > 0), t AS (SELECT avg(CAST(y AS DOUBLE)) AS prior FROM h WHERE m < DATE '1996-01-01'), z AS ({_ROWS}), c AS (SELECT cohort, model, count(*) AS n, CAST(count_if(y = 1 AND p >= 0.5) AS DOUBLE) AS tp, CAST(count_if(y = 0 AND p >= 0.5) AS DOUBLE) AS fp, CAST(count_if(y = 1 AND p < 0.5) AS DOUBLE) AS fn, CAST(count_if(y = 0 AND p < 0.5) AS DOUBLE) AS tn, avg((p - y) * (p - y)) AS brier FROM z GROUP BY cohort, model) SELECT cohort, model, n, round((tp + tn) / n, 9) AS accuracy, round((coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2, 9) AS macro_f1, round(brier, 7) AS brier FROM c", ("lab",)))
def ml24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine models in three cohorts of test rows, each scored by itself: cohorts are never pooled."""
    rows = t11(spark, sf_dir).where("y is not null and past_count > 0")
    rows = rows.select("m", "y", F.col("past_count").alias("n"), F.round(F.col("past_rate_1") * F.col("past_count")).alias("ones"), F.col("previous_label").alias("last_y"))
    prior = rows.where("m < DATE '1996-01-01'").agg(F.avg(F.col("y").cast("double")).alias("prior"))
    rows = rows.where("m >= DATE '1996-01-01'").withColumn("rate", F.col("ones") / F.col("n")).crossJoin(F.broadcast(prior))  # one row
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.expr(p).cast("double").alias("p")) for m, p in _MODELS.items())))
    cohort = F.explode(F.filter(F.array(*(F.when(F.expr(w), c) for c, w in _COHORTS.items())), lambda x: x.isNotNull()))
    scored = cut(rows.select("y", cohort.alias("cohort"), each.alias("e")).select("cohort", "e.model", "y", "e.p"))
    n = scored.groupBy("cohort", "model").agg(F.count("*").alias("n"))
    got = metrics.scores(metrics.confusion(scored, "cohort", "model"), "cohort", "model").join(n, ["cohort", "model"])
    return got.select("cohort", "model", "n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"), F.round("brier", 7).alias("brier"))


@query("ml08_trained_sequences")
def ml08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrent network on each user's earlier labels, trained by rolling origin."""
    rows = t11(spark, sf_dir).where("y is not null and past_count > 0")
    part = F.when(F.col("m") < F.lit("1995-06-01").cast("date"), "train").when(F.col("m") < F.lit("1996-01-01").cast("date"), "validation").otherwise("test")
    from pyspark.sql import Window

    before = F.collect_list("y").over(Window.partitionBy("u").orderBy("m").rowsBetween(-12, -1))
    got = t11(spark, sf_dir).where("y is not null").withColumn("before", F.transform(before, lambda v: v.cast("double"))).join(rows.select("u", "m"), ["u", "m"], "left_semi")
    jobs = got.select((F.col("u") % 4).alias("job"), F.xxhash64("u", "m").alias("row"), "y", "before", part.alias("part"))
    return neural.train_sequences(jobs, "before", "y", "part", "job")


@query("ml10_ml13_trained_graph_models")
def ml10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a node's posts are odd more often than not in a week, from the weeks before, by five graph models."""
    weekly_edges = view(spark, sf_dir, "weekly")
    post = view(spark, sf_dir, "post").groupBy("week", F.col("u").alias("node")).agg(F.avg("value").alias("v"), F.avg(F.col("y").cast("double")).alias("s"), F.count("*").cast("double").alias("n"))
    rows = post.withColumn("y", (F.col("s") > 0.5).cast("int"))
    return neural.train_graph_models(rows, weekly_edges, "week", "node", ["v", "s", "n"], "y")


# streams


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; some lack their time or their user."""
    kept = lambda c, m: F.when(F.col("event_id") % m != 0, F.col(c))
    return _events(spark, sf_dir).select(kept("ts", 11).alias("ts"), kept("u", 7).alias("src"), (F.col("u") + 1).alias("dst"), "event_id")


@query("ss03_rejected_rows", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'no time' WHEN event_id % 7 = 0 THEN 'no endpoint' ELSE 'valid' END AS reason FROM events) x GROUP BY reason")
def ss03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows and rejected ones, from the two sides that every micro-batch wrote."""
    good, bad, log = _place(spark), _place(spark), _place(spark)
    weekly.write_split(_numbered_events(spark, sf_dir), good, bad, log).awaitTermination()
    sides = spark.read.parquet(good).select(F.lit("valid").alias("reason")).unionByName(spark.read.parquet(bad).select("reason"))
    return sides.groupBy("reason").agg(F.count("*").alias("n"))


@query("ss05_partial_weeks", duck("WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events) SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n, date_trunc('week', ts) < any_value(lo) OR date_trunc('week', ts) + INTERVAL 7 DAY > any_value(hi) AS partial FROM events CROSS JOIN b GROUP BY date_trunc('week', ts)"))
def ss05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks with the flag that the stream's first and last times don't cover them; the last state of each week counts."""
    got = _drain(spark, weekly.flagged_weeks(_events(spark, sf_dir)), "update")
    last = got.groupBy("week").agg(F.max_by(F.struct("n"), "batch").alias("x")).select("week", "x.n")
    bounds = got.agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    partial = (F.col("week") < F.col("lo")) | (F.col("week") + F.expr("INTERVAL 7 DAYS") > F.col("hi"))
    return last.crossJoin(F.broadcast(bounds)).select("week", "n", partial.alias("partial"))  # one row


@query("ss07_sliding_windows", duck("SELECT start AS start, kind, count(*) AS n FROM (SELECT unnest([CAST(date_trunc('day', ts) AS TIMESTAMP), CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY]) AS start, event_type AS kind FROM events) x GROUP BY start, kind HAVING start + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"))
def ss07_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(spark, weekly.sliding(_events(spark, sf_dir), "2 days", "1 day"), "append").select("start", "kind", "n")


@query("ss07_sessions", duck("WITH e AS (SELECT user_id AS u, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT u, ts, sum(new) OVER (PARTITION BY u ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT u, min(ts) AS start, count(*) AS n FROM s GROUP BY u, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"))
def ss07_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(spark, weekly.sessions(_events(spark, sf_dir), "6 hours"), "append").select("u", "start", "n")


@query("ss07_stream_join", duck("SELECT a.event_id AS purchase_id, b.event_id AS view_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2 HOUR"))
def ss07_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the views of the two hours before, both as streams."""
    side = lambda kind, name: _events(spark, sf_dir).where(F.col("kind") == kind).select("u", "ts", F.col("event_id").alias(name))
    return _drain(spark, weekly.matched(side("purchase", "purchase_id"), side("view", "view_id"), "2 hours"), "append").select("purchase_id", "view_id")
