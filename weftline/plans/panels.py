"""Panel, history, cohort, forecast and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import metrics, models, panel, stats
from weftline.plans.registry import query
from weftline.plans.sql import both, duck, view

both("t04_weekly_event_counts", "WITH r AS (SELECT min(week) AS lo, max(week) AS hi FROM post), s AS (SELECT $weeks(lo; hi)$ AS week FROM r), c AS (SELECT week, kind, count(*) AS n FROM post GROUP BY week, kind) SELECT s.week, CAST(coalesce(sum(CASE WHEN kind = 'view' THEN n END), 0) AS BIGINT) AS n_view, CAST(coalesce(sum(CASE WHEN kind = 'click' THEN n END), 0) AS BIGINT) AS n_click, CAST(coalesce(sum(CASE WHEN kind = 'purchase' THEN n END), 0) AS BIGINT) AS n_purchase, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM s LEFT JOIN c ON s.week = c.week GROUP BY s.week", ("post",))
both("t02_period_summary", "SELECT m, count(*) AS users, CAST(sum(k1) AS BIGINT) AS ones, CAST(sum(k0) AS BIGINT) AS zeros, round(sum(k1) / CAST(nullif(sum(k1) + sum(k0), 0) AS DOUBLE), 9) AS share FROM lab GROUP BY m", ("lab",))
both("t08_majority_labels", "SELECT u, m, CASE WHEN k1 > k0 THEN 1 WHEN k0 > k1 THEN 0 END AS label, round(k1 / CAST(k1 + k0 AS DOUBLE), 9) AS ratio FROM lab", ("lab",))
both("t17_last_interaction", "SELECT week, node, max(tm) AS last_at FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, src AS node, $epoch(ts)$ AS tm FROM ix UNION ALL SELECT CAST(date_trunc('week', ts) AS DATE), dst, $epoch(ts)$ FROM ix) x GROUP BY week, node", ("ix",))
both("v02_conservation", "SELECT (SELECT count(*) FROM ix) - CAST(sum(w) AS BIGINT) AS missing FROM typed", ("typed",))
both("v03_key_uniqueness", "SELECT count(*) AS violations FROM (SELECT src, dst FROM pairs GROUP BY src, dst HAVING count(*) > 1) x", ("pairs",))


@query("t01_balanced_panel", duck("SELECT a.u, b.m, CAST(coalesce(l.k1, 0) AS BIGINT) AS k1, CAST(coalesce(l.k0, 0) AS BIGINT) AS k0 FROM (SELECT DISTINCT u FROM lab) a CROSS JOIN (SELECT DISTINCT m FROM lab) b LEFT JOIN lab l ON l.u = a.u AND l.m = b.m", ("lab",)))
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.balanced_panel(view(spark, sf_dir, "lab"), "u", "m", ["k1", "k0"])


@query("j09_asof_prior_label", duck("SELECT p.event_id, p.u, l.k AS prior_k, l.ts AS matched_at FROM (SELECT * FROM post WHERE kind = 'click') p LEFT JOIN LATERAL (SELECT k, ts FROM post q WHERE q.u = p.u AND q.kind = 'view' AND q.ts < p.ts ORDER BY q.ts DESC LIMIT 1) l ON true", ("post",)))
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = view(spark, sf_dir, "post")
    right = post.where("kind = 'view'").groupBy("u", "ts").agg(F.max_by("k", "event_id").alias("prior_k"))
    got = panel.asof(post.where("kind = 'click'").select("event_id", "u", "ts"), right, "u", "ts", ["prior_k"])
    return got.select("event_id", "u", "prior_k", "matched_at")


@query("j10_asof_inclusive", duck("SELECT a.u, a.week, (SELECT max(b.week) FROM (SELECT DISTINCT u, week FROM post WHERE kind = 'view') b WHERE b.u = a.u AND b.week <= a.week) AS matched_at FROM (SELECT DISTINCT u, week FROM post WHERE kind = 'click') a", ("post",)))
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = view(spark, sf_dir, "post")
    right = post.where("kind = 'view'").select("u", "week").distinct().withColumn("one", F.lit(1))
    return panel.asof(post.where("kind = 'click'").select("u", "week").distinct(), right, "u", "week", ["one"], strict=False).select("u", "week", "matched_at")


@query("t06_lagged_degrees", duck("WITH wk AS (SELECT DISTINCT week FROM weekly), ends AS (SELECT wk.week, x.src, x.dst, sum(x.w) AS w FROM wk JOIN weekly x ON x.week < wk.week GROUP BY wk.week, x.src, x.dst), o AS (SELECT week, src AS node, count(*) AS d, sum(w) AS s FROM ends GROUP BY week, src), i AS (SELECT week, dst AS node, count(*) AS d, sum(w) AS s FROM ends GROUP BY week, dst) SELECT week, node, CAST(coalesce(i.d, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.d, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.s, 0) AS BIGINT) AS in_strength, CAST(coalesce(o.s, 0) AS BIGINT) AS out_strength FROM o FULL JOIN i USING (week, node)", ("weekly",)))
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.lagged_degrees(view(spark, sf_dir, "weekly"))


@query("t07_leakage_invariants", duck("SELECT CAST(0 AS BIGINT) AS violations"))
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks whose lagged in or out strengths don't sum to the events before them: none."""
    weekly = view(spark, sf_dir, "weekly")
    sums = panel.lagged_degrees(weekly).groupBy("week").agg(F.sum("in_strength").alias("i"), F.sum("out_strength").alias("o"))
    weeks = weekly.groupBy("week").agg(F.sum("w").alias("n"))
    before = weeks.select(F.col("week").alias("w2"), F.col("n").alias("n2"))
    prior = weeks.join(before, F.col("w2") < F.col("week")).groupBy("week").agg(F.sum("n2").alias("prior"))
    return sums.join(prior, "week", "full").where("i <> prior OR o <> prior OR i IS NULL OR prior IS NULL").agg(F.count("*").alias("violations"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lab").select("u", "m", panel.majority_label(F.col("k0"), F.col("k1")).alias("y"))


_LAB = "l AS (SELECT u, m, CASE WHEN k1 > k0 THEN 1 WHEN k0 > k1 THEN 0 END AS y FROM lab)"


@query("t11_history_features", duck(f"WITH {_LAB}, h AS (SELECT a.u, a.m, a.y, count(b.y) AS n, sum(b.y) AS ones, max_by(b.y, b.m) FILTER (WHERE b.y IS NOT NULL) AS last_y, max(b.m) FILTER (WHERE b.y IS NOT NULL) AS last_m FROM l a LEFT JOIN l b ON a.u = b.u AND b.m < a.m GROUP BY a.u, a.m, a.y) SELECT u, m, y, last_y AS previous_label, last_y IS NOT NULL AS previous_available, round((n - ones) / CAST(nullif(n, 0) AS DOUBLE), 9) AS past_rate_0, round(ones / CAST(nullif(n, 0) AS DOUBLE), 9) AS past_rate_1, n AS past_count, CAST(date_diff('month', last_m, m) AS INT) AS periods_since FROM h", ("lab",)))
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = panel.history(_labels(spark, sf_dir), "u", "m", "y")
    return got.withColumns({"past_rate_0": F.round("past_rate_0", 9), "past_rate_1": F.round("past_rate_1", 9)})


@query("t09_cohorts", duck(f"WITH {_LAB}, h AS (SELECT a.m, a.y, count(b.y) > 0 AS known FROM l a LEFT JOIN l b ON a.u = b.u AND b.m < a.m GROUP BY a.u, a.m, a.y) SELECT m, count(*) AS active, count_if(y IS NOT NULL AND known) AS evaluated, count_if(y IS NOT NULL AND NOT known) AS cold_start, count_if(y IS NULL) AS ties FROM h GROUP BY m", ("lab",)))
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.cohorts(t11(spark, sf_dir), "m", "y", "previous_available")


@query("t10_rolling_origins", duck("WITH p AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM (SELECT DISTINCT m FROM lab) x) SELECT a.i AS origin, c.m AS train_until, b.m AS validation, a.m AS test FROM p a JOIN p b ON b.i = a.i - 1 JOIN p c ON c.i = a.i - 2 WHERE a.i >= 9", ("lab",)))
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = panel.rolling_origins(view(spark, sf_dir, "lab"), "m")
    return got.withColumn("origin", F.col("origin").cast("long"))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past share of ones as the probability of a one, by period."""
    return t11(spark, sf_dir).where("y is not null and past_rate_1 is not null").select("u", "m", "y", F.round("past_rate_1", 6).alias("p"))


_FC = f"{_LAB}, fc AS (SELECT a.u, a.m, a.y, round(round(sum(b.y) / CAST(count(b.y) AS DOUBLE), 9), 6) AS p FROM l a JOIN l b ON a.u = b.u AND b.m < a.m AND b.y IS NOT NULL WHERE a.y IS NOT NULL GROUP BY a.u, a.m, a.y)"


@query("ml16_ml17_metrics", duck(f"WITH {_FC}, c AS (SELECT m, CAST(count_if(y = 1 AND p >= 0.5) AS DOUBLE) AS tp, CAST(count_if(y = 0 AND p >= 0.5) AS DOUBLE) AS fp, CAST(count_if(y = 1 AND p < 0.5) AS DOUBLE) AS fn, CAST(count_if(y = 0 AND p < 0.5) AS DOUBLE) AS tn, avg((p - y) * (p - y)) AS brier FROM fc GROUP BY m) SELECT m, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round((coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2, 9) AS macro_f1, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 9) AS balanced_accuracy, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) END, 9) AS mcc, round(brier, 9) AS brier FROM c", ("lab",)))
def ml17(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.scores(metrics.confusion(_forecasts(spark, sf_dir), "m"), "m")
    return got.select("m", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")), *(F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy", "mcc", "brier")))


@query("ml18_roc_auc", duck(f"WITH {_FC} SELECT a.m, round(sum(CASE WHEN a.p > b.p THEN 1.0E0 WHEN a.p = b.p THEN 0.5E0 ELSE 0 END) / count(*), 9) AS roc_auc FROM fc a JOIN fc b ON a.m = b.m AND a.y = 1 AND b.y = 0 GROUP BY a.m", ("lab",)))
def ml18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_forecasts(spark, sf_dir), "m").where("roc_auc is not null").select("m", F.round("roc_auc", 9).alias("roc_auc"))


@query("ml19_average_precision", duck(f"WITH {_FC}, s AS (SELECT m, p, sum(y) AS k, count(*) AS n FROM fc GROUP BY m, p), w AS (SELECT m, k, sum(k) OVER (PARTITION BY m ORDER BY p DESC) / CAST(sum(n) OVER (PARTITION BY m ORDER BY p DESC) AS DOUBLE) AS precision_at FROM s) SELECT m, round(sum(precision_at * k) / nullif(sum(k), 0), 9) AS average_precision FROM w GROUP BY m", ("lab",)))
def ml19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_forecasts(spark, sf_dir), "m").select("m", F.round("average_precision", 9).alias("average_precision"))


@query("ml15_best_threshold", duck(f"WITH {_FC}, s AS (SELECT m, p, sum(y) AS k, count(*) AS n FROM fc GROUP BY m, p), c AS (SELECT m, p, CAST(sum(k) OVER w AS DOUBLE) AS tp, CAST(sum(n - k) OVER w AS DOUBLE) AS fp, CAST(sum(k) OVER (PARTITION BY m) AS DOUBLE) AS n1, CAST(sum(n - k) OVER (PARTITION BY m) AS DOUBLE) AS n0 FROM s WINDOW w AS (PARTITION BY m ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), f AS (SELECT m, p, (coalesce(2 * (n0 - fp) / nullif(2 * (n0 - fp) + fp + n1 - tp, 0), 0) + coalesce(2 * tp / nullif(2 * tp + fp + n1 - tp, 0), 0)) / 2 AS macro_f1, (tp / nullif(n1, 0) + (n0 - fp) / nullif(n0, 0)) / 2 AS balanced FROM c) SELECT m, threshold, macro_f1 FROM (SELECT m, p AS threshold, macro_f1, row_number() OVER (PARTITION BY m ORDER BY round(macro_f1, 12) DESC, round(balanced, 12) DESC NULLS LAST, p) AS r FROM f) q WHERE r = 1", ("lab",)))
def ml15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_forecasts(spark, sf_dir), "m")


@query("ml04_majority_baseline", duck(f"WITH {_LAB}, t AS (SELECT avg(CAST(y AS DOUBLE)) AS p FROM l WHERE y IS NOT NULL AND m < DATE '1996-01-01') SELECT u, m, y, round(p, 9) AS p1, CAST(CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS INT) AS prediction FROM l CROSS JOIN t WHERE y IS NOT NULL AND m >= DATE '1996-01-01'", ("lab",)))
def ml04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).where("y is not null")
    return models.majority(rows.where("m < DATE '1996-01-01'"), rows.where("m >= DATE '1996-01-01'"), "y").withColumn("p1", F.round("p1", 9))


@query("ml05_persistence", duck(f"WITH {_LAB} SELECT a.u, a.m, a.y, coalesce(max_by(b.y, b.m), 0) AS prediction FROM l a LEFT JOIN l b ON a.u = b.u AND b.m < a.m AND b.y IS NOT NULL WHERE a.y IS NOT NULL GROUP BY a.u, a.m, a.y", ("lab",)))
def ml05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t11(spark, sf_dir).where("y is not null").withColumn("zero", F.lit(0))
    return models.persistence(rows, "previous_label", "zero").select("u", "m", "y", "prediction")


@query("ml01_standardised", duck(f"WITH {_FC}, t AS (SELECT avg(p) AS a, stddev_pop(p) AS s FROM fc WHERE m < DATE '1996-01-01') SELECT u, m, round((p - a) / CASE WHEN s > 0 THEN s ELSE 1 END, 7) AS p FROM fc CROSS JOIN t", ("lab",)))
def ml01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecasts(spark, sf_dir)
    return models.standardise(rows.where("m < DATE '1996-01-01'"), rows, ["p"]).select("u", "m", F.round("p", 7).alias("p"))


@query("ml03_class_weights", duck(f"WITH {_LAB}, c AS (SELECT y, count(*) AS k FROM l WHERE y IS NOT NULL GROUP BY y) SELECT y, round((SELECT sum(k) FROM c) / CAST(2 * k AS DOUBLE), 9) AS weight FROM c", ("lab",)))
def ml03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).where("y is not null")
    return models.class_weights(rows, "y").select("y", F.round("weight", 9).alias("weight")).distinct()


@query("ml06_logistic")
def ml06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t11(spark, sf_dir).where("y is not null and past_count > 0")
    train = models.class_weights(rows.where("m < DATE '1996-01-01'"), "y")
    fitted = models.logistic(train, ["past_rate_1", "past_count"], "y", weight="weight")
    from pyspark.ml.functions import vector_to_array

    return fitted.transform(rows.where("m >= DATE '1996-01-01'")).select("u", "m", "y", F.round(vector_to_array("probability")[1], 6).alias("p1"))


@query("ml07_mlp_jobs")
def ml07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t11(spark, sf_dir).where("y is not null and past_count > 0")
    part = F.when(F.col("m") < F.lit("1995-06-01").cast("date"), "train").when(F.col("m") < F.lit("1996-01-01").cast("date"), "validation").otherwise("test")
    jobs = rows.select((F.col("u") % 4).alias("job"), F.xxhash64("u", "m").alias("row"), F.col("y").cast("int").alias("y"), "past_rate_1", F.col("past_count").cast("double").alias("past_count"), part.alias("part"))
    return models.train_jobs(jobs, ["past_rate_1", "past_count"], "y", "part", "job")


_POST = "(SELECT o_orderkey AS id, concat(CASE o_orderkey % 4 WHEN 0 THEN concat('RT @c', CAST(o_custkey AS STRING), ': hi ') WHEN 1 THEN concat(' @mix_', CAST(o_custkey AS STRING), ' ') ELSE 'good day ' END, '@s', CAST(o_orderkey % 97 AS STRING), ' x@mail.test @c', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN ' @toolonghandle123456 bad' ELSE '' END) AS text FROM orders)"
_WANT = f"WITH t AS (SELECT id, text, [y FOR y IN [regexp_extract(x, '^@([A-Za-z0-9_]{{1,15}})(@.*)?$', 1) FOR x IN string_split_regex(text, '[^A-Za-z0-9_@]+')] IF y <> ''] AS names, regexp_extract(concat(text, ' '), '^ *@([A-Za-z0-9_]{{1,15}})[^A-Za-z0-9_]', 1) AS lead, regexp_extract(concat(text, ' '), '^RT +@([A-Za-z0-9_]{{1,15}})[^A-Za-z0-9_]', 1) AS rt FROM {_POST} q), n AS (SELECT id, lower(unnest(names)) AS target, lead, rt FROM t) SELECT DISTINCT id, target, CASE WHEN target = lower(rt) THEN 'retweet' WHEN target = lower(lead) THEN 'reply_inferred' ELSE 'mention' END AS kind FROM n"


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT * FROM {_POST} q")


@query("c03_c06_interactions", _WANT)
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.interactions(_posts(spark, sf_dir)).select("id", "target", "kind")


@query("m08_polarity", f"SELECT id, CASE WHEN text LIKE '%good%' AND text LIKE '%bad%' THEN 0.0 WHEN text LIKE '%good%' THEN 0.7 WHEN text LIKE '%bad%' THEN -0.7 ELSE 0.0 END::DOUBLE AS polarity FROM {_POST} q")
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("id", F.round(text.polarity(F.col("text")), 9).alias("polarity"))


# statistics


@query("st01_spearman", "WITH r AS (SELECT n_regionkey, (rank() OVER (PARTITION BY n_regionkey ORDER BY x) + (count(*) OVER (PARTITION BY n_regionkey, x) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY n_regionkey ORDER BY y) + (count(*) OVER (PARTITION BY n_regionkey, y) - 1) / 2.0) AS b FROM (SELECT n_regionkey, floor(c_acctbal / 500) AS x, c_custkey % 17 AS y FROM customer JOIN nation ON c_nationkey = n_nationkey) q) SELECT n_regionkey, round(corr(a, b), 9) AS spearman, count(*) AS n FROM r GROUP BY n_regionkey")
def st01(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.floor(F.col("c_acctbal") / 500).alias("x"), (F.col("c_custkey") % 17).alias("y"))
    return stats.spearman(rows, "x", "y", "n_regionkey").withColumn("spearman", F.round("spearman", 9))


_Z = "1.959963984540054E0"


@query("st13_wilson", duck(f"SELECT kind, n, k, round(greatest(0, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0E0 * n * n))) / (1 + {_Z} * {_Z} / n)), 9) AS lo, round(least(1, (p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0E0 * n * n))) / (1 + {_Z} * {_Z} / n)), 9) AS hi FROM (SELECT kind, count(*) AS n, count_if(y = 1) AS k, avg(CAST(y AS DOUBLE)) AS p FROM post GROUP BY kind) x", ("post",)))
def st13(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "post").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("kind", "n", "k", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("st08_holm", duck("WITH p AS (SELECT kind, u, (u * 37 % 101 + 1) / 2000.0E0 AS p FROM (SELECT DISTINCT kind, u FROM post) x), s AS (SELECT kind, u, p, p * (count(*) OVER (PARTITION BY kind) - row_number() OVER (PARTITION BY kind ORDER BY p, u) + 1) AS a FROM p) SELECT kind, u, p, round(least(1, max(a) OVER (PARTITION BY kind ORDER BY p, u ROWS UNBOUNDED PRECEDING)), 9) AS holm_p FROM s", ("post",)))
def st08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "post").select("kind", "u").distinct().withColumn("p", (F.col("u") * 37 % 101 + 1) / 2000.0)
    return stats.holm(rows, "p", "kind").withColumn("holm_p", F.round("holm_p", 9))


both("st07_sign_flip", "WITH d AS (SELECT i, CAST(n AS DOUBLE) AS d FROM (SELECT row_number() OVER (ORDER BY week, kind) - 1 AS i, a - b AS n FROM (SELECT week, kind, count_if(y = 1) AS a, count_if(y = 0) AS b FROM post WHERE kind IN ('view', 'click') GROUP BY week, kind) q) z WHERE i < 10), m AS (SELECT count(*) AS k, abs(sum(d)) AS s FROM d), g AS (SELECT $numbers(0; 1023)$ AS a), f AS (SELECT a, abs(sum(CASE WHEN $bit(a; CAST(i AS INT))$ = 1 THEN d ELSE -d END)) AS t FROM g CROSS JOIN d GROUP BY a) SELECT round(avg(CASE WHEN t >= s - 1e-9 THEN 1.0E0 ELSE 0.0E0 END), 9) AS p FROM f CROSS JOIN m", ("post",))


@query("st09_mann_whitney", duck("WITH r AS (SELECT y, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0E0 AS r FROM post), c AS (SELECT CAST(count_if(y = 1) AS DOUBLE) AS n1, CAST(count_if(y = 0) AS DOUBLE) AS n0, sum(CASE WHEN y = 1 THEN r END) AS r1 FROM r), t AS (SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM post GROUP BY value) q), u AS (SELECT n1, n0, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - t / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM c CROSS JOIN t) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, u, round((u - n1 * n0 / 2 - sign(u - n1 * n0 / 2) * 0.5) / sd, 7) AS z, round(2 * u / (n1 * n0) - 1, 9) AS rank_biserial FROM u", ("post",)))
def st09(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.mann_whitney(view(spark, sf_dir, "post"), "value", "y")
    return got.select("n1", "n0", "u", F.round("z", 7).alias("z"), F.round("rank_biserial", 9).alias("rank_biserial"))


@query("st02_bootstrap")
def st02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap(view(spark, sf_dir, "post"), "value", "kind", draws=2000)


@query("st10_permutation")
def st10(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = view(spark, sf_dir, "post").groupBy("kind", "u").agg(F.avg("value").alias("x"), F.avg(F.col("y").cast("double")).alias("share"))
    return stats.permutation_test(weekly, "x", "share", "kind", draws=2000)


both("st14_normal_interval", "SELECT kind, round(avg(value), 6) AS mean, round(1.96E0 * stddev_samp(value) / sqrt(count(*)), 6) AS half FROM post GROUP BY kind", ("post",))
both("st16_random_flagger", "SELECT kind, round(2 * p * q / nullif(p + q, 0), 9) AS f1 FROM (SELECT kind, avg(CAST(y AS DOUBLE)) AS p, avg(CASE WHEN value > 15 THEN 1.0E0 ELSE 0.0E0 END) AS q FROM post GROUP BY kind) x", ("post",))
