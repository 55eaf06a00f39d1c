"""Projections, filters, joins, aggregates, windows, sorting, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import stats
from weftline.operators.scan import running
from weftline.plans.registry import query
from weftline.plans.sql import both, duck, view

# projections, filters and predicates
both("f01_project", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
both("f02_rename", "SELECT c_custkey AS node_id, c_acctbal AS balance FROM customer")
both("f03_computed", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_tax / nullif(l_discount, 0), 6) AS ratio, round(ln(1 + l_quantity), 6) AS log_q FROM lineitem")
both("f04_ordinal_constant", "SELECT 'top' AS ranking, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place, c_custkey FROM customer")
both("f05_mask", "SELECT event_id, value FROM events WHERE value > 10 AND event_type = 'view'")
both("f06_not_null", "SELECT src, dst, event_id FROM (SELECT event_id, user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events) t WHERE dst IS NOT NULL")
both("f07_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
both("f08_string_expression", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 1000")
both("f09_self_loops", "SELECT event_id, src, kind FROM ix WHERE src = dst", ("ix",))
both("f10_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
both("f11_validity_split", "SELECT event_id, CASE WHEN value IS NULL THEN 'missing' WHEN value < 1 THEN 'too small' WHEN value > 100 THEN 'too large' ELSE 'valid' END AS reason FROM events")
both("f12_domain_checks", "SELECT count_if(value < 0) AS negative, count_if(value <> floor(value)) AS fractional, count_if(value = 0) AS zero FROM events")
both("f13_identifier_pattern", "SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z0-9_]{1,15})', 1) = c_name AS valid, regexp_extract(replace(substr(c_name, 1, 15), '#', '_'), '^([A-Za-z0-9_]{1,15})', 1) = replace(substr(c_name, 1, 15), '#', '_') AS valid_short FROM customer")
both("f14_categoriser", "SELECT u, CASE WHEN sum(y) > sum(1 - y) THEN 'one' WHEN sum(y) < sum(1 - y) THEN 'zero' ELSE 'tie' END AS label FROM post GROUP BY u", ("post",))
both("f15_case", "SELECT event_id, CASE WHEN value < 10 THEN 0 WHEN value > 10 THEN 1 ELSE 2 END AS bucket FROM events")
both("f16_direction", "SELECT 'recorded' AS direction, event_id, src AS s, dst AS t FROM ix UNION ALL SELECT 'reversed', event_id, dst, src FROM ix UNION ALL SELECT 'layer_aware', event_id, CASE WHEN kind = 'click' THEN dst ELSE src END, CASE WHEN kind = 'click' THEN src ELSE dst END FROM ix", ("ix",))
both("f17_weighted_reallocation", "WITH share AS (SELECT src, dst, count(*) AS n, avg(CASE WHEN kind = 'click' THEN 1.0E0 ELSE 0.0E0 END) AS f FROM ix GROUP BY src, dst), parts AS (SELECT src, dst, n * (1 - f) AS w FROM share UNION ALL SELECT dst, src, n * f FROM share) SELECT src, dst, round(sum(w), 9) AS w FROM parts WHERE w > 0 GROUP BY src, dst", ("ix",))
both("f20_split_masks", "SELECT u, m, CASE WHEN m < DATE '1996-01-01' THEN 'train' WHEN m < DATE '1997-01-01' THEN 'validation' ELSE 'test' END AS part FROM lab", ("lab",))

# joins
both("j01_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
both("j02_left", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
both("j03_match_indicator", "SELECT c_custkey, o_custkey IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
both("j05_multi_key", "SELECT a.u, a.week, a.n AS views, b.n AS clicks FROM (SELECT u, week, count(*) AS n FROM post WHERE kind = 'view' GROUP BY u, week) a JOIN (SELECT u, week, count(*) AS n FROM post WHERE kind = 'click' GROUP BY u, week) b ON a.u = b.u AND a.week = b.week", ("post",))
both("j06_semi", "SELECT p.src, p.dst, p.w FROM pairs p WHERE p.src IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND p.dst IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", ("pairs",))
both("j07_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
both("j08_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
both("j11_latest_prior_label", "SELECT u, max_by(CASE WHEN k1 > k0 THEN 1 ELSE 0 END, m) AS label FROM lab WHERE k1 <> k0 AND m < DATE '1996-06-01' GROUP BY u", ("lab",))
both("j12_events_before_cutoff", "WITH cumulative AS (SELECT week, sum(count(*)) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) AS n FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week FROM ix) x GROUP BY week) SELECT week, CAST(upto - n AS BIGINT) AS events_before FROM cumulative", ("ix",))
both("j13_edge_endpoint_attributes", "SELECT p.src, p.dst, a.c_mktsegment AS src_segment, b.c_mktsegment AS dst_segment FROM pairs p JOIN customer a ON p.src = a.c_custkey JOIN customer b ON p.dst = b.c_custkey", ("pairs",))
both("j14_users_by_months", "SELECT u, m FROM (SELECT DISTINCT u FROM lab) a CROSS JOIN (SELECT DISTINCT m FROM lab) b", ("lab",))
both("j15_parameter_grid", "SELECT beta, gamma, seeds FROM (VALUES (0.5E0), (1.0E0), (1.5E0)) b(beta) CROSS JOIN (VALUES (0.1E0), (0.25E0)) g(gamma) CROSS JOIN (VALUES (10), (25)) s(seeds)")
both("j16_reversed_pairs", "SELECT a.src, a.dst FROM pairs a WHERE EXISTS (SELECT 1 FROM pairs b WHERE b.src = a.dst AND b.dst = a.src) AND a.src <> a.dst", ("pairs",))
both("j17_pair_overlap", "WITH a AS (SELECT src, dst FROM typed WHERE kind = 'view'), b AS (SELECT src, dst FROM typed WHERE kind = 'click'), i AS (SELECT count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x), u AS (SELECT count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) x) SELECT i.n AS both_n, u.n AS union_n, round(i.n / CAST(u.n AS DOUBLE), 9) AS jaccard, round(i.n / CAST((SELECT count(*) FROM a) AS DOUBLE), 9) AS precision_a, round(i.n / CAST((SELECT count(*) FROM b) AS DOUBLE), 9) AS coverage_b FROM i CROSS JOIN u", ("typed",))
both("j18_matched_or_zero", "SELECT a.src, a.dst, a.w AS w_view, coalesce(b.w, 0) AS w_click FROM (SELECT * FROM typed WHERE kind = 'view') a LEFT JOIN (SELECT * FROM typed WHERE kind = 'click') b ON a.src = b.src AND a.dst = b.dst", ("typed",))
both("j20_paired_comparison", "SELECT a.week, a.n - b.n AS difference FROM (SELECT week, count(*) AS n FROM post WHERE y = 1 GROUP BY week) a JOIN (SELECT week, count(*) AS n FROM post WHERE y = 0 GROUP BY week) b ON a.week = b.week", ("post",))

# aggregates
both("a01_named", "SELECT u, count(*) AS posts, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM post GROUP BY u", ("post",))
both("a02_size", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
both("a03_composite", "SELECT u, week, count(*) AS n FROM post GROUP BY u, week", ("post",))
both("a04_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
both("a05_conditional", "SELECT u, count_if(y = 0) AS zeros, count_if(y = 1) AS ones FROM post GROUP BY u", ("post",))
both("a06_weighted_mean", "SELECT u, round(sum(mean * n) / nullif(sum(n), 0), 6) AS cumulative_mean FROM (SELECT u, week, avg(value) AS mean, count(*) AS n FROM post GROUP BY u, week) x GROUP BY u", ("post",))
both("a07_sum_min_count", "SELECT event_type, sum(CASE WHEN value > 1e9 THEN value END) AS total FROM events GROUP BY event_type")
both("a08_class_statistics", "SELECT y, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, round(avg(CASE WHEN value > 10 THEN 1.0E0 ELSE 0.0E0 END), 6) AS share FROM post GROUP BY y", ("post",))
both("a10_flattened", "SELECT l_returnflag, round(avg(l_quantity), 6) AS quantity_mean, round(stddev_samp(l_quantity), 6) AS quantity_std, median(l_quantity) AS quantity_median, min(l_tax) AS tax_min, max(l_tax) AS tax_max FROM lineitem GROUP BY l_returnflag")
both("a11_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
both("a12_crosstab", "SELECT week, count_if(kind = 'view') AS n_view, count_if(kind = 'click') AS n_click, count_if(kind = 'refund') AS n_refund FROM post GROUP BY week", ("post",))
both("a13_row_shares", "SELECT kind, round(count_if(y = 0) / CAST(count(*) AS DOUBLE), 9) AS share0, round(count_if(y = 1) / CAST(count(*) AS DOUBLE), 9) AS share1 FROM post GROUP BY kind", ("post",))
both("a15_row_total", "SELECT week, v, c, v + c AS total FROM (SELECT week, count_if(kind = 'view') AS v, count_if(kind = 'click') AS c FROM post GROUP BY week) x", ("post",))
both("a16_missing", "SELECT count_if(l_shipdate IS NULL) AS shipdate, count_if(l_returnflag IS NULL) AS returnflag, count(*) AS n FROM lineitem")
both("a17_duplicates", "SELECT count(*) - count(DISTINCT o_custkey) AS surplus FROM orders")
both("a18_repeated_census", "SELECT count(*) AS repeated_values, CAST(sum(n) AS BIGINT) AS repeated_rows, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) x")
both("a19_outcomes", "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS outcome_f, count_if(o_orderstatus = 'O') AS outcome_o, count_if(o_orderstatus = 'P') AS outcome_p FROM orders GROUP BY o_orderpriority")
both("a20_mode_lexical", "SELECT g, kind FROM (SELECT u % 10 AS g, kind, row_number() OVER (PARTITION BY u % 10 ORDER BY count(*) DESC, kind) AS r FROM post GROUP BY u % 10, kind) x WHERE r = 1", ("post",))
both("a21_first_peak", "SELECT kind, min_by(week, n * 100000 + $days(week; DATE '2024-01-01')$) AS trough, max_by(week, n * 100000 - $days(week; DATE '2024-01-01')$) AS peak FROM (SELECT kind, week, count(*) AS n FROM post GROUP BY kind, week) x GROUP BY kind", ("post",))
both("a22_failure_product", "SELECT dst, round(1 - exp(sum(ln(1 - least(0.05E0 * w, 0.9E0)))), 9) AS exposure FROM pairs GROUP BY dst", ("pairs",))
both("a27_percent_of_total", "SELECT event_type, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM events GROUP BY event_type")
both("a28_mean_of_means", "SELECT kind, round(avg(m), 6) AS mean FROM (SELECT kind, week, avg(value) AS m FROM post GROUP BY kind, week) x GROUP BY kind", ("post",))
both("a30_pooled_layers", "SELECT coalesce(kind, 'pooled') AS layer, count(*) AS events, count(DISTINCT src) AS sources FROM ix GROUP BY GROUPING SETS ((kind), ())", ("ix",))

# windows
both("w01_cumulative", "SELECT u, week, n, CAST(sum(n) OVER (PARTITION BY u ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative FROM (SELECT u, week, count(*) AS n FROM post GROUP BY u, week) x", ("post",))
both("w02_strictly_lagged", "SELECT u, week, CAST(sum(n) OVER (PARTITION BY u ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM (SELECT u, week, count(*) AS n FROM post GROUP BY u, week) x", ("post",))
both("w03_cumulative_snapshots", "SELECT u, m, CAST(sum(k1) OVER (PARTITION BY u ORDER BY m) AS BIGINT) AS ones, CAST(sum(k0) OVER (PARTITION BY u ORDER BY m) AS BIGINT) AS zeros FROM lab", ("lab",))
both("w04_first_period", "SELECT DISTINCT u, min(week) OVER (PARTITION BY u) AS first_week FROM post", ("post",))
both("w05_last_before", "SELECT u, week, max(last) OVER (PARTITION BY u ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_before FROM (SELECT u, week, max($epoch(ts)$) AS last FROM post GROUP BY u, week) x", ("post",))
both("w08_top_lists", "SELECT metric, place, u FROM (SELECT metric, u, row_number() OVER (PARTITION BY metric ORDER BY v DESC, u) AS place FROM (SELECT u, 'posts' AS metric, CAST(count(*) AS DOUBLE) AS v FROM post GROUP BY u UNION ALL SELECT u, 'value', round(sum(value), 4) FROM post GROUP BY u) a) b WHERE place <= 10", ("post",))
both("w09_first_difference", "SELECT kind, week, n - lag(n) OVER (PARTITION BY kind ORDER BY week) AS step FROM (SELECT kind, week, count(*) AS n FROM post GROUP BY kind, week) x", ("post",))
both("w14_local_index", "SELECT week, u, row_number() OVER (PARTITION BY week ORDER BY u) - 1 AS idx FROM (SELECT DISTINCT week, u FROM post) x", ("post",))

# sorting and selection
both("k02_largest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
both("k03_top_by_tie_order", "SELECT kind, u, n FROM (SELECT kind, u, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, u) AS r FROM post GROUP BY kind, u) x WHERE r <= 5", ("post",))
both("k04_grid_selection", "SELECT segment, c FROM (SELECT c_mktsegment AS segment, c_nationkey AS c, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(avg(c_acctbal), 6) DESC, c_nationkey) AS r FROM customer GROUP BY c_mktsegment, c_nationkey) x WHERE r = 1")
both("k05_joint_selection", "SELECT c FROM (SELECT c, row_number() OVER (ORDER BY round(avg(score), 6) DESC, c) AS r FROM (SELECT c_nationkey AS c, avg(c_acctbal) AS score FROM customer GROUP BY c_nationkey UNION ALL SELECT s_nationkey, avg(s_acctbal) FROM supplier GROUP BY s_nationkey) x GROUP BY c) y WHERE r = 1")
both("k06_stratified_sample", "SELECT y, event_id FROM (SELECT y, event_id, row_number() OVER (PARTITION BY y ORDER BY $sha(concat('7|', CAST(event_id AS STRING)))$) AS r FROM post) x WHERE r <= 100", ("post",))
both("k07_seed_draw", "SELECT run, node FROM (SELECT run, node, row_number() OVER (PARTITION BY run ORDER BY $sha(concat(CAST(run AS STRING), '|', CAST(node AS STRING)))$) AS r FROM nodes CROSS JOIN (SELECT $numbers(1; 5)$ AS run) q) x WHERE r <= 25", ("nodes",))
both("k08_fan_out", "SELECT week, dst, src FROM (SELECT week, dst, src, row_number() OVER (PARTITION BY week, dst ORDER BY $sha(concat_ws('|', '42', CAST(week AS STRING), CAST(dst AS STRING), CAST(src AS STRING)))$) AS r FROM weekly WHERE src <> dst) x WHERE r <= 16", ("weekly",))

# sets
both("u01_endpoints", "SELECT src AS node FROM pairs UNION SELECT dst FROM pairs", ("pairs",))
both("u02_intersection", "SELECT src AS node FROM pairs INTERSECT SELECT dst FROM pairs", ("pairs",))
both("u03_difference", "SELECT c_custkey AS node FROM customer EXCEPT SELECT src FROM pairs", ("pairs",))
both("u04_bag_union", "SELECT 'a' AS part, n_nationkey AS k FROM nation UNION ALL SELECT 'b', r_regionkey FROM region")
both("u05_distinct", "SELECT DISTINCT u, kind FROM post", ("post",))
both("u06_layer_jaccard", "WITH l AS (SELECT DISTINCT kind, src, dst FROM typed), s AS (SELECT kind, count(*) AS n FROM l GROUP BY kind), i AS (SELECT a.kind AS ka, b.kind AS kb, count(*) AS n FROM l a JOIN l b ON a.src = b.src AND a.dst = b.dst AND a.kind < b.kind GROUP BY a.kind, b.kind) SELECT ka, kb, i.n AS common, x.n + y.n - i.n AS united, round(i.n / CAST(x.n + y.n - i.n AS DOUBLE), 9) AS jaccard FROM i JOIN s x ON ka = x.kind JOIN s y ON kb = y.kind", ("typed",))
both("u07_set_equality", "SELECT count(*) AS violations FROM ((SELECT src, dst FROM pairs EXCEPT SELECT src, dst FROM weekly) UNION ALL (SELECT src, dst FROM weekly EXCEPT SELECT src, dst FROM pairs)) x", ("pairs", "weekly"))
both("u08_layer_combinations", "SELECT a.kind AS layer_a, b.kind AS layer_b FROM (SELECT DISTINCT kind FROM ix) a JOIN (SELECT DISTINCT kind FROM ix) b ON a.kind < b.kind", ("ix",))

# scalar functions
_TEXT = "(SELECT o_orderkey AS id, concat(CASE o_orderkey % 4 WHEN 0 THEN concat('RT @c', CAST(o_custkey AS STRING), ': hi ') WHEN 1 THEN concat(' @Mix_', CAST(o_custkey AS STRING), ' ') ELSE 'hello ' END, '@s', CAST(o_orderkey % 97 AS STRING), ' x@mail.test @c', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN ' @toolonghandle123456' ELSE '' END) AS text FROM orders) t"
both("c01_normalise_all_at", "SELECT c_custkey, lower(regexp_replace(trim(concat('  @@', c_name, ' ')), '^@+', '')) AS k FROM customer")
both("c02_normalise_one_at", "SELECT c_custkey, lower(regexp_replace(trim(concat('  @@', c_name, ' ')), '^@', '')) AS k FROM customer")
both("c05_leading_handle", f"SELECT id, lower(regexp_extract(concat(text, ' '), '^[ ]*@([A-Za-z0-9_]{{1,15}})[^A-Za-z0-9_]', 1)) AS handle FROM {_TEXT}")
both("c07_prefix_tests", "SELECT event_id, substr(event_type, 1, 1) = 'v' AS starts_v, trim(props) <> '' AS filled FROM events")
both("c08_concat", "SELECT event_id, concat_ws('|', event_type, CAST(user_id AS STRING)) AS k FROM events")
both("c09_replace", "SELECT c_custkey, replace(c_name, '#', '-') AS name, substr(c_name, 1, 4) AS head FROM customer")
both("d01_timestamps", "SELECT event_id, $epoch(ts)$ AS seconds, $ts(concat('2024-01-', CAST(10 + event_id % 40 AS STRING), ' 00:00:00'))$ IS NULL AS bad FROM events")
both("d02_calendar_parts", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, CAST(extract(day FROM o_orderdate) AS INT) AS d FROM orders")
both("d03_month_period", "SELECT o_orderkey, $ym(o_orderdate)$ AS period FROM orders")
both("d04_monday_week", "SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events")
both("d05_week_ending_monday", "SELECT event_id, $addweek(CAST(date_trunc('week', ts - INTERVAL '1' DAY) AS DATE))$ AS week_end FROM events")
both("d06_spine", "WITH r AS (SELECT CAST(date_trunc('month', min(m)) AS DATE) AS lo, CAST(max(m) AS DATE) AS hi FROM lab), s AS (SELECT $months(lo; hi)$ AS m FROM r), c AS (SELECT m, count(*) AS n FROM lab WHERE k1 > 5 GROUP BY m) SELECT s.m, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON s.m = c.m", ("lab",))
both("d07_recency", "SELECT l_orderkey, l_linenumber, $days(l_shipdate; o_orderdate)$ / 7.0E0 AS weeks FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
both("d09_partial_weeks", "WITH r AS (SELECT min(week) AS lo, max(week) AS hi FROM post) SELECT week, count(*) AS n, week = max(lo) OR week = max(hi) AS partial FROM post CROSS JOIN r GROUP BY week", ("post",))
both("m01_logs", "SELECT event_id, round(ln(1 + value), 9) AS l, round(sqrt(value), 9) AS s, round(exp(-value / 10), 9) AS e, round(power(value, 2), 4) AS p FROM events")
both("m02_clip", "SELECT event_id, least(greatest(value, 2.0E0), 20.0E0) AS clipped FROM events")
both("m05_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 10))), 9) AS s, greatest(value - 10, 0.0E0) AS relu, round(CASE WHEN value > 10 THEN value - 10 ELSE exp(value - 10) - 1 END, 9) AS elu FROM events")
both("m06_sha256", "SELECT event_id, $sha(props)$ AS h FROM events")
both("m09_sign_bucket", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'positive' WHEN c_acctbal < 0 THEN 'negative' ELSE 'neutral' END AS exact, CASE WHEN c_acctbal > 1e-12 THEN 1 WHEN c_acctbal < -1e-12 THEN -1 ELSE 0 END AS band FROM customer")
both("m10_histogram", "WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / nullif((hi - lo) / 30, 0)), 29) AS BIGINT) AS bin, count(*) AS n FROM events CROSS JOIN r GROUP BY 1")
both("m11_fixed_edges", "SELECT CASE WHEN l_discount <= 0.02E0 THEN 0 WHEN l_discount <= 0.05E0 THEN 1 WHEN l_discount <= 0.08E0 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
both("m13_log_bins", "SELECT CAST(floor(ln(value) / ln(2.0E0)) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value > 0 GROUP BY 1")
both("r05_null_handling", "SELECT event_id, coalesce(nullif(value, 0), -1.0E0) AS v, round(value / nullif(user_id % 3, 0), 6) AS ratio FROM events")
both("r06_coercion", "SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")


@query("w06_average_rank", duck("SELECT c_custkey, CAST(rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0E0 AS DOUBLE) AS r FROM (SELECT c_custkey, floor(c_acctbal / 100) AS b FROM customer) x"))
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("b"))
    return stats.average_rank(c, "b").select("c_custkey", F.col("rank_b").alias("r"))


@query("w07_percentile_rank", duck("SELECT c_custkey, round((rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0E0) / count(*) OVER (), 9) AS pct FROM (SELECT c_custkey, floor(c_acctbal / 100) AS b FROM customer) x"))
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("b"))
    return stats.average_rank(c, "b").crossJoin(F.broadcast(c.agg(F.count("*").alias("n")))).select("c_custkey", F.round(F.col("rank_b") / F.col("n"), 9).alias("pct"))  # one row


@query("a25_gini", duck("WITH s AS (SELECT src, CAST(sum(w) AS DOUBLE) AS x FROM pairs GROUP BY src), r AS (SELECT x, row_number() OVER (ORDER BY x, src) AS i, count(*) OVER () AS n, sum(x) OVER () AS total FROM s) SELECT round(2 * sum(i * x) / (max(n) * max(total)) - (max(n) + 1) / CAST(max(n) AS DOUBLE), 9) AS gini FROM r", ("pairs",)))
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = view(spark, sf_dir, "pairs").groupBy("src").agg(F.sum("w").alias("x"))
    return stats.gini(strength, "x").select(F.round("gini", 9).alias("gini"))


@query("w11_lorenz", duck("WITH s AS (SELECT src, CAST(sum(w) AS DOUBLE) AS x FROM pairs GROUP BY src), r AS (SELECT row_number() OVER (ORDER BY x, src) AS i, count(*) OVER () AS n, sum(x) OVER (ORDER BY x, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(x) OVER () AS share FROM s) SELECT round(i / CAST(n AS DOUBLE), 9) AS node_fraction, round(share, 9) AS strength_fraction FROM r", ("pairs",)))
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = view(spark, sf_dir, "pairs").groupBy("src").agg(F.sum("w").alias("x"))
    whole = F.broadcast(strength.agg(F.count("*").alias("n"), F.sum("x").alias("total")))  # one row
    up = running(strength, [F.col("x"), F.col("src")], {"i": F.lit(1), "upto": F.col("x")}).crossJoin(whole)
    return up.select(F.round(F.col("i") / F.col("n"), 9).alias("node_fraction"), F.round(F.col("upto") / F.col("total"), 9).alias("strength_fraction"))


@query("w12_ccdf", duck("WITH d AS (SELECT src, count(*) AS k FROM pairs GROUP BY src), v AS (SELECT k, count(*) AS n FROM d GROUP BY k) SELECT k, round(sum(n) OVER (ORDER BY k DESC) / CAST(sum(n) OVER () AS DOUBLE), 9) AS p FROM v", ("pairs",)))
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = view(spark, sf_dir, "pairs").groupBy("src").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    down = running(sizes, [F.desc("k")], {"least": F.col("n")}).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total"))))  # one row
    return down.select("k", F.round(F.col("least") / F.col("total"), 9).alias("p"))


@query("k09_sampled_grid", duck("SELECT i, u FROM (SELECT row_number() OVER (ORDER BY u) - 1 AS i, u FROM (SELECT DISTINCT u FROM post) a) b WHERE i % 5 = 0", ("post",)))
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "post").select("u").distinct()
    return running(users, [F.col("u")], {"i": F.lit(1)}).select((F.col("i") - 1).cast("int").alias("i"), "u").where("i % 5 = 0")
