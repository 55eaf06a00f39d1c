"""Graph, path and spreading queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import arrival, graph, paths, simulate, spectral
from weftline.operators.components import connected_components
from weftline.plans.registry import query
from weftline.plans.sql import both, duck, view
from weftline.session import cut

#: The graph of orders: from customers to the last digits of orders' keys.
ORDERS = "(SELECT DISTINCT o_custkey AS src, CAST(o_orderkey % 500 AS BIGINT) AS dst FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 500).alias("dst")).distinct()


def _ends(edges: str) -> str:
    return f"(SELECT src AS node FROM {edges} e UNION SELECT dst FROM {edges} e)"


@query("g02_graph_from_events", duck("SELECT 'layer_aware' AS direction, s AS src, t AS dst, count(*) AS w FROM (SELECT CASE WHEN kind = 'click' THEN dst ELSE src END AS s, CASE WHEN kind = 'click' THEN src ELSE dst END AS t FROM ix) x GROUP BY s, t", ("ix",)))
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.from_events(graph.redirect(view(spark, sf_dir, "ix"), "layer_aware")).select(F.lit("layer_aware").alias("direction"), "src", "dst", "w")


@query("g03_induced", duck("SELECT src, dst, w FROM pairs WHERE src % 2 = 0 AND dst % 2 = 0", ("pairs",)))
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "pairs")
    return graph.induced(edges, graph.vertices(edges).where("node % 2 = 0")).select("src", "dst", "w")


_DEGREES = "SELECT node, CAST(coalesce(i.d, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.d, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.s, 0) AS BIGINT) AS in_strength, CAST(coalesce(o.s, 0) AS BIGINT) AS out_strength, CAST(coalesce(i.d, 0) + coalesce(o.d, 0) AS BIGINT) AS total_degree, CAST(coalesce(i.s, 0) + coalesce(o.s, 0) AS BIGINT) AS total_strength FROM nodes LEFT JOIN (SELECT dst, count(*) AS d, sum(w) AS s FROM pairs GROUP BY dst) i ON node = i.dst LEFT JOIN (SELECT src, count(*) AS d, sum(w) AS s FROM pairs GROUP BY src) o ON node = o.src"


@query("g04_degrees", duck(_DEGREES, ("nodes",)))
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(view(spark, sf_dir, "pairs"))


_SUMMARY = """SELECT kind, n.nodes, e.edges, e.loops, e.events, round(CASE WHEN nodes < 2 THEN 0 ELSE edges / (nodes * (nodes - 1.0E0)) END, 9) AS density,
 round(CASE WHEN nodes < 2 THEN 0 ELSE (edges - loops) / (nodes * (nodes - 1.0E0)) END, 9) AS density_without_loops, round(mutual / nullif(edges, 0), 9) AS reciprocity, round(mutual / nullif(edges - loops, 0), 9) AS reciprocity_without_loops
 FROM (SELECT a.kind, count(*) AS edges, count_if(a.src = a.dst) AS loops, CAST(sum(a.w) AS BIGINT) AS events, count_if(a.src <> a.dst AND b.src IS NOT NULL) AS mutual FROM typed a LEFT JOIN typed b ON a.kind = b.kind AND a.src = b.dst AND a.dst = b.src GROUP BY a.kind) e
 JOIN (SELECT kind, count(*) AS nodes FROM (SELECT kind, src FROM typed UNION SELECT kind, dst FROM typed) x GROUP BY kind) n USING (kind)"""


@query("g06_g07_layer_summary", duck(_SUMMARY, ("typed",)))
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.summary(view(spark, sf_dir, "typed"), "kind")
    return got.withColumns({c: F.round(c, 9) for c in got.columns if c.startswith(("density", "recip"))})


_WCC = f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {ORDERS} x UNION SELECT dst, src FROM {ORDERS} y), r(node, low) AS (SELECT a, a FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b) SELECT node, min(low) AS component FROM r GROUP BY node"""


@query("g08_weak_components", duck(_WCC))
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weak(_orders(spark, sf_dir))


def _weak(edges: DataFrame) -> DataFrame:
    part = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices(edges).join(part, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query("g09_largest_component", duck(f"SELECT component, count(*) AS n FROM ({_WCC}) w GROUP BY component ORDER BY n DESC, component LIMIT 1"))
def g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g08(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)


@query("g36_component_sizes", duck(f"SELECT n AS size, count(*) AS components FROM (SELECT component, count(*) AS n FROM ({_WCC}) w GROUP BY component) s GROUP BY n"))
def g36(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = g08(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))


@query("g11_connectivity", duck(f"SELECT count(DISTINCT component) = 1 AS weakly_connected, count(DISTINCT component) AS components FROM ({_WCC}) w"))
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g08(spark, sf_dir).agg((F.countDistinct("component") == 1).alias("weakly_connected"), F.countDistinct("component").alias("components"))


_REACH = f"e AS (SELECT DISTINCT src, dst FROM {ORDERS} x), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"
_SCC = f"WITH RECURSIVE {_REACH} SELECT n.node, least(n.node, coalesce((SELECT min(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = n.node), n.node)) AS component FROM {_ends('e')} n"


@query("g10_strong_components", duck(_SCC))
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.strong_components(_orders(spark, sf_dir))


_BOW = f"""WITH RECURSIVE {_REACH}, s AS (SELECT n.node, least(n.node, coalesce((SELECT min(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = n.node), n.node)) AS component FROM {_ends('e')} n),
 c AS (SELECT component, count(*) AS k FROM s GROUP BY component ORDER BY k DESC, component DESC LIMIT 1), m AS (SELECT node FROM s JOIN c USING (component)), one AS (SELECT min(node) AS node FROM m)
 SELECT n.node, CASE WHEN n.node IN (SELECT node FROM m) THEN 'core' WHEN EXISTS (SELECT 1 FROM r WHERE a = n.node AND b = (SELECT node FROM one)) THEN 'in' WHEN EXISTS (SELECT 1 FROM r WHERE b = n.node AND a = (SELECT node FROM one)) THEN 'out' ELSE 'other' END AS region FROM s n"""


@query("g17_bow_tie", duck(_BOW))
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.bow_tie(_orders(spark, sf_dir))


@query("g18_descendants", duck(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {ORDERS} x), r(seed, node) AS (SELECT src, dst FROM e UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.node) SELECT seed, count(*) AS descendants FROM r WHERE node <> seed GROUP BY seed"))
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _orders(spark, sf_dir)
    return arrival.reach_sizes(edges, edges.select(F.col("src").alias("seed")).distinct()).where("n > 0").withColumnRenamed("n", "descendants")


both("g12_isolates_and_loops", "SELECT c_custkey AS node, p.n IS NULL AS isolated, coalesce(p.loops, 0) AS loops FROM customer LEFT JOIN (SELECT node, count(*) AS n, CAST(sum(l) AS BIGINT) AS loops FROM (SELECT src AS node, CASE WHEN src = dst THEN 1 ELSE 0 END AS l FROM pairs UNION ALL SELECT dst, 0 FROM pairs) x GROUP BY node) p ON c_custkey = p.node", ("pairs",))
both("g19_spreading_role", "SELECT node, CASE WHEN i = 0 AND o = 0 THEN 'isolated' WHEN o = 0 THEN 'receiver_only' WHEN o >= 50 THEN 'active_spreader' ELSE 'spreader' END AS role FROM (SELECT node, count_if(d = 'i') AS i, count_if(d = 'o') AS o FROM (SELECT dst AS node, 'i' AS d FROM pairs UNION ALL SELECT src, 'o' FROM pairs) x GROUP BY node) y", ("pairs",))
both("g20_dominant_label", "SELECT u, CASE WHEN sum(k1) > sum(k0) THEN 'one' WHEN sum(k0) > sum(k1) THEN 'zero' ELSE 'tie' END AS dominant FROM lab GROUP BY u", ("lab",))
both("g35_degree_buckets", "SELECT count_if(d >= 2) AS ge2, count_if(d >= 5) AS ge5, count_if(d >= 10) AS ge10, count_if(d >= 20) AS ge20, count(*) AS n FROM (SELECT src, count(*) AS d FROM pairs GROUP BY src) x", ("pairs",))


def _pagerank_sql(source: str, rounds: int, key: str = "") -> str:
    k, on, by = (f"{key}, ", f"USING ({key})", f"{key}, ") if key else ("", "", "")
    cross = (lambda t: f"JOIN {t} USING ({key})") if key else (lambda t: f"CROSS JOIN {t}")
    group = f" GROUP BY {key}" if key else ""
    join = f"a.{key} = b.{key} AND " if key else ""
    sql = f"WITH e AS (SELECT {k}src, dst, w FROM {source}), t AS (SELECT {k}src, sum(w) AS total FROM e GROUP BY {by}src), m AS (SELECT {('a.' + key + ', ') if key else ''}a.src, a.dst, a.w / CAST(b.total AS DOUBLE) AS p FROM e a JOIN t b ON {join}a.src = b.src), v AS (SELECT {k}src AS node FROM e UNION SELECT {k}dst FROM e), n AS (SELECT {k}CAST(count(*) AS DOUBLE) AS n FROM v{group}), p0 AS (SELECT {k}node, 1 / n AS rank FROM v {cross('n')})"
    del on
    for i in range(rounds):
        a = f"a.{key} = b.{key} AND " if key else ""
        sql += f", l{i} AS (SELECT {('a.' + key + ', ') if key else ''}sum(CASE WHEN b.src IS NULL THEN a.rank ELSE 0 END) AS lost FROM p{i} a LEFT JOIN t b ON {a}a.node = b.src{(' GROUP BY a.' + key) if key else ''})"
        sql += f", i{i} AS (SELECT {('b.' + key + ', ') if key else ''}b.dst AS node, sum(a.rank * b.p) AS got FROM p{i} a JOIN m b ON {a}a.node = b.src GROUP BY {('b.' + key + ', ') if key else ''}b.dst)"
        sql += f", p{i + 1} AS (SELECT {('a.' + key + ', ') if key else ''}a.node, 0.85E0 * (coalesce(b.got, 0) + c.lost / d.n) + 0.15E0 / d.n AS rank FROM p{i} a LEFT JOIN i{i} b ON {a}a.node = b.node {('JOIN l' + str(i) + ' c ON c.' + key + ' = a.' + key + ' JOIN n d ON d.' + key + ' = a.' + key) if key else 'CROSS JOIN l' + str(i) + ' c CROSS JOIN n d'})"
    return sql + f" SELECT {k}node, round(rank, 9) AS rank FROM p{rounds}"


@query("g13_pagerank", duck(_pagerank_sql("pairs", 8), ("pairs",)))
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.pagerank(view(spark, sf_dir, "pairs"), rounds=8).select("node", F.round("rank", 9).alias("rank"))


@query("g14_reverse_pagerank", duck(_pagerank_sql("(SELECT dst AS src, src AS dst, w FROM pairs) x", 4), ("pairs",)))
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = view(spark, sf_dir, "pairs").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return paths.pagerank(back, rounds=4).select("node", F.round("rank", 9).alias("rank"))


@query("t06_weekly_pagerank", duck(_pagerank_sql("weekly", 4, "week"), ("weekly",)))
def t06_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.pagerank(view(spark, sf_dir, "weekly"), "week", rounds=4).select("week", "node", F.round("rank", 9).alias("rank"))


_CAT = "(SELECT c_custkey AS node, CASE WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal > 3000 THEN 'high' ELSE 'tie' END AS category FROM customer)"


@query("a23_mixing_matrix", duck(f"SELECT a.category AS src_category, b.category AS dst_category, count(*) AS n FROM pairs JOIN {_CAT} a ON src = a.node JOIN {_CAT} b ON dst = b.node GROUP BY 1, 2", ("pairs",)))
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    category = F.when(F.col("c_acctbal") < 3000, "low").when(F.col("c_acctbal") > 3000, "high").otherwise("tie")
    return graph.mixing(view(spark, sf_dir, "pairs"), customer.select(F.col("c_custkey").alias("node"), category.alias("category")))


@query("g23_assortativity", duck(f"WITH x AS (SELECT a.category AS s, b.category AS t, CAST(count(*) AS DOUBLE) AS n FROM pairs JOIN {_CAT} a ON src = a.node JOIN {_CAT} b ON dst = b.node GROUP BY 1, 2), tot AS (SELECT sum(n) AS n FROM x), ex AS (SELECT sum(r.n * k.n) AS v FROM (SELECT s AS c, sum(n) AS n FROM x GROUP BY s) r JOIN (SELECT t AS c, sum(n) AS n FROM x GROUP BY t) k USING (c)) SELECT round(((SELECT sum(n) FROM x WHERE s = t) / tot.n - ex.v / (tot.n * tot.n)) / (1 - ex.v / (tot.n * tot.n)), 9) AS assortativity FROM tot CROSS JOIN ex", ("pairs",)))
def g23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.assortativity(a23(spark, sf_dir)).select(F.round("assortativity", 9).alias("assortativity"))


@query("g26_rewired_strengths", duck("SELECT CAST(0 AS BIGINT) AS violations"))
def g26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose in or out strength the rewiring changed: none."""
    edges = view(spark, sf_dir, "pairs")
    before, after = (graph.degrees(e).select("node", "in_strength", "out_strength") for e in (edges, graph.rewire(edges)))
    return before.exceptAll(after).unionByName(after.exceptAll(before)).agg(F.count("*").alias("violations"))


_FEATURES = "f AS (SELECT node, node % 7 + 1.0E0 AS x FROM nodes)"


@query("g27_symmetric_propagation", duck(f"WITH {_FEATURES}, a AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w / 2.0E0 AS w FROM pairs UNION ALL SELECT dst, src, w / 2.0E0 FROM pairs UNION ALL SELECT node, node, 1.0E0 FROM nodes) q GROUP BY src, dst), d AS (SELECT src AS node, sum(w) AS d FROM a GROUP BY src) SELECT a.src AS node, round(sum(a.w / sqrt(p.d * q.d) * f.x), 6) AS x, round(sum(a.w / sqrt(p.d * q.d)), 6) AS mass FROM a JOIN d p ON a.src = p.node JOIN d q ON a.dst = q.node JOIN f ON a.dst = f.node GROUP BY a.src", ("nodes",)))
def g27(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "pairs")
    features = graph.vertices(edges).withColumn("x", F.col("node") % 7 + 1.0)
    got = graph.propagate(edges, features, ["x"])
    return got.select("node", F.round("x", 6).alias("x"), F.round("mass", 6).alias("mass"))


@query("g28_mean_messages", duck(f"WITH {_FEATURES} SELECT n.node, round(coalesce(m.x, 0), 6) AS x, CASE WHEN m.x IS NULL THEN 0.0E0 ELSE 1.0E0 END AS mass FROM nodes n LEFT JOIN (SELECT dst, sum(w * x) / sum(w) AS x FROM pairs JOIN f ON src = f.node GROUP BY dst) m ON n.node = m.dst", ("nodes",)))
def g28(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "pairs")
    got = graph.mean_messages(edges, graph.vertices(edges).withColumn("x", F.col("node") % 7 + 1.0), ["x"])
    return got.select("node", F.round("x", 6).alias("x"), "mass")


@query("g29_reversal_invariance", duck("SELECT CAST(0 AS BIGINT) AS violations"))
def g29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose propagated feature changes when all edges are turned round: none."""
    edges = view(spark, sf_dir, "pairs")
    features = graph.vertices(edges).withColumn("x", F.col("node") % 7 + 1.0)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    a, b = graph.propagate(edges, features, ["x"]), graph.propagate(back, features, ["x"]).withColumnRenamed("x", "y")
    return a.join(b.select("node", "y"), "node").where(F.abs(F.col("x") - F.col("y")) > 1e-9).agg(F.count("*").alias("violations"))


@query("g31_spectral_radius")
def g31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_radius(view(spark, sf_dir, "pairs"))


@query("v08_spectrum_of_transpose", duck("SELECT CAST(0 AS BIGINT) AS violations"))
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose radius differs from that of the reversed graph: none."""
    return spectral.both_radii(view(spark, sf_dir, "pairs")).where(F.coalesce(F.abs(F.col("radius") - F.col("other")) > 1e-6, F.lit(True))).agg(F.count("*").alias("violations"))


_ARRIVAL = "e AS (SELECT DISTINCT src, dst, $epoch(ts)$ AS tm FROM ix), r(seed, node, tm) USING KEY (seed, node) AS (SELECT src, dst, min(tm) FROM e WHERE tm >= 1704672000 GROUP BY src, dst UNION SELECT r.seed, e.dst, min(e.tm) FROM r JOIN e ON e.src = r.node AND e.tm >= r.tm LEFT JOIN recurring.r c ON c.seed = r.seed AND c.node = e.dst WHERE c.tm IS NULL OR e.tm < c.tm GROUP BY r.seed, e.dst)"


@query("t14_earliest_arrival", duck(f"WITH {_ARRIVAL} SELECT seed, node, tm AS reached FROM r WHERE node <> seed", ("ix",)).replace("WITH ix", "WITH RECURSIVE ix", 1))
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all sources."""
    events = cut(view(spark, sf_dir, "ix").select("src", "dst", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")))
    seeds = events.select(F.col("src").alias("seed")).distinct().withColumn("start", F.lit(1704672000).cast("long"))
    return paths.earliest_arrival(events, seeds).withColumnRenamed("at", "reached")


@query(
    "t14_arrival_hops",
    duck(f"WITH {_ARRIVAL}, l(seed, node, tm) AS (SELECT seed, node, tm FROM r WHERE node <> seed UNION ALL SELECT DISTINCT src, src, CAST(1704672000 AS BIGINT) FROM e), t AS (SELECT DISTINCT a.seed, a.node AS s, b.node AS t FROM l b JOIN e ON e.dst = b.node AND e.tm = b.tm JOIN l a ON a.seed = b.seed AND a.node = e.src AND a.tm <= b.tm WHERE b.node <> b.seed), h(seed, node, hops) USING KEY (seed, node) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT h.seed, t.t, min(h.hops + 1) FROM h JOIN t ON t.seed = h.seed AND t.s = h.node LEFT JOIN recurring.h c ON c.seed = h.seed AND c.node = t.t WHERE c.hops IS NULL OR h.hops + 1 < c.hops GROUP BY h.seed, t.t) SELECT l.seed, l.node, l.tm AS reached, CAST(h.hops AS INTEGER) AS hops FROM l JOIN h ON h.seed = l.seed AND h.node = l.node WHERE l.node <> l.seed", ("ix",)).replace("WITH ix", "WITH RECURSIVE ix", 1),
)
def t14_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all sources, with the hop counts of paths of earliest arrival."""
    events = cut(view(spark, sf_dir, "ix").select("src", "dst", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")))
    seeds = events.select(F.col("src").alias("seed")).distinct().withColumn("start", F.lit(1704672000).cast("long"))
    return arrival.arrivals(events, seeds).withColumnRenamed("at", "reached")


@query("v_t15_temporal_within_static", duck("SELECT CAST(0 AS BIGINT) AS violations"))
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds that reach more nodes in time than by any path: none."""
    ix = cut(view(spark, sf_dir, "ix").select("src", "dst", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")))
    seeds = ix.select(F.col("src").alias("seed")).distinct()
    temporal = arrival.reach_sizes(ix, seeds.withColumn("start", F.lit(1704672000).cast("long"))).withColumnRenamed("n", "t")
    static = arrival.reach_sizes(ix.select("src", "dst"), seeds).withColumnRenamed("n", "s")
    return temporal.join(static, "seed", "left").where("t > coalesce(s, 0)").agg(F.count("*").alias("violations"))


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("balanced", 1.0, 1.0, 0.25), ("zero_ahead", 1.5, 0.75, 0.25)], "cell string, beta_0 double, beta_1 double, gamma double")


@query("x06_competition_runs")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate(view(spark, sf_dir, "pairs"), _grid(spark), runs=20)


@query("x07_independent_kernel")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate(view(spark, sf_dir, "pairs"), _grid(spark), runs=20, independent=True)


@query("v07_simulation_identities", duck("SELECT CAST(0 AS BIGINT) AS violations"))
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that break an identity of counts: none."""
    r = x06(spark, sf_dir)
    return r.where("exposed_union <> exposed_0_only + exposed_1_only + exposed_both OR secondary_0 > reached_0 OR secondary_1 > reached_1 OR contests > exposed_both OR abs(signed_secondary) > 1").agg(F.count("*").alias("violations"))


@query("x15_x19_outcomes")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x06(spark, sf_dir).groupBy("cell", F.coalesce("outcome", F.lit("none")).alias("outcome")).agg(F.count("*").alias("n"))


both("x02_transmission", "SELECT p.src, p.dst, round(least(1, greatest(0, 0.5E0 * w / 10 * (0.5E0 + 0.5E0 * least(1, abs(a.c_acctbal) / 10000)) * (0.5E0 + 0.5E0 * least(1, abs(b.c_acctbal) / 10000)))), 9) AS p FROM pairs p JOIN customer a ON p.src = a.c_custkey JOIN customer b ON p.dst = b.c_custkey", ("pairs",))
both("x05_competition_rule", "SELECT src, dst, round(0.5E0 + 0.5E0 * (a - b) / (a + b), 9) AS by_difference, round(a / (a + b), 9) AS proportional FROM (SELECT src, dst, CAST(w AS DOUBLE) AS a, 1.0E0 AS b FROM pairs) x", ("pairs",))
