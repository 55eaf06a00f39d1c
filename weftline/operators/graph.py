"""Graphs as edge DataFrames (src, dst, w) and vertex DataFrames (node); isolates are kept explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.scan import running


def redirect(events: DataFrame, direction: str, reversed_kind: str = "click") -> DataFrame:
    """Swap endpoints: 'recorded', 'reversed', or 'layer_aware' (only events of one kind are turned round)."""
    turn = {"recorded": F.lit(False), "reversed": F.lit(True), "layer_aware": F.col("kind") == reversed_kind}[direction]
    return events.withColumns({"src": F.when(turn, F.col("dst")).otherwise(F.col("src")), "dst": F.when(turn, F.col("src")).otherwise(F.col("dst"))})


def from_events(events: DataFrame, *keys: str) -> DataFrame:
    """Distinct pairs with their number of events, per key columns."""
    return events.where("src is not null and dst is not null").groupBy(*keys, "src", "dst").agg(F.count("*").alias("w"))


def vertices(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.select(*keys, F.col("src").alias("node")).unionByName(edges.select(*keys, F.col("dst").alias("node"))).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def degrees(edges: DataFrame, nodes: DataFrame | None = None, *keys: str) -> DataFrame:
    """In, out and total degree and strength of each vertex, in one pass; a loop counts on both sides."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), one.alias("o"), F.col("w").alias("ow"), zero.alias("i"), zero.cast("long").alias("iw")), F.struct(F.col("dst").alias("node"), zero.alias("o"), zero.alias("ow"), one.alias("i"), F.col("w").alias("iw"))))
    got = edges.select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.node").alias("node")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum("e.iw").alias("in_strength"), F.sum("e.ow").alias("out_strength"))
    if nodes is not None:
        got = nodes.join(got, [*keys, "node"], "left").na.fill(0)
    return got.withColumns({"total_degree": F.col("in_degree") + F.col("out_degree"), "total_strength": F.col("in_strength") + F.col("out_strength")})


def density(m: Column, n: Column) -> Column:
    """All edges, loops too, over n(n-1)."""
    return F.when(n < 2, F.lit(0.0)).otherwise(m / (n * (n - 1)))


def summary(edges: DataFrame, *keys: str) -> DataFrame:
    """Nodes, edges, loops, both densities and both reciprocities, per key."""
    back = edges.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(1).alias("mutual"))
    marked = edges.join(back, [*keys, "src", "dst"], "left")
    loop = F.col("src") == F.col("dst")
    sums = marked.groupBy(*keys).agg(F.count("*").alias("edges"), F.count_if(loop).alias("loops"), F.sum("w").alias("events"), F.count_if(F.col("mutual").isNotNull() & ~loop).alias("mutual"))
    n = vertices(edges, *keys).groupBy(*keys).agg(F.count("*").alias("nodes"))
    got = sums.join(n, list(keys)) if keys else sums.crossJoin(n)
    plain = F.col("edges") - F.col("loops")
    return got.select(
        *keys,
        "nodes",
        "edges",
        "loops",
        "events",
        density(F.col("edges"), F.col("nodes")).alias("density"),
        density(plain, F.col("nodes")).alias("density_without_loops"),
        # each mutual pair is two edges; loops count in the first form's denominator only
        F.try_divide(F.col("mutual"), F.col("edges")).alias("reciprocity"),
        F.try_divide(F.col("mutual"), plain).alias("reciprocity_without_loops"),
    )


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of intersection and union of two edge sets, and Jaccard."""
    both = a.select("src", "dst", F.lit(1).alias("a")).join(b.select("src", "dst", F.lit(1).alias("b")), ["src", "dst"], "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count("*").alias("united")).withColumn("jaccard", F.try_divide("common", "united"))


def mixing(edges: DataFrame, category: DataFrame) -> DataFrame:
    """Edge counts by the category of source and target, from (node, category)."""
    at = lambda c: category.select(F.col("node").alias(c), F.col("category").alias(f"{c}_category"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").groupBy("src_category", "dst_category").agg(F.count("*").alias("n"))


def assortativity(matrix: DataFrame) -> DataFrame:
    """Nominal assortativity (tr e - sum ab) / (1 - sum ab) of a mixing matrix."""
    rows = matrix.groupBy(F.col("src_category").alias("c")).agg(F.sum("n").alias("r"))
    columns = matrix.groupBy(F.col("dst_category").alias("c")).agg(F.sum("n").alias("k"))
    total = matrix.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("src_category") == F.col("dst_category"), F.col("n")).otherwise(0)).alias("diagonal"))
    expected = rows.join(columns, "c").agg(F.sum(F.col("r").cast("double") * F.col("k")).alias("rk"))
    e, t = F.col("rk") / (F.col("total") * F.col("total")), F.col("diagonal") / F.col("total")
    return total.crossJoin(expected).select(F.try_divide(t - e, 1 - e).alias("assortativity"))


def rewire(edges: DataFrame, seed: int = 42) -> DataFrame:
    """Permute the targets of events: weights become events, targets are dealt in hash order, pairs are counted again.

    Places are numbered in range partitions, so there is no global window; in and out strengths stay as they are.
    """
    events = edges.where("w > 0").select("src", "dst", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w").cast("long"))).alias("k"))
    a = numbered(events.select("src", "dst", "k"), ["src", "dst", "k"]).select("place", "src")
    key = F.xxhash64(F.lit(seed), "src", "dst", "k")
    b = numbered(events.select("dst", key.alias("h"), "src", "k"), ["h", "src", "dst", "k"]).select("place", "dst")
    return a.join(b, "place").groupBy("src", "dst").agg(F.count("*").alias("w"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds place, 0 to n - 1 in the order given: ranges are sorted apart and shifted by the sizes of those before."""
    from pyspark.sql import Window

    from weftline.session import cut

    parted = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(sizes.select("_part", before.alias("_before")))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parted.withColumn("_i", within).join(shift, "_part").withColumn("place", F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")


def propagate(edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Symmetric-normalised propagation D^-1/2 ((A + A^T)/2 + I) D^-1/2 X, and the row mass, for features (node, ...)."""
    half = edges.select("src", "dst", (F.col("w") / 2).alias("_w"))
    own = features.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("_w"))
    both = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "_w")).unionByName(own)
    a = both.groupBy("src", "dst").agg(F.sum("_w").alias("_w"))
    d = a.groupBy(F.col("src").alias("node")).agg(F.sum("_w").alias("_d"))
    root = lambda c: d.select(F.col("node").alias(c), (1 / F.sqrt("_d")).alias(f"_r_{c}"))
    scaled = a.join(root("src"), "src").join(root("dst"), "dst").select("src", "dst", (F.col("_w") * F.col("_r_src") * F.col("_r_dst")).alias("_s"))
    x = features.select(F.col("node").alias("dst"), *columns)
    return scaled.join(x, "dst").groupBy(F.col("src").alias("node")).agg(*(F.sum(F.col("_s") * F.col(c)).alias(c) for c in columns), F.sum("_s").alias("mass"))


def mean_messages(edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Weighted mean of in-neighbours' features, and whether there are any; nodes without neighbours get zeros."""
    x = features.select(F.col("node").alias("src"), *columns)
    got = edges.select("src", "dst", F.col("w").alias("_w")).join(x, "src").groupBy(F.col("dst").alias("node")).agg(*((F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in columns))
    return features.select("node").join(got.withColumn("mass", F.lit(1.0)), "node", "left").na.fill(0.0)


def edge_contributions(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """(src, dst, w, contribution): each edge's weight times its target's part in a vector (node, mass)."""
    return edges.join(vector.select(F.col("node").alias("dst"), "mass"), "dst").select("src", "dst", "w", (F.col("w") * F.col("mass")).alias("contribution"))


def scaled_messages(messages: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Messages (node, columns, mass) of features that are scaled: (message - mass * mean) / scale, nodes without mass zeroed.

    fitted is one row of mean_<c> and scale_<c>; a scale of 0 counts as 1.
    """
    both = messages.crossJoin(F.broadcast(fitted))  # one row
    value = lambda c: (F.col(c) - F.col("mass") * F.col(f"mean_{c}")) / F.when(F.col(f"scale_{c}") > 0, F.col(f"scale_{c}")).otherwise(1.0)
    return both.select("node", *(F.when(F.col("mass") > 0, value(c)).otherwise(0.0).alias(c) for c in columns), "mass")


def gini(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, gini) of non-negative values, from counts by value: ranks run over distinct values."""
    counts = values.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    placed = running(counts, [F.col("_v")], {"_last": F.col("_k")}, *keys).withColumn("_places", F.col("_k") * F.col("_last") - F.col("_k") * (F.col("_k") - 1) / 2)
    sums = placed.groupBy(*keys).agg(F.sum(F.col("_v") * F.col("_places")).alias("_a"), F.sum(F.col("_v") * F.col("_k")).alias("_t"), F.sum("_k").alias("_n"))
    return sums.select(*keys, F.try_divide(2 * F.col("_a") - (F.col("_n") + 1) * F.col("_t"), F.col("_n") * F.col("_t")).alias("gini"))


def top_share(values: DataFrame, value: str, share: float, *keys: str) -> DataFrame:
    """(keys, top_share): what the largest ceil(share * n) values, one at least, have of the sum."""
    counts = values.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    top = F.greatest(F.lit(1).cast("long"), F.ceil(share * F.sum("_k"))).alias("_top")
    placed = running(counts, [F.desc("_v")], {"_last": F.col("_k")}, *keys)
    whole = counts.groupBy(*keys).agg(top)
    both = placed.join(whole, list(keys)) if keys else placed.crossJoin(F.broadcast(whole))  # one row
    used = F.greatest(F.lit(0).cast("long"), F.least("_k", F.col("_top") - (F.col("_last") - F.col("_k"))))
    return both.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_v") * used), F.sum(F.col("_v") * F.col("_k"))).alias("top_share"))


def _apart(edges: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """All keys' graphs as one: numbers of nodes, (keys, node, id), and edges (src, dst) between numbers; no number is in two graphs."""
    from weftline.session import cut

    name = F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys), F.col("node").cast("string"))
    nodes = vertices(edges, *keys)
    ids = cut(numbered(nodes.withColumn("_name", name), ["_name"]).select(*keys, "node", F.col("place").alias("id")))
    at = lambda c: ids.select(*keys, F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    own = cut(edges.join(at("src"), [*keys, "src"]).join(at("dst"), [*keys, "dst"]).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    return ids, own


def snapshot_statistics(edges: DataFrame, *keys: str) -> DataFrame:
    """A row for each key: sizes, density and reciprocity without loops, largest weak and strong component, mean degrees and strengths.

    Components of all keys' graphs are found in one run. Reciprocity is null where a graph has loops only.
    """
    from weftline.operators.components import connected_components
    from weftline.operators.paths import strong_components

    ids, own = _apart(edges, *keys)
    found = {"largest_weak": connected_components(own.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "largest_strong": strong_components(own)}
    out = summary(edges, *keys)
    for n, parts in found.items():
        sizes = ids.join(parts.withColumnRenamed("node", "id"), "id", "left").groupBy(*keys, F.coalesce("component", "id").alias("_c")).agg(F.count("*").alias("_k"))
        out = out.join(sizes.groupBy(*keys).agg(F.max("_k").alias(n)), list(keys))
    share = lambda c: F.col(c) / F.col("nodes")  # noqa: E731  every edge has one source and one target, so both means are equal
    means = {f"mean_{side}_{kind}": share(c) for side in ("in", "out") for kind, c in (("degree", "edges"), ("strength", "events"))}
    return out.select(*keys, "nodes", "edges", "events", F.col("density_without_loops").alias("density"), F.col("reciprocity_without_loops").alias("reciprocity"), *found, *(c.alias(n) for n, c in means.items()))


def layer_statistics(edges: DataFrame, *keys: str) -> DataFrame:
    """A row of statistics for each key: sizes, density, reciprocity, weak and strong components and bow tie of each key's graph in
    one run (a node of a key is a node of its own), degrees, strengths and their concentration."""
    from weftline.operators.components import connected_components
    from weftline.operators.paths import bow_tie_by, strong_components
    from weftline.session import cut

    ids, own = _apart(edges, *keys)
    weak = connected_components(own.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    weak = ids.join(weak.withColumnRenamed("node", "id"), "id", "left").groupBy(*keys, F.coalesce("component", "id").alias("c")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("largest_weak"))
    strong = cut(strong_components(own).join(ids.select(*keys, F.col("id").alias("node")), "node"))
    tie = bow_tie_by(own, strong, *keys)
    regions = tie.groupBy(*keys).agg(*(F.count_if(F.col("region") == r).alias(f"bow_tie_{r}") for r in ("core", "in", "out", "other")))
    d = cut(degrees(edges, None, *keys))
    ends = d.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("in_degree", "out_degree", "in_strength", "out_strength") for n, f in (("mean", F.avg), ("max", F.max))))
    out = summary(edges, *keys).join(weak, list(keys)).join(regions, list(keys)).join(ends, list(keys))
    for c in ("in_strength", "out_strength"):
        out = out.join(gini(d, c, *keys).withColumnRenamed("gini", f"gini_{c}"), list(keys))
    out = out.join(top_share(d, "in_strength", 0.01, *keys).withColumnRenamed("top_share", "top_1pct_in_strength"), list(keys))
    return out.withColumn("core_share", F.col("bow_tie_core") / F.col("nodes"))
