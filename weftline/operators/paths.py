"""Iterative graph operators: reachability, components, PageRank, earliest arrival.

Loops cut their lineage each round with a table in the shared folder and carry only what changed. All seeds, weeks or
layers run in one loop, keyed by further columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.arrival import BLOCK, BUCKET, HELD_EDGES, SWEPT, _labels, _numbered, arrivals, contracted
from weftline.session import cut, discard


def reachable(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(seed, node, hops) for all nodes reached from seeds (seed); the seed itself is left out, even on a cycle."""
    e = cut(edges.select("src", F.col("dst").alias("node")).distinct())
    seen = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct())
    front, hops = seen, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = front.select("seed", F.col("node").alias("src")).join(e, "src").select("seed", "node").distinct()
        new = cut(step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new), [seen])
        front = new
    return seen.where("hops > 0")


def earliest_arrival(events: DataFrame, seeds: DataFrame, block: int | None = None, size: int = SWEPT) -> DataFrame:
    """(seed, node, at) of ``arrival.arrivals``, without hop counts."""
    return arrivals(events, seeds, block, size, hops=False).drop("hops")


def pagerank(edges: DataFrame, *keys: str, nodes: DataFrame | None = None, alpha: float = 0.85, rounds: int = 10, tolerance: float | None = None) -> DataFrame:
    """(keys, node, rank): weighted PageRank with uniform teleport and dangling mass, for all keys in one loop.

    Stops after so many rounds, or before if the L1 change is below n * tolerance for every key.
    """
    ks = list(keys)
    totals = edges.groupBy(*ks, "src").agg(F.sum("w").alias("total"))
    moves = cut(edges.join(totals, [*ks, "src"]).select(*ks, "src", "dst", (F.col("w") / F.col("total")).alias("p")))
    every = edges.select(*ks, F.col("src").alias("node")).unionByName(edges.select(*ks, F.col("dst").alias("node"))).distinct() if nodes is None else nodes
    sizes = every.groupBy(*ks).agg(F.count("*").alias("n")) if ks else every.agg(F.count("*").alias("n"))
    on = (lambda a, b: a.join(F.broadcast(b), ks)) if ks else (lambda a, b: a.crossJoin(F.broadcast(b)))  # a row for each key
    out = totals.select(*ks, F.col("src").alias("node"), F.lit(False).alias("dangling"))
    rank = cut(on(every.join(out, [*ks, "node"], "left"), sizes).select(*ks, "node", "n", F.coalesce("dangling", F.lit(True)).alias("dangling"), (1.0 / F.col("n")).alias("rank")))
    for _ in range(rounds):
        lost = rank.groupBy(*ks).agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost")) if ks else rank.agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost"))
        got = rank.select(*ks, F.col("node").alias("src"), "rank").join(moves, [*ks, "src"]).groupBy(*ks, F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("in"))
        new = on(rank.join(got, [*ks, "node"], "left"), lost)
        value = alpha * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - alpha) / F.col("n")
        new = cut(new.select(*ks, "node", "n", "dangling", value.alias("rank"), F.abs(value - F.col("rank")).alias("change")), [rank])
        rank = new
        if tolerance is not None:
            change = new.groupBy(*ks, "n").agg(F.sum("change").alias("c")).where(F.col("c") >= F.col("n") * tolerance)
            if change.isEmpty():
                break
    discard(moves)
    return rank.select(*ks, "node", "rank")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part, root, next) from rows (node, part, side, bits) in the order of nodes: root is the least pivot that a node reaches and is
    reached by, next the part that it is in if there is none."""
    every = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("node", "part", "side", "bits"))))
    out: list[tuple] = []

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.string()))], ["node", "part", "root", "next"])

    for node, rows in groupby(every, key=lambda r: r[0]):
        own, sides = None, [0, 0]
        for _, part, side, bits in rows:
            if side is None:
                own = part
            else:
                sides[side] |= int.from_bytes(bits, "little")
        common = sides[0] & sides[1]
        digest = hashlib.sha256(repr((own, *sides)).encode()).hexdigest()[:32]
        out.append((node, own, (common & -common).bit_length() - 1 if common else None, digest))
        if len(out) >= 20_000:
            yield passed()
            out = []
    if out:
        yield passed()


def strong_components(edges: DataFrame, pivots: int = BLOCK, size: int = BUCKET) -> DataFrame:
    """(node, component): least member of each strong component, singletons too.

    Forward and backward search from many pivots at once. Nodes that the same pivots reach, and that reach the same pivots, are one part: a
    strong component never lies in two, so edges between parts go, and a pivot's bit serves in every part. Parts of up to ``pivots`` nodes are
    settled by the next search, as all of their nodes are pivots; larger ones are split some ``pivots`` times, so rounds follow the logarithm
    of the number of nodes to that base. Before, nodes on circles within ranges of the edges become one (``contracted``), the least of them; if no circle is left, nothing is searched.
    """
    every = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    tied, left, done = contracted(cut(edges.where("src <> dst").select("src", "dst").distinct()), min(size, HELD_EDGES))
    parts, found = None, []
    while not (done or left.isEmpty()):
        nodes = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
        nodes = cut(nodes.withColumn("part", F.lit("")) if parts is None else nodes.join(parts, "node"))
        order = Window.partitionBy("part").orderBy(F.xxhash64("node"), "node")
        chosen = nodes.withColumn("bit", F.row_number().over(order) - 1).where(F.col("bit") < pivots)
        chosen = cut(chosen.select(F.col("node").alias("seed"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("block"), "bit"))
        left = cut(left.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").withColumn("at", F.lit(0)), [left])
        rows = nodes.select("node", "part", F.lit(None).cast("int").alias("side"), F.lit(None).cast("binary").alias("bits"))
        for side, (a, b) in enumerate((("src", "dst"), ("dst", "src"))):
            labels, *others = _labels(left.select(F.col(a).alias("src"), F.col(b).alias("dst"), "at"), chosen, size)
            discard(*others)
            rows = rows.unionByName(labels.select("node", F.lit(None).cast("string").alias("part"), F.lit(side).alias("side"), "bits"))
        split = cut(rows.repartition("node").sortWithinPartitions("node").mapInArrow(_split, "node bigint, part string, root int, next string"))
        least = split.where("root is not null").groupBy("part", "root").agg(F.min("node").alias("component"))
        found.append(cut(split.join(least, ["part", "root"]).select("node", "component")))
        parts = split.where("root is null").select("node", F.col("next").alias("part"))
        ends = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"))
        left = cut(left.select("src", "dst").join(ends("src"), "src").join(ends("dst"), "dst").where("part_src = part_dst").select("src", "dst"), [left])
    if tied is not None:
        every = every.join(tied, "node", "left").withColumn("to", F.coalesce("to", "node"))
    else:
        every = every.withColumn("to", F.col("node"))
    if not found:
        return every.select("node", F.col("to").alias("component"))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    return every.join(all_found.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))


def bow_tie(edges: DataFrame) -> DataFrame:
    """(node, region): core (largest strong component, ties to the greatest least member), in, out or other."""
    part = cut(strong_components(edges))
    core = part.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("component")).limit(1).select("component")
    members = cut(part.join(F.broadcast(core), "component", "left_semi").select("node"))
    seed = members.agg(F.min("node").alias("seed"))  # all members reach the same nodes
    out = reachable(edges, seed).select("node").join(members, "node", "left_anti").withColumn("o", F.lit(True))
    into = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seed).select("node").join(members, "node", "left_anti").withColumn("i", F.lit(True))
    marked = part.select("node").join(members.withColumn("c", F.lit(True)), "node", "left").join(out, "node", "left").join(into, "node", "left")
    return marked.select("node", F.when(F.col("c"), "core").when(F.col("i"), "in").when(F.col("o"), "out").otherwise("other").alias("region"))


def bow_tie_by(edges: DataFrame, strong: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, region) for several graphs at once: strong has (node, component, keys), nodes being distinct among graphs."""
    sizes = strong.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    first = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("component"))
    core = cut(sizes.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("component"))  # a row for each key
    bits = cut(_numbered(core.select(F.col("component").alias("seed"), F.lit(0).alias("start")), BLOCK))
    ends = lambda c, part: strong.select(F.col("node").alias(c), F.col("component").alias(part))
    links = edges.where("src <> dst").join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").where("a <> b")
    links = cut(links.select("a", "b").distinct())  # all members of a component reach the same nodes

    def reached(a: str, b: str, name: str) -> DataFrame:
        """The components that the cores lead to: a bit for each core, swept by buckets, as hop by hop a long path is a round for each of its edges."""
        labels, *others = _labels(links.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(0).alias("at")), bits, BUCKET)
        discard(*others)
        return labels.select(F.col("node").alias("component")).distinct().join(core, "component", "left_anti").withColumn(name, F.lit(True))

    out, into = reached("a", "b", "o"), reached("b", "a", "i")
    marked = strong.join(core.withColumn("c", F.lit(True)), "component", "left").join(out, "component", "left").join(into, "component", "left")
    return marked.select(*keys, "node", F.when(F.col("c"), "core").when(F.col("i"), "in").when(F.col("o"), "out").otherwise("other").alias("region"))
