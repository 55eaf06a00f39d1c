"""Connected components of any size, without a driver-side graph.

Rounds of contraction: every node points to the least of itself and its neighbours, pointers are followed twice, and the
edges between what is pointed to are the next, at most half as large, graph. A component's label is its least node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

#: Edges that a task holds at once while it replaces them by a spanning forest.
CHUNK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's edges as (node, least node of its tree): no edge is lost, repeated ones are."""

    def passed(edges: list[np.ndarray]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        for a, b in np.concatenate(edges).tolist():
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

    held, size = [], 0
    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], 1))
        size += b.num_rows
        if size >= CHUNK:
            yield passed(held)
            held, size = [], 0
    if held:
        yield passed(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b: bigint); nulls are dropped, direction and repeats don't matter.

    Nodes with no edge but a loop don't appear.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edges = cut(edges.mapInArrow(_forest, "a bigint, b bigint").distinct())
    labels = done = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        least = cut(least)
        up = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
        point = cut(least.join(up, "to").select("node", F.col("next").alias("to")), [least])
        moved = point.where("node <> to")
        if labels is None:
            labels = point.select("node", F.col("to").alias("component"))
        else:
            step = moved.select(F.col("node").alias("component"), F.col("to").alias("next"))
            labels = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        labels = cut(labels, [done] if done is not None else [])
        done = labels
        to = lambda c: moved.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        edges = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b")
        edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), [point, edges])
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where(F.lit(False))
    return labels
