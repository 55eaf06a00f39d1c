"""Greedy modularity communities of the strongest nodes: a bounded subgraph, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import degrees, induced


def merge_greedily(a: np.ndarray) -> list[int]:
    """Labels after joining, again and again, the two communities that raise modularity most; ties go to lower numbers."""
    n, total = len(a), a.sum()
    label = np.arange(n)
    e = a / total if total else a.copy()
    alive = list(range(n))
    while len(alive) > 1:
        row = e.sum(1)
        gain = e + e.T - 2 * np.outer(row, row)
        sub = gain[np.ix_(alive, alive)]
        sub[np.tril_indices(len(alive))] = -np.inf
        sub[e[np.ix_(alive, alive)] == 0] = -np.inf
        i, j = divmod(int(sub.argmax()), len(alive))
        if not sub[i, j] > 1e-12:
            break
        x, y = alive[i], alive[j]
        e[x] += e[y]
        e[:, x] += e[:, y]
        e[y] = e[:, y] = 0
        label[label == y] = x
        alive.remove(y)
    return label.tolist()


def greedy_modularity(edges: DataFrame, most_nodes: int = 100) -> DataFrame:
    """(node, community) among the nodes of greatest total strength, edges taken as undirected; a community is its least node."""
    top = degrees(edges).orderBy(F.desc("total_strength"), "node").limit(most_nodes).select("node")
    inner = induced(edges, top).where("src <> dst").select("src", "dst", "w")

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        f = pd.concat(held)
        names = np.unique(np.concatenate([f["src"], f["dst"]]))
        i, j = np.searchsorted(names, f["src"]), np.searchsorted(names, f["dst"])
        a = np.zeros((names.size, names.size))
        np.add.at(a, (i, j), f["w"].to_numpy(float))
        label = merge_greedily(a + a.T)
        yield pd.DataFrame({"node": names, "community": names[label]})

    return inner.coalesce(1).mapInPandas(one, "node bigint, community bigint")
