"""One step along edges, with hubs split on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one node, on either side of the join, above which the node is split.
HEAVY = 10_000


def dealt(frontier: DataFrame, edges: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Frontier (seed, node, weight) and edges (node, next, w) with the cell (row, column) in which they meet.

    A node with a frontier rows and b edges has ceil(a / heavy) rows and ceil(b / heavy) columns of cells. A frontier row is in one row, by
    its seed, and is copied to each column; an edge is in one column, by its end, and is copied to each row. Every pair meets once, light
    nodes have one cell, and a cell has some heavy x heavy pairs at most. Only nodes that are heavy are listed, of which there is one for each
    `heavy` rows at most.
    """
    a = frontier.groupBy("node").agg(F.count("*").alias("_a"))
    b = edges.groupBy("node").agg(F.count("*").alias("_b"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / heavy)).cast("int")
    hubs = a.join(b, "node").where(F.greatest("_a", "_b") > heavy).select("node", parts("_a").alias("_rows"), parts("_b").alias("_columns"))

    def spread(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        one = F.lit(1)
        marked = df.join(hubs, "node", "left").withColumns({n: F.coalesce(n, one) for n in ("_rows", "_columns")})
        mine, many = ("_rows", "_columns") if own == "row" else ("_columns", "_rows")
        cells = {own: F.pmod(F.xxhash64(by), mine).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(many) - 1))}
        return marked.withColumn(own, cells[own]).withColumn(other, cells[other]).drop("_rows", "_columns")

    return spread(frontier, "seed", "row", "column"), spread(edges, "next", "column", "row")


def expand(frontier: DataFrame, edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(seed, node, ways, weight): where one step leads from (seed, node, weight) over edges (src, dst, w), in how many ways, and the sum of
    the products of weights. Null nodes and empty tables lead nowhere; repeated rows count as often as they are there."""
    left, right = dealt(frontier.select("seed", "node", "weight").where("node is not null"), edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "w").where("src is not null"), heavy)
    met = left.join(right, ["node", "row", "column"])
    return met.groupBy("seed", F.col("next").alias("node")).agg(F.count("*").alias("ways"), F.sum(F.col("weight") * F.col("w")).alias("weight"))
