"""Spectral radius of a weighted graph, by the diagonal blocks that its strong components are.

Blocks of up to DENSE nodes are solved by themselves, each in a group of that size. All larger ones are iterated on side by side, as tables:
no task and no driver holds a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from weftline.operators.paths import strong_components
from weftline.session import cut, discard

#: Nodes of a block that is solved densely.
DENSE = 500
#: Products with the matrix between two projections.
STEPS = 5
#: How close the bounds of a radius have to be, relative to it.
TOLERANCE = 1e-11
#: Rounds after which blocks that mix slowly stay as they are, with their bounds.
ROUNDS = 200


def _dense(frame: pd.DataFrame) -> tuple[np.ndarray, float, np.ndarray]:
    names = np.unique(np.concatenate([frame["src"], frame["dst"]]))
    a = np.zeros((names.size, names.size))
    np.add.at(a, (np.searchsorted(names, frame["src"]), np.searchsorted(names, frame["dst"])), frame["w"].to_numpy(float))
    values, vectors = np.linalg.eig(a)
    top = np.abs(vectors[:, np.argmax(values.real)].real)
    return names, float(np.abs(values).max()), top / top.sum()


def power(steps: int) -> np.ndarray:
    """Weights of x0 to xs that give (A / r + 1) ** steps x0, as x(k) is (A / r - 1) ** k x0."""
    return np.array([math.comb(steps, k) * 2.0 ** (steps - k) for k in range(steps + 1)])


def ritz(gram: np.ndarray) -> np.ndarray:
    """Weights of x0 to xs in A / r + 1 times the projected vector of the greatest eigenvalue, for the products of x0 to xs with each other,
    where each x is A / r - 1 times the one before. As r comes near, x1 and the next are what is still wrong with x0, however small, so
    nothing of their digits is lost. What the products can't tell apart is left out; if no real vector is left, powers are taken."""
    s = len(gram) - 1
    size = np.diag(gram)[:s]
    scale = np.where(size > 0, 1 / np.sqrt(np.where(size > 0, size, 1)), 0)
    inner, moved = gram[:s, :s] * np.outer(scale, scale), gram[:s, 1:] * np.outer(scale, scale)
    spread, turn = np.linalg.eigh(inner)
    keep = spread > 1e-11 * spread[-1]
    base = turn[:, keep] / np.sqrt(spread[keep])
    values, vectors = np.linalg.eig(base.T @ moved @ base)
    best = np.argmax(values.real)
    y = scale * (base @ vectors[:, best].real)
    length = y @ gram[:s, :s] @ y
    if abs(values[best].imag) > 1e-9 * (1 + abs(values[best])) or not np.isfinite(length) or length <= 0:
        return power(s)
    return (2 * np.append(y, 0) + np.append(0, y)) / np.sqrt(length)


@F.pandas_udf(ArrayType(DoubleType()))
def _weights(products: pd.Series) -> pd.Series:
    def one(flat: np.ndarray) -> np.ndarray:
        n = STEPS + 1
        gram = np.zeros((n, n))
        gram[np.triu_indices(n)] = flat
        return ritz(gram + np.triu(gram, 1).T)

    return products.map(one)


def perron(inside: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(component, radius, lo, hi) and (component, node, mass) of strong blocks (component, src, dst, w) of positive weights.

    Each round multiplies all blocks' vectors by A / r - 1 (r: the last estimate) so many times. Then a block's vectors are put together by
    its small projected problem, if the round before made its bounds closer and what comes out is positive; else as powers of A / r + 1, by
    which periodic blocks settle as well. The least and the greatest ratio of (A x) to x bound the radius, whatever x is. Blocks are done
    once these are close, or the estimate moves by less than a tenth of the tolerance in a round (where masses differ by many orders, the bounds
    wait for the least of them); these, and those that aren't done after all rounds, come out with wider bounds. A mass is of sum 1 in its block. A step is one join
    and one sum by node; what belongs to a block is a row.
    """
    merged = inside.groupBy("component", "src", "dst").agg(F.sum("w").alias("w")).withColumn("own", F.lit(False))
    nodes = merged.select("component", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).distinct()
    rows = cut(merged.unionByName(nodes.select("component", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w"), F.lit(True).alias("own"))))
    sums = rows.groupBy("component", F.col("src").alias("node")).agg(F.sum("w").alias("_sum"))
    start = sums.groupBy("component").agg(F.avg("_sum").alias("r"))
    x = cut(sums.join(start, "component").select("component", "node", F.lit(1.0).alias("x0"), "r", F.lit(float("inf")).alias("gap")))
    names = [f"x{k}" for k in range(STEPS + 1)]
    radii, masses, spent = [], [], []
    for number in range(rounds):
        t = x
        for k in range(STEPS):
            own = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
            met = rows.join(t.withColumnRenamed("node", "dst"), ["component", "dst"])
            product = F.when(F.col("own"), -F.col(f"x{k}")).otherwise(F.col("w") / F.col("r") * F.col(f"x{k}"))
            t = met.groupBy("component", F.col("src").alias("node")).agg(*map(own, names[: k + 1]), own("r"), own("gap"), F.sum(product).alias(f"x{k + 1}"))
        t = cut(t)
        ratio = (F.col("x1") / F.col("x0") + 1) * F.col("r")
        products = F.array(*(F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]))
        of = t.groupBy("component").agg(F.min(ratio).alias("lo"), F.max(ratio).alias("hi"), (F.sum(ratio * F.col("x0")) / F.sum("x0")).alias("radius"), F.sum("x0").alias("_mass"), F.max("gap").alias("_gap"), F.max("r").alias("_before"), products.alias("_products"))
        of = cut(of.withColumn("_now", (F.col("hi") - F.col("lo")) / F.col("hi")))
        still = F.abs(F.col("radius") - F.col("_before")) <= tolerance / 10 * F.col("radius")
        done = ((F.col("_now") <= tolerance) | (still & F.lit(number > 0))) if number + 1 < rounds else F.lit(True)
        radii.append(of.where(done).select("component", "radius", "lo", "hi"))
        masses.append(t.join(of.where(done), "component").select("component", "node", (F.col("x0") / F.col("_mass")).alias("mass")))
        left = of.where(~done)
        spent.append(x)
        if number + 1 == rounds or left.isEmpty():
            break
        plain = F.array(*(F.lit(float(c)) for c in power(STEPS)))
        y = left.select("component", F.col("radius").alias("_r"), "_now", F.when(F.col("_now") < F.col("_gap"), _weights("_products")).otherwise(plain).alias("_y"), plain.alias("_p"), "_mass")
        put = lambda c: sum((F.get(c, F.lit(k)) * F.col(n) for k, n in enumerate(names)), F.lit(0.0))
        together = cut(t.join(y, "component").select("component", "node", put("_y").alias("_z"), (put("_p") / F.col("_mass")).alias("_last"), "_r", "_now"))
        sign = together.groupBy("component").agg((F.min("_z") > 0).alias("_up"), (F.max("_z") < 0).alias("_down"), F.sum(F.abs("_z")).alias("_sum"))
        z = F.when(F.col("_up") | F.col("_down"), F.abs("_z") / F.col("_sum")).otherwise(F.col("_last"))
        x = cut(together.join(sign, "component").select("component", "node", z.alias("x0"), F.col("_r").alias("r"), F.col("_now").alias("gap")), drop=[together])
    discard(*spent)
    every = lambda parts: cut(_united(parts))
    return every(radii), every(masses)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _blocks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component, src, dst, w) of edges inside strong components, and (component, nodes)."""
    part = cut(strong_components(edges))
    at = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    inside = cut(edges.where("w > 0").join(at("src"), "src").join(at("dst"), "dst").where("src_c = dst_c").select(F.col("src_c").alias("component"), "src", "dst", F.col("w").cast("double").alias("w")))
    sizes = part.groupBy("component").agg(F.count("*").alias("nodes")).join(inside.select("component").distinct(), "component", "left_semi")
    return inside, cut(sizes)


def _radii(inside: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(component, nodes, radius, lo, hi), and the masses of the blocks that were iterated on, if there are any."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        radius = _dense(frame)[1]
        return pd.DataFrame({"component": [frame["component"].iloc[0]], "radius": [radius], "lo": [radius], "hi": [radius]})

    small = inside.join(sizes.where(F.col("nodes") <= DENSE).select("component"), "component", "left_semi")
    kind = inside.schema["component"].dataType.simpleString()
    got, masses = small.groupBy("component").applyInPandas(solve, f"component {kind}, radius double, lo double, hi double"), None
    large = sizes.where(F.col("nodes") > DENSE).select("component")
    if not large.isEmpty():
        radii, masses = perron(inside.join(large, "component", "left_semi"))
        got = got.unionByName(radii)
    return sizes.join(got, "component"), masses


def spectral_radius(edges: DataFrame, recovery: float = 0.25) -> DataFrame:
    """(component, nodes, radius, beta_c, lo, hi) of each strong component with an edge inside: lo and hi bound the radius (of a dense block
    they are the radius). Edges of no weight are none. beta_c is null for radius 0."""
    beta = F.try_divide(F.lit(recovery), F.nullif(F.round("radius", 12), F.lit(0.0)))
    return _radii(*_blocks(edges))[0].select("component", "nodes", "radius", beta.alias("beta_c"), "lo", "hi")


def both_radii(edges: DataFrame) -> DataFrame:
    """(component, radius, other): each strong component's radius, and that of its reversed edges. Reversing keeps strong components, so they are looked
    for once; the radii are found apart, in one run of all blocks of both directions."""
    inside, sizes = _blocks(edges)
    side = lambda n: F.concat_ws("|", F.lit(n), "component").alias("component")
    every = inside.select(side("radius"), "src", "dst", "w").unionByName(inside.select(side("other"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    got = _radii(every, sizes.select(side("radius"), "nodes").unionByName(sizes.select(side("other"), "nodes")))[0]
    name, component = F.substring_index("component", "|", 1), F.substring_index("component", "|", -1).cast("bigint").alias("component")
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("radius"))).alias(n)
    return got.select(component, name.alias("side"), "radius").groupBy("component").agg(of("radius"), of("other"))


def dominant_vector(edges: DataFrame) -> DataFrame:
    """(node, mass): the right eigenvector, of sum 1, of the strong component with the greatest radius (the least component among equals)."""
    inside, sizes = _blocks(edges)
    radii, masses = _radii(inside, sizes)
    first = cut(radii.orderBy(F.desc(F.round("radius", 9)), "component").limit(1).select("component", "nodes"))
    if first.where(F.col("nodes") > DENSE).isEmpty():

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            names, _, mass = _dense(frame)
            return pd.DataFrame({"node": names, "mass": mass})

        return inside.join(F.broadcast(first), "component").groupBy("component").applyInPandas(solve, "node bigint, mass double")  # one row
    return masses.join(F.broadcast(first), "component").select("node", "mass")  # a block's vector comes with its radius
