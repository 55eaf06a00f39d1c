"""Bootstrap draws as counts: how often each unit is drawn, without resampled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import numbered

DRAWS = 10_000
BLOCK = 256  # units whose counts a task holds at once
KEYS = 64  # keys whose sums a task holds at once


def drawn_counts(first: int, last: int, n: int, draws: int = DRAWS, seed: int = 42) -> np.ndarray:
    """How often the units first to last - 1 of n are drawn in each of so many samples of n with replacement: (units, draws).

    The n places of a sample are dealt to halves of the range of units by a binomial draw, then to halves of those, and so on. Each draw's
    generator is keyed by the range that it splits, so whoever asks for a unit gets the same counts, whatever else is asked for.
    """
    out = np.zeros((max(0, last - first), draws), np.int64)
    todo = [(0, n, np.full(draws, n, np.int64))] if n > 0 else []
    while todo:
        lo, hi, counts = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            out[lo - first] = counts
            continue
        middle = (lo + hi) // 2
        left = np.random.default_rng((seed, lo, hi)).binomial(counts, (middle - lo) / (hi - lo))
        todo += [(lo, middle, left), (middle, hi, counts - left)]
    return out


def shared_draws(values: DataFrame, unit: str, value: str, *keys: str, draws: int = DRAWS, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(keys, units, mean, lo, hi): the mean of each key's values over units and its bootstrap interval, the draws of units being shared by
    all keys.

    values has a row for each unit and key. Values that are null or not finite are left out of their draw's mean; draws without any value
    are left out of the interval. A key without values has nulls. Tasks add up sums for each draw over their range of units.
    """
    units = numbered(values.select(unit).where(F.col(unit).isNotNull()).distinct(), [unit])
    n = units.count()
    placed = values.join(units, unit).select(*keys, F.col(value).cast("double").alias("_value"), "place").repartitionByRange("place").sortWithinPartitions("place")
    names = list(keys)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        block, counts = -1, None

        def emptied() -> Iterator[pd.DataFrame]:
            for k, (s, w) in held.items():
                yield pd.DataFrame({**{c: [v] * draws for c, v in zip(names, k)}, "_draw": np.arange(draws), "_s": s, "_w": w})
            held.clear()

        for f in frames:
            for b, rows in f.groupby(f["place"] // BLOCK):
                if b != block:
                    block, counts = b, drawn_counts(int(b) * BLOCK, min(n, (int(b) + 1) * BLOCK), n, draws, seed)
                for k, own in rows.groupby(names, dropna=False, sort=False) if names else [((), rows)]:
                    x = own["_value"].to_numpy(float)
                    there = np.isfinite(x)
                    c = counts[own["place"].to_numpy()[there] - block * BLOCK]
                    at = tuple(None if pd.isna(v) else v for v in k)
                    if at not in held:
                        if len(held) >= KEYS:
                            yield from emptied()
                        held[at] = np.zeros((2, draws))
                    held[at] += (x[there] @ c, c.sum(0))
        yield from emptied()

    types = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in names), "_draw int, _s double, _w double"])
    means = placed.mapInPandas(sums, schema).groupBy(*names, "_draw").agg(F.try_divide(F.sum("_s"), F.sum("_w")).alias("_m"))
    tail = (1 - level) / 2
    spread = means.groupBy(*names).agg(F.percentile("_m", F.lit(tail)).alias("lo"), F.percentile("_m", F.lit(1 - tail)).alias("hi"))
    finite = F.when(~F.isnan("_value") & (F.abs("_value") < float("inf")), F.col("_value"))
    plain = placed.groupBy(*names).agg(F.count(finite).alias("units"), F.avg(finite).alias("mean"))
    if not names:
        return plain.crossJoin(spread)  # one row each
    same = [plain[k].eqNullSafe(spread[k]) for k in names]
    return plain.join(spread, same).select(*(plain[k] for k in names), "units", "mean", "lo", "hi")


def paired(values: DataFrame, unit: str, model: str, value: str, pairs: list[tuple[str, str]], *keys: str) -> DataFrame:
    """(model_a, model_b, keys, unit, difference) of two models' values in units that both have, for the pairs given; null where
    either value is null."""
    asked = values.sparkSession.createDataFrame(pairs, "model_a string, model_b string")
    side = lambda x: values.select(F.col(model).alias(f"model_{x}"), *keys, unit, F.col(value).alias(f"_{x}"))
    both = side("a").join(F.broadcast(asked), "model_a").join(side("b"), ["model_b", *keys, unit])
    return both.select("model_a", "model_b", *keys, unit, (F.col("_a") - F.col("_b")).alias("difference"))
