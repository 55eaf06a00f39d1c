"""Statistics and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.scan import running


def average_rank(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds rank_<value>, ties averaged, from running counts of distinct values."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    up = running(counts, [F.col(value)], {"_upto": F.col("_n")}, *keys)
    ranks = up.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).cast("double").alias(f"rank_{value}"))
    return df.join(ranks, [*keys, value])


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of a column of sizes: equal values have ranks that add up to their number times the average."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    up = running(counts, [F.col(value)], {"_upto": F.col("_n")})
    n, x = F.sum("_n"), F.col(value).cast("double")
    weighted = F.sum(x * F.col("_n") * (F.col("_upto") - (F.col("_n") - 1) / 2))
    return up.agg((2 * weighted / (n * F.sum(x * F.col("_n"))) - (n + 1) / n).alias("gini"))


def min_max(df: DataFrame, *columns: str) -> DataFrame:
    """Adds scaled_<column>, from 0 for the least to 1 for the greatest value; a constant column has zeros."""
    ends = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = {f"scaled_{c}": F.coalesce(F.try_divide((F.col(c) - F.col(f"_lo_{c}")).cast("double"), (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).cast("double")), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).select(*df.columns, *scaled)  # one row


def pearson(x: str | Column, y: str | Column) -> Column:
    """Null for a single row or a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    ranked = average_rank(average_rank(df, x, *keys), y, *keys)
    return ranked.groupBy(*keys).agg(pearson(f"rank_{x}", f"rank_{y}").alias("spearman"), F.count("*").alias("n"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054, clamp: bool = True) -> tuple[Column, Column]:
    """Interval of a share; nulls for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    lo, hi = (mid - half) / scale, (mid + half) / scale
    return (F.greatest(lo, F.when(n > 0, F.lit(0.0))), F.least(hi, F.when(n > 0, F.lit(1.0)))) if clamp else (lo, hi)


def holm(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """Adds holm_p, the step-down adjustment within each family; null and NaN p-values stay null and don't count."""
    fine = F.col(p).isNotNull() & ~F.isnan(p)
    w = Window.partitionBy(*keys, fine).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*keys, fine))
    step = F.col(p) * (m - F.row_number().over(w) + 1)
    staged = df.withColumn("_step", F.when(fine, step)).withColumn("_fine", fine)
    top = F.max("_step").over(Window.partitionBy(*keys, "_fine").orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return staged.withColumn("holm_p", F.when(F.col("_fine"), F.least(F.lit(1.0), top))).drop("_step", "_fine")


def sign_flip(values: list[float]) -> float:
    """Exact two-sided p-value of a mean under all sign assignments.

    Sums of the signed values of either half meet: each sum of one half needs those of the other beyond the distance that is
    left, which are counted in order. So memory grows with 2^(n/2).
    """
    x = np.asarray(values, float)

    def sums(part: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for v in part:
            out = np.concatenate([out - v, out + v])
        return np.sort(out)

    least = abs(x.sum()) - 1e-12
    if least <= 0:
        return 1.0
    a, b = sums(x[: x.size // 2]), sums(x[x.size // 2 :])
    beyond = (b.size - np.searchsorted(b, least - a, "left")).sum() + np.searchsorted(b, -least - a, "right").sum()
    return float(beyond / 2.0**x.size)


def t_quantile(p: float, df: int) -> float:
    """Of Student's distribution, by bisection on its density's integral."""
    if df < 1:
        return math.nan
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    nodes, weights = np.polynomial.legendre.leggauss(200)

    def below(x: float) -> float:  # over the angle whose tangent is t / sqrt(df), where the density is smooth
        top = math.atan(x / math.sqrt(df))
        angle = top / 2 * (nodes + 1)
        return 0.5 + scale * math.sqrt(df) * top / 2 * float((weights * np.cos(angle) ** (df - 1)).sum())

    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_interval(df: DataFrame, value: str, *keys: str, level: float = 0.95) -> DataFrame:
    """(keys, n, mean, lo, hi): mean and Student's interval of each group; null limits for a single row."""
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        each = {k: t_quantile((1 + level) / 2, int(k) - 1) for k in n.unique()}
        return n.map(each)

    half = F.when(F.col("n") > 1, quantile("n") * F.col("_s") / F.sqrt("n"))
    return sums.select(*keys, "n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def joint_bootstrap(df: DataFrame, value: str, seed_column: str, week_column: str, *keys: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(keys, mean, lo, hi): seeds and weeks are drawn apart, with replacement, and all their cells are averaged.

    A draw is a count for each seed and each week, so all draws are two small products with the table of cells. Cells that are missing are left
    out of the averages. A group (seeds x weeks) is what one task can hold.
    """
    schema = df.select(*keys).schema
    for c in ("mean", "lo", "hi"):
        schema = schema.add(c, "double")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index=seed_column, columns=week_column, values=value, aggfunc="mean").to_numpy(float)
        there = np.isfinite(table)
        rng = np.random.default_rng(seed)
        rows = rng.multinomial(table.shape[0], np.full(table.shape[0], 1 / table.shape[0]), draws)
        weeks = rng.multinomial(table.shape[1], np.full(table.shape[1], 1 / table.shape[1]), draws)
        total = np.einsum("dw,dw->d", rows @ np.where(there, table, 0.0), weeks)
        count = np.einsum("dw,dw->d", rows @ there.astype(float), weeks)
        means = total[count > 0] / count[count > 0]
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in keys} | {"mean": [float(np.nanmean(table))], "lo": [float(np.quantile(means, 0.025))], "hi": [float(np.quantile(means, 0.975))]})

    return df.groupBy(*keys).applyInPandas(one, schema)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of group 1, tie-corrected z with continuity, two-sided p and rank-biserial correlation."""
    ranked = average_rank(df.select(value, group), value)
    sums = ranked.agg(F.sum(F.when(F.col(group) == 1, F.col(f"rank_{value}"))).alias("r1"), F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"))
    ties = df.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n, u = n1 + n0, F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    d = u - n1 * n0 / 2
    z = F.try_divide(d - F.signum(d) * 0.5, sd)
    got = sums.crossJoin(ties).select("n1", "n0", u.alias("u"), z.alias("z"), (2 * u / (n1 * n0) - 1).alias("rank_biserial"))

    def tail(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p=[math.erfc(abs(z) / math.sqrt(2)) if z == z and z is not None else None for z in f["z"]])

    return got.mapInPandas(tail, "n1 bigint, n0 bigint, u double, z double, rank_biserial double, p double")


def bootstrap(df: DataFrame, value: str, *keys: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Mean and median with percentile intervals from resampling each group; a group is what one task can hold."""
    names = ("mean", "lo", "hi", "median", "median_lo", "median_hi")
    schema = df.select(*keys).schema.add("n", "long")
    for c in names:
        schema = schema.add(c, "double")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[value].to_numpy(float)
        x = x[np.isfinite(x)]
        head = {k: [frame[k].iloc[0]] for k in keys}
        if not x.size:
            return pd.DataFrame(head | {"n": [0]} | {c: [None] for c in names})
        rng = np.random.default_rng(seed)
        z = x[rng.integers(0, x.size, (draws, x.size))] if x.size * draws < 2e7 else None
        means, medians = (z.mean(1), np.median(z, 1)) if z is not None else map(np.array, zip(*((s.mean(), np.median(s)) for s in (x[rng.integers(0, x.size, x.size)] for _ in range(draws)))))
        values = (x.mean(), *np.quantile(means, [0.025, 0.975]), np.median(x), *np.quantile(medians, [0.025, 0.975]))
        return pd.DataFrame(head | {"n": [x.size]} | {c: [float(v)] for c, v in zip(names, values)})

    return df.groupBy(*keys).applyInPandas(one, schema)


def block_means(x: np.ndarray, length: int, draws: int, seed: int = 42) -> np.ndarray:
    """Means of so many draws of whole blocks of x in a row, which don't wrap around, the last one cut so that a draw has the size of x.

    A block's sum is a difference of running sums, so no draw is written out: a draw is a few places in them.
    """
    upto = np.concatenate(([0.0], np.cumsum(x)))
    whole, rest = divmod(x.size, length)
    rng = np.random.default_rng(seed)
    total = np.zeros(draws)
    for part in [length] * whole + [rest] * (rest > 0):
        first = rng.integers(x.size - length, size=draws, endpoint=True)
        total += upto[first + part] - upto[first]
    return total / x.size


def permutation_test(df: DataFrame, x: str, y: str, *keys: str, stratum: str | None = None, draws: int = 2000, seed: int = 42, centred: bool = True) -> DataFrame:
    """Spearman correlation against shuffles of y (within strata if given); p with +1, null if a draw is undefined."""
    schema = df.select(*keys).schema.add("observed", "double").add("null_mean", "double").add("null_sd", "double").add("p", "double")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        a, b = (frame[c].rank().to_numpy(float) for c in (x, y))
        a, b = a - a.mean(), b - b.mean()
        scale = math.sqrt(float(a @ a) * float(b @ b))
        parts = [np.arange(b.size)] if stratum is None else list(frame.reset_index(drop=True).groupby(stratum).indices.values())
        observed, null = float(a @ b) / scale if scale > 0 else math.nan, []
        together = max(1, 4_000_000 // max(b.size, 1))  # draws that are shuffled at once
        for k in range(0, draws, together):
            dealt = np.tile(b, (min(together, draws - k), 1))
            for part in parts:
                dealt[:, part] = rng.permuted(dealt[:, part], axis=1)
            null.append(dealt @ a / scale if scale > 0 else np.full(len(dealt), math.nan))
        null = np.concatenate(null)
        middle = float(null.mean()) if centred else 0.0
        p = (1 + int((np.abs(null - middle) >= abs(observed - middle)).sum())) / (draws + 1) if scale > 0 else None
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in keys} | {"observed": [observed], "null_mean": [float(null.mean())], "null_sd": [float(null.std(ddof=1))], "p": [p]})

    return df.groupBy(*keys).applyInPandas(one, schema)


def log10_tail(z: Column) -> Column:
    """log10 of the two-sided normal tail beyond z (8 and more), by its asymptotic series; it doesn't run out as the tail itself does."""
    series = 1 - F.pow(z, -2) + 3 * F.pow(z, -4) - 15 * F.pow(z, -6) + 105 * F.pow(z, -8)
    return F.log10(F.lit(2.0)) - z * z / (2 * math.log(10)) - F.log10(z * math.sqrt(2 * math.pi)) + F.log10(series)
