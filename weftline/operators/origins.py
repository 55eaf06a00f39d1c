"""Logistic regression for all rolling origins and all penalties at once: each step is one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import metrics
from weftline.session import cut, discard

#: Penalties to choose from.
GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
CELLS = 1 << 20  # rows times fits that a task holds at once


def _by_period(rows: DataFrame, period: str, label: str, features: list[str], calendar: list) -> tuple[np.ndarray, ...]:
    """Class counts, means and squared deviations of the rows up to each period, merged from one row for each period."""
    aggs = [F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("k")]
    aggs += [f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("v", F.var_pop))]
    got = {r[period]: r for r in rows.groupBy(period).agg(*aggs).collect()}
    d = len(features)
    n, k, m, q = 0, 0, np.zeros(d), np.zeros(d)
    out = []
    for p in calendar:
        r = got.get(p)
        if r is not None:
            means, spread = np.array([r[f"m{i}"] for i in range(d)]), np.array([r[f"v{i}"] for i in range(d)])
            shift = means - m
            q = q + spread * r["n"] + shift**2 * n * r["n"] / (n + r["n"])
            m = m + shift * r["n"] / (n + r["n"])
            n, k = n + r["n"], k + r["k"]
        out.append((n, k, m, q))
    return tuple(np.array(x) for x in zip(*out))


def _passed(rows: DataFrame, upto: np.ndarray, weights: np.ndarray, theta: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(fits, 1 + d + d (d + 1) / 2): loss, gradient and upper half of the Hessian of each fit, over its own training rows."""
    d = theta.shape[1]
    pairs = list(combinations_with_replacement(range(d), 2))
    width = 1 + d + len(pairs)
    step = max(1, CELLS // max(1, len(theta)))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(theta), width))
        for f in frames:
            for i in range(0, len(f), step):
                part = f.iloc[i : i + step]
                at, y = part["_at"].to_numpy(), part["_y"].to_numpy(int)
                x = np.column_stack([np.ones(len(part)), (part[part.columns[2:]].to_numpy(float) - centre) / scale])
                w = weights[:, y].T * (at[:, None] <= upto[None, :])
                eta = x @ theta.T
                p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                total[:, 0] += (w * (np.logaddexp(0, eta) - y[:, None] * eta)).sum(0)
                total[:, 1 : 1 + d] += (w * (p - y[:, None])).T @ x
                curved = w * p * (1 - p)
                total[:, 1 + d :] += curved.T @ np.column_stack([x[:, a] * x[:, b] for a, b in pairs])
        yield pd.DataFrame({"fit": np.arange(len(theta)), "sums": list(total)})

    partial = rows.mapInPandas(sums, "fit int, sums array<double>").select("fit", F.posexplode("sums"))
    out = np.zeros((len(theta), width))
    for r in partial.groupBy("fit", "pos").agg(F.sum("col").alias("s")).toLocalIterator():  # a number for each fit and place
        out[r["fit"], r["pos"]] = r["s"]
    return out


def logistic_grid(rows: DataFrame, origins: DataFrame, features: list[str], label: str, period: str, grid: tuple[float, ...] = GRID, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """(origin, validation, test, c, coefficients, loss, steps): logistic regressions on all rows up to each origin's train_until.

    The penalty is |w|^2 / (2 c), the intercept is free, rows weigh N / (2 N of their class), and features are scaled by the mean and
    population deviation of the origin's training rows (a constant feature is only centred). coefficients are for features as given,
    intercept first. Labels are 0 and 1, features without nulls. Origins whose training rows have one class only are left out.

    Newton's method, with steps halved while the objective grows, on fits of all origins and penalties side by side: tasks add up losses,
    gradients and Hessians of their rows for all fits that aren't done, a group-by adds up tasks, and the driver solves systems of the size
    of the features. Rows aren't copied for each origin. What the driver holds grows with origins, penalties and features only.
    """
    spark = rows.sparkSession
    calendar = sorted(r[0] for r in rows.select(period).union(origins.select("train_until")).distinct().collect())  # periods are few
    at = {p: i for i, p in enumerate(calendar)}
    asked = sorted((tuple(r) for r in origins.select("origin", "train_until", "validation", "test").collect()), key=lambda o: o[0])
    d = len(features) + 1
    schema = f"origin int, validation {dict(origins.dtypes)['validation']}, test {dict(origins.dtypes)['test']}, c double, coefficients array<double>, loss double, steps int"
    numbers = F.create_map(*(x for p, i in at.items() for x in (F.lit(p), F.lit(i)))) if at else None
    if not asked or not calendar:
        return spark.createDataFrame([], schema)
    n, k, means, squares = _by_period(rows, period, label, features, calendar)
    fits, upto, weights, scales = [], [], [], []
    for o in asked:
        i = at[o[1]]
        if not 0 < k[i] < n[i]:
            continue
        sd = np.sqrt(squares[i] / n[i])
        for c in grid:
            fits.append((o, c))
            upto.append(i)
            weights.append((n[i] / (2 * (n[i] - k[i])), n[i] / (2 * k[i])))
            scales.append((means[i], np.where(sd > 0, sd, 1.0)))
    if not fits:
        return spark.createDataFrame([], schema)
    last = max(upto)
    whole = np.sqrt(squares[last] / n[last])
    centre, scale = means[last], np.where(whole > 0, whole, 1.0)
    own = cut(rows.where(F.col(period) <= F.lit(calendar[last])).select(numbers[F.col(period)].alias("_at"), F.col(label).cast("int").alias("_y"), *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features))))
    upto, weights, c = np.array(upto), np.array(weights), np.array([c for _, c in fits])
    turn = np.zeros((len(fits), d, d))  # an origin's scaled features from those that all rows share
    for j, (m, s) in enumerate(scales):
        turn[j, 0, 0] = 1
        turn[j, 1:, 0] = (centre - m) / s
        turn[j, range(1, d), range(1, d)] = scale / s
    half = np.triu_indices(d)
    ridge = np.diag([0.0] + [1.0] * (d - 1))
    theta, before, best = np.zeros((len(fits), d)), np.zeros((len(fits), d)), np.full(len(fits), np.inf)
    steps, open_ = np.zeros(len(fits), int), np.arange(len(fits))
    for _ in range(rounds):
        if not len(open_):
            break
        shared = np.einsum("jab,ja->jb", turn[open_], theta[open_])
        sums = _passed(own, upto[open_], weights[open_], shared, centre, scale)
        going = []
        for j, s in zip(open_, sums):
            steps[j] += 1
            objective = c[j] * s[0] + theta[j, 1:] @ theta[j, 1:] / 2
            if objective > best[j] + 1e-12 * abs(best[j]) and np.abs(theta[j] - before[j]).max() > tolerance:
                theta[j] = (theta[j] + before[j]) / 2
                going.append(j)
                continue
            hessian = np.zeros((d, d))
            hessian[half] = s[1 + d :]
            hessian = hessian + np.triu(hessian, 1).T
            slope = c[j] * turn[j] @ s[1 : 1 + d] + ridge @ theta[j]
            move = np.linalg.solve(c[j] * turn[j] @ hessian @ turn[j].T + ridge, slope)
            best[j], before[j] = min(best[j], objective), theta[j].copy()
            theta[j] = theta[j] - move
            if np.abs(move).max() > tolerance * max(1.0, np.abs(theta[j]).max()):
                going.append(j)
        open_ = np.array(going, int)
    discard(own)
    if len(open_):
        raise ArithmeticError(f"{len(open_)} fits have not converged after {rounds} rounds")
    out = []
    for j, (o, cj) in enumerate(fits):
        m, s = scales[j]
        w = theta[j, 1:] / s
        out.append((o[0], o[2], o[3], float(cj), [float(theta[j, 0] - w @ m), *map(float, w)], float(best[j]), int(steps[j])))
    return spark.createDataFrame(out, schema)


def _probability(features: list[str]) -> F.Column:
    score = F.col("coefficients")[0]
    for i, f in enumerate(features):
        score = score + F.col("coefficients")[i + 1] * F.col(f)
    return 1 / (1 + F.exp(-score))


def selected(fits: DataFrame, rows: DataFrame, features: list[str], label: str, period: str) -> DataFrame:
    """(origin, test, c, coefficients, macro_f1): each origin's fit with the best macro-F1 in its validation period, ties to the smaller c.

    Fits are a row for each origin and penalty, and broadcast. An origin without validation rows has none.
    """
    held = rows.join(F.broadcast(fits), F.col(period) == F.col("validation")).select("origin", "c", F.col(label).alias("y"), _probability(features).alias("p"))
    tuned = metrics.scores(metrics.confusion(held, "origin", "c"), "origin", "c").select("origin", "c", "macro_f1")
    best = tuned.groupBy("origin").agg(F.max(F.struct("macro_f1", (-F.col("c")).alias("least"))).alias("_best"))
    chosen = best.select("origin", (-F.col("_best.least")).alias("c"), "_best.macro_f1")
    return fits.join(chosen, ["origin", "c"]).select("origin", "test", "c", "coefficients", "macro_f1")


def predicted(chosen: DataFrame, rows: DataFrame, features: list[str], period: str) -> DataFrame:
    """Rows of each origin's test period, with origin, c, the validation's macro_f1 and p1; nothing before looks at them."""
    return rows.join(F.broadcast(chosen), F.col(period) == F.col("test")).select(*rows.columns, "origin", "c", "macro_f1", _probability(features).alias("p1"))
