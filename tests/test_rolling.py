"""As-of joins by ranges, snapshots, fits by rolling origin and shared draws, against plain re-computations."""

import collections
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import draws, graph, origins, panel
from weftline.operators.scan import last_known


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("strict", [True, False])
def test_asof_of_a_hot_key(spark, many_ranges, strict):
    """A key with nine tenths of the rows lies in most ranges; keys may be null, values too, and keys may have no right row."""
    rng = np.random.default_rng(3)
    key = lambda: None if rng.random() < 0.02 else 1 if rng.random() < 0.9 else int(rng.integers(2, 9))
    left = [(i, key(), int(rng.integers(0, 400))) for i in range(1500)] + [(2000, 77, 5)]
    right = sorted({(key(), int(rng.integers(0, 400))) for _ in range(300)}, key=repr)
    right = [(k, t, None if i % 11 == 0 else i) for i, (k, t) in enumerate(right)]
    got = panel.asof(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", ["v"], strict)
    want = {}
    for i, k, t in left:
        before = [(s, v) for q, s, v in right if q == k and (s < t or not strict and s == t)]
        want[i] = max(before, key=lambda x: x[0]) if before else (None, None)
    assert {r.i: (r.matched_at, r.v) for r in got.collect()} == want and got.columns == ["i", "k", "t", "v", "matched_at"]


def test_last_known_spreads_a_key(spark, many_ranges):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") == 3, F.col("id")).alias("v"))
    got = last_known(df, ["id"], "v", "last", "k")
    assert got.where("id >= 3 and last = 3").count() == 3997 and got.where("id < 3 and last is null").count() == 3
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) <= 2000


def test_snapshot_statistics(spark):
    """A week with a circle and a tail, one with loops only, and one of the same nodes with another shape."""
    edges = [(1, "a", "b", 2), (1, "b", "c", 1), (1, "c", "a", 1), (1, "c", "d", 4), (1, "d", "d", 1), (1, "x", "y", 1), (2, "a", "a", 3), (3, "a", "b", 1), (3, "b", "a", 1), (3, "b", "c", 1)]
    got = {r.week: r.asDict() for r in graph.snapshot_statistics(spark.createDataFrame(edges, "week int, src string, dst string, w long"), "week").collect()}
    pick = lambda w, *names: tuple(got[w][n] for n in names)
    names = ("nodes", "edges", "events", "largest_weak", "largest_strong", "density", "reciprocity", "mean_in_degree", "mean_out_strength")
    assert pick(1, *names) == (6, 6, 10, 4, 3, 5 / 30, 0.0, 1.0, 10 / 6)
    assert pick(2, *names) == (1, 1, 3, 1, 1, 0.0, None, 1.0, 3.0)
    assert pick(3, *names) == (3, 3, 3, 3, 2, 3 / 6, 2 / 3, 1.0, 1.0)


def plain_fit(x, y, c):
    """Newton on materialised, scaled rows."""
    sd = x.std(0)
    mean, sd = x.mean(0), np.where(sd > 0, sd, 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    weight = len(y) / (2 * np.bincount(y, minlength=2))[y]
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - 0.5 * np.linalg.solve(c * (z * (weight * p * (1 - p))[:, None]).T @ z + ridge, c * z.T @ (weight * (p - y)) + ridge @ w)
    own = w[1:] / sd
    return np.concatenate([[w[0] - own @ mean], own])


def test_logistic_grid_equals_separate_fits(spark):
    rng = np.random.default_rng(5)
    rows = []
    for m in range(13):
        for u in range(40):
            a, b = rng.normal(50 + m, 3), rng.normal(0, 0.01)
            rows.append((u, datetime.date(2020, 1 + m % 12, 1) if m < 12 else datetime.date(2021, 1, 1), float(a), float(b), 7.0, int(rng.random() < 1 / (1 + np.exp(-(a - 55) / 3 - 80 * b)))))
    df = spark.createDataFrame(rows, "u int, m date, a double, b double, same double, y int").repartition(5)
    names = ["a", "b", "same"]
    asked = panel.rolling_origins(df, "m")
    fits = origins.logistic_grid(df, asked, names, "y", "m")
    got = {(r.origin, r.c): r for r in fits.collect()}
    assert len(got) == asked.count() * len(origins.GRID) == 20
    train = {o.origin: [r for r in rows if r[1] <= o.train_until] for o in asked.collect()}
    for (o, c), r in got.items():
        x, y = np.array([t[2:5] for t in train[o]]), np.array([t[5] for t in train[o]])
        assert np.allclose(r.coefficients, plain_fit(x, y, c), rtol=1e-6, atol=1e-7)

    def macro(r, held):
        p = [1 / (1 + np.exp(-(r.coefficients[0] + np.dot(r.coefficients[1:], t[2:5])))) for t in held]
        n = collections.Counter((t[5], int(q >= 0.5)) for t, q in zip(held, p))
        f = lambda k: 2 * n[k, k] / d if (d := 2 * n[k, k] + n[k, 1 - k] + n[1 - k, k]) else 0.0
        return (f(0) + f(1)) / 2

    chosen = origins.selected(fits, df, names, "y", "m")
    for s in chosen.collect():
        tried = [(round(macro(got[s.origin, c], [t for t in rows if t[1] == got[s.origin, c].validation]), 9), -c) for c in origins.GRID]
        assert (round(s.macro_f1, 9), -s.c) == max(tried)
    out = origins.predicted(chosen, df, names, "m")
    assert out.count() == 40 * 4 and out.where("p1 <= 0 or p1 >= 1").isEmpty()


def test_logistic_grid_of_one_class_and_of_none(spark):
    df = spark.createDataFrame([(datetime.date(2020, k, 1), float(k), 1) for k in range(1, 13)], "m date, a double, y int")
    assert origins.logistic_grid(df, panel.rolling_origins(df, "m"), ["a"], "y", "m").isEmpty()
    assert origins.logistic_grid(df.limit(0), panel.rolling_origins(df.limit(0), "m"), ["a"], "y", "m").isEmpty()


def test_drawn_counts():
    """Each draw has n places; moments are those of the multinomial; a unit's counts don't depend on what else is asked for."""
    c = draws.drawn_counts(0, 37, 37, 4000)
    assert (c.sum(0) == 37).all()
    assert abs(c.mean() - 1) < 1e-12 and abs(c.var(1).mean() - (1 - 1 / 37)) < 0.03 and np.abs(c.mean(1) - 1).max() < 0.08
    assert abs(np.corrcoef(c)[np.triu_indices(37, 1)].mean() + 1 / 36) < 0.01
    assert (draws.drawn_counts(11, 19, 37, 4000) == c[11:19]).all()
    assert (draws.drawn_counts(0, 37, 37, 4000, seed=1) != c).any() and draws.drawn_counts(0, 0, 0, 5).shape == (0, 5)


@pytest.mark.parametrize("block, keys", [(256, 64), (4, 1)])
def test_shared_draws(spark, monkeypatch, block, keys):
    """Equal to resampling by the counts; nulls and values that aren't finite are left out; equal values give equal intervals."""
    monkeypatch.setattr(draws, "BLOCK", block)
    monkeypatch.setattr(draws, "KEYS", keys)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 30))
    x[2] = x[0]
    odd = {(1, 4): None, (1, 9): float("nan"), (1, 10): float("inf")}
    rows = [(f"m{k}", u * 3, odd.get((k, u), float(x[k, u]))) for k in range(3) for u in range(30)] + [("none", 0, None)]
    got = {r.model: r for r in draws.shared_draws(spark.createDataFrame(rows, "model string, unit int, value double"), "unit", "value", "model", draws=500).collect()}
    c = draws.drawn_counts(0, 30, 30, 500)
    for k in range(2):
        keep = np.array([(k, u) not in odd for u in range(30)])
        means = (x[k] * keep) @ c / (keep @ c)
        r = got[f"m{k}"]
        assert r.units == keep.sum() and np.allclose((r.mean, r.lo, r.hi), (x[k][keep].mean(), *np.quantile(means, [0.025, 0.975])))
    assert (got["m0"].lo, got["m0"].hi) == pytest.approx((got["m2"].lo, got["m2"].hi))
    assert (got["none"].units, got["none"].mean, got["none"].lo) == (0, None, None)
    whole = draws.shared_draws(spark.createDataFrame([(u, float(u)) for u in range(9)], "unit int, value double"), "unit", "value", draws=50).collect()
    assert len(whole) == 1 and whole[0].lo <= whole[0].mean <= whole[0].hi
