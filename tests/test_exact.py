"""Exact quantiles, hubs that are split, blocks in a row: against plain re-computations."""

import numpy as np
import oracle
import pandas as pd
import pytest

from weftline.operators import expansion, quantiles, stats
from weftline.plans import registry

PLACES = {"q0": 0.0, "q05": 0.05, "q5": 0.5, "q77": 0.77, "q1": 1.0}


def test_quantiles_of_hot_and_tied_keys(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 3000)] + [("one", 7.0)] + [(None, float(v)) for v in rng.normal(size=31)] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: [r[n] for n in PLACES] for r in quantiles.quantiles(df, "v", PLACES, "k").collect()}
    assert set(got) == {"hot", "one", None}
    for k, values in got.items():
        assert np.allclose(values, np.quantile([v for a, v in rows if a == k and v is not None], list(PLACES.values())))
    whole = quantiles.quantiles(df, "v", PLACES).collect()
    assert len(whole) == 1 and np.allclose([whole[0][n] for n in PLACES], np.quantile([v for _, v in rows if v is not None], list(PLACES.values())))


def test_quantiles_without_values(spark):
    none = spark.createDataFrame([("a", None)], "k string, v double")
    assert quantiles.quantiles(none, "v", PLACES, "k").count() == 0
    assert [list(r) for r in quantiles.quantiles(none, "v", PLACES).collect()] == [[None] * 5]
    assert quantiles.describe(none, "v", PLACES, "k").count() == 0
    assert [r.bin for r in quantiles.binned(none, "v", [0.5]).collect()] == [None]


def test_quantiles_hold_no_group(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id * 1.5 AS v")
    plan = quantiles.quantiles(df, "v", PLACES, "k")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan


@pytest.mark.parametrize("heavy", [1, 7, 10_000])
def test_expansion_of_a_star(spark, heavy):
    rng = np.random.default_rng(1)
    rows = [(k, 0, 1 + k % 3) for k in range(1, 60)] + [(0, k, 2) for k in range(1, 50)] + [(int(a), int(b), 1) for a, b in rng.integers(1, 30, (40, 2))] + [(5, None, 1), (None, 5, 1), (5, 0, 9)]
    edges = spark.createDataFrame(rows, "src long, dst long, w long")
    frontier = edges.selectExpr("src AS seed", "dst AS node", "w AS weight")
    e = pd.DataFrame([r for r in rows if r[0] is not None], columns=["src", "dst", "w"])
    f = pd.DataFrame([r for r in rows if r[1] is not None], columns=["seed", "node", "weight"])
    met = f.merge(e, left_on="node", right_on="src")
    met["weight"] *= met["w"]
    want = met.groupby(["seed", "dst"], dropna=False).agg(ways=("w", "size"), weight=("weight", "sum")).reset_index()
    plain = lambda v: None if pd.isna(v) else int(v)
    got = sorted(map(repr, ((r.seed, r.node, r.ways, r.weight) for r in expansion.expand(frontier, edges, heavy).collect())))
    assert got == sorted(repr(tuple(map(plain, r))) for r in want.itertuples(index=False))


def test_cells_of_a_hub_are_bounded(spark):
    """All pairs of a star go through its hub; the largest cell is within three times the median."""
    ends = spark.range(1, 2001)
    frontier, edges = ends.selectExpr("id AS seed", "0L AS node", "1L AS weight"), ends.selectExpr("0L AS node", "id AS next", "1L AS w")
    left, right = expansion.dealt(frontier, edges, 100)
    cells = left.groupBy("row", "column").count().join(right.groupBy("row", "column").count().withColumnRenamed("count", "other"), ["row", "column"]).toPandas()
    work = cells["count"] * cells["other"]
    assert len(cells) == 400 and work.sum() == 2000 * 2000 and work.max() <= 3 * work.median()
    none = frontier.where("seed < 0")
    assert expansion.expand(none, edges.selectExpr("node AS src", "next AS dst", "w")).count() == 0


def test_blocks_in_a_row():
    x = np.random.default_rng(0).normal(size=17)
    for length in (1, 3, 4, 17):
        rng, draws = np.random.default_rng(42), 500
        parts = [length] * (17 // length) + ([17 % length] if 17 % length else [])
        starts = [rng.integers(0, 17 - length + 1, draws) for _ in parts]
        want = [np.mean([x[s[d] + k] for s, n in zip(starts, parts) for k in range(n)]) for d in range(draws)]
        assert np.allclose(stats.block_means(x, length, draws), want)


@pytest.mark.parametrize("name", ["a09_describe", "a24_quantile_summary", "a29_percentile_band", "m12_quantile_bins", "j19_neighbour_expansion"])
def test_at_the_larger_size(spark, name):
    assert oracle.differ(spark, "/root/testdata/sf0.01", registry.queries()[name], registry.oracle_sql()[name]) is None
