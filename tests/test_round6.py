"""Findings of the third review that were open after three rounds of changes, each by a case that failed before."""

import numpy as np
import pytest

from weftline.operators import paths, simulate, spectral
from weftline.plans import more


def _grid(spark, runs):
    cells = spark.createDataFrame([("a", 1.0, 1.0, 0.25, runs), ("b", 1.5, 0.5, 0.1, 2)], "cell string, beta_0 double, beta_1 double, gamma double, runs int")
    return cells


@pytest.mark.parametrize("small", [0, 1000])
def test_cells_of_unequal_runs_are_one_simulation(spark, small):
    """x10 went twice over the graph, as a simulation had one number of runs."""
    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b), 2) for a, b in rng.integers(0, 40, (200, 2))})
    edges = spark.createDataFrame(pairs, "src long, dst long, w long")
    one = simulate.simulate(edges, _grid(spark, 5), seeds=2, steps=6, small=small).collect()
    apart = [r for cell, runs in (("a", 5), ("b", 2)) for r in simulate.simulate(edges, _grid(spark, 5).drop("runs").where(f"cell = '{cell}'"), runs, seeds=2, steps=6, small=1000).collect()]
    assert sorted(map(str, one)) == sorted(map(str, apart)) and len(one) == 7


def test_named_experiments_simulate_once(spark, sf_dir, monkeypatch):
    asked, plain = [], simulate.simulate
    monkeypatch.setattr(simulate, "simulate", lambda *a, **k: asked.append(1) or plain(*a, **k))
    rows = {r["cell"]: r["n"] for r in more.x10(spark, sf_dir).collect()}
    assert len(asked) == 1 and rows["balanced"] == 30 and rows["slow_recovery"] == 10


def test_bow_ties_take_no_round_for_each_hop(spark, monkeypatch):
    """A path of so many nodes before and after each core took so many rounds."""
    monkeypatch.setattr(paths, "reachable", lambda *a, **k: pytest.fail("hop by hop"))
    edges = [(k, k + 1) for k in range(40)] + [(20, 19), (50, 20)] + [(100 + k, 101 + k) for k in range(30)] + [(129, 128), (110, 110), (140, 141)]
    df = spark.createDataFrame(edges, "src long, dst long")
    strong = paths.strong_components(df).selectExpr("node", "component", "node >= 100 AS key")
    got = {r["node"]: r["region"] for r in paths.bow_tie_by(df, strong, "key").collect()}
    want = {k: "in" if k < 19 else "core" if k < 21 else "out" for k in range(41)} | {50: "in", 140: "other", 141: "other"}
    assert got == want | {100 + k: "in" if k < 28 else "core" if k < 30 else "out" for k in range(31)}


def test_a_transpose_shares_its_components(spark, monkeypatch):
    """Components were looked for twice, and both directions were iterated on one after the other."""
    monkeypatch.setattr(spectral, "DENSE", 4)
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b), int(w)) for a, b, w in rng.integers(1, 9, (40, 3))] + [(k + 20, (k + 1) % 3 + 20, k + 1) for k in range(3)]
    df = spark.createDataFrame(edges, "src long, dst long, w long").groupBy("src", "dst").sum("w").withColumnRenamed("sum(w)", "w")
    searched, iterated, strong, perron = [], [], spectral.strong_components, spectral.perron
    monkeypatch.setattr(spectral, "strong_components", lambda *a: searched.append(1) or strong(*a))
    monkeypatch.setattr(spectral, "perron", lambda *a: iterated.append(1) or perron(*a))
    got = {r["component"]: (r["radius"], r["other"]) for r in spectral.both_radii(df).collect()}
    assert len(searched) == len(iterated) == 1
    want = {r["component"]: r["radius"] for r in spectral.spectral_radius(df).collect()}
    assert sorted(got) == sorted(want) == [1, 20]
    for c, pair in got.items():
        assert pair == pytest.approx((want[c], want[c]), rel=1e-9)


def test_a_dominant_vector_is_iterated_once(spark, monkeypatch):
    """The block with the greatest radius was iterated on a second time, for its vector."""
    monkeypatch.setattr(spectral, "DENSE", 2)
    edges = [(0, 1, 2.0), (1, 2, 1.0), (2, 0, 3.0), (1, 0, 1.0), (7, 8, 0.5), (8, 7, 0.5)]
    iterated, perron = [], spectral.perron
    monkeypatch.setattr(spectral, "perron", lambda *a: iterated.append(1) or perron(*a))
    got = {r["node"]: r["mass"] for r in spectral.dominant_vector(spark.createDataFrame(edges, "src long, dst long, w double")).collect()}
    a = np.zeros((3, 3))
    for i, j, w in edges[:4]:
        a[i, j] = w
    values, vectors = np.linalg.eig(a)
    top = np.abs(vectors[:, np.argmax(values.real)].real)
    assert len(iterated) == 1 and [got[k] for k in range(3)] == pytest.approx(top / top.sum(), abs=1e-9)
