"""Radii and vectors of blocks that are iterated on, against dense ones."""

import numpy as np
import pytest

from weftline.operators import spectral


def _graph(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w double")


def _plain(rows):
    names = sorted({n for a, b, _ in rows for n in (a, b)})
    a = np.zeros((len(names),) * 2)
    for s, d, w in rows:
        a[names.index(s), names.index(d)] += w
    return names, a


def _cycle(first, weights):
    return [(first + k, first + (k + 1) % len(weights), float(w)) for k, w in enumerate(weights)]


def test_all_blocks_side_by_side(spark):
    """Periodic, hub-like, random and loop blocks at once: radii, bounds and vectors."""
    rng = np.random.default_rng(5)
    hub = [(100, 100 + k, float(k)) for k in range(1, 25)] + [(100 + k, 100, 1.0) for k in range(1, 25)]
    many = [(200 + int(a), 200 + int(b), float(w)) for a, b, w in rng.integers(0, 40, (300, 3)) if w > 0] + _cycle(200, [1.0] * 40)
    blocks = {0: _cycle(0, (2.0, 8.0)), 10: _cycle(10, (1.0, 5.0, 25.0)), 100: hub, 200: many, 300: [(300, 300, 3.0)]}
    rows = [(c, *r) for c, block in blocks.items() for r in block]
    radii, masses = spectral.perron(spark.createDataFrame(rows, "component long, src long, dst long, w double"))
    got, mass = {r.component: r for r in radii.collect()}, {(r.component, r.node): r.mass for r in masses.collect()}
    assert set(got) == set(blocks)
    for c, block in blocks.items():
        names, a = _plain(block)
        values, vectors = np.linalg.eig(a)
        radius, top = np.abs(values).max(), np.abs(vectors[:, np.argmax(values.real)].real)
        assert got[c].radius == pytest.approx(radius, rel=1e-9)
        assert got[c].lo <= radius * (1 + 1e-9) and got[c].hi >= radius * (1 - 1e-9)
        assert np.allclose([mass[c, n] for n in names], top / top.sum(), atol=1e-9)


def test_both_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = _graph(spark, [(int(a), int(b), 1.0 + int(a) % 3) for a, b in rng.integers(0, 12, (60, 2))] + _cycle(0, [1.0] * 12) + [(3, 50, 7.0), (50, 51, 1.0), (51, 50, 1.0)])
    dense = {r.node: r.mass for r in spectral.dominant_vector(edges).collect()}
    monkeypatch.setattr(spectral, "DENSE", 2)
    got = {r.node: r.mass for r in spectral.dominant_vector(edges).collect()}
    assert set(got) == set(dense) == set(range(12)) and np.allclose([got[k] for k in dense], list(dense.values()), atol=1e-9)


def test_bounds_of_a_block_that_mixes_slowly(spark):
    """A cycle of uneven weights doesn't settle in two rounds; the bounds hold its radius."""
    weights = np.linspace(1, 9, 30)
    rows = [(0, *r) for r in _cycle(0, weights)]
    radii, masses = spectral.perron(spark.createDataFrame(rows, "component long, src long, dst long, w double"), rounds=2)
    r = radii.first()
    true = np.exp(np.log(weights).mean())
    assert r.lo < true < r.hi and r.lo <= r.radius <= r.hi and masses.count() == 30


def test_empty_graphs(spark):
    none = _graph(spark, [(1, 2, 1.0), (3, 3, 0.0)])
    assert spectral.spectral_radius(none).count() == 0 and spectral.dominant_vector(none).count() == 0
