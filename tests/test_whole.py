"""Queries over all rows and from all seeds, against brute force."""

import collections

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from weftline.operators import arrival, paths, stats
from weftline.plans import registry
from weftline.plans.sql import view

QUERIES = registry.queries()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def reach(after, seed):
    """Nodes that paths of one edge or more lead to."""
    seen, front = set(), [seed]
    while front:
        front = [y for x in front for y in after.get(x, ()) if y not in seen and not seen.add(y)]
    return seen


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return {(r.o_custkey, r.o_orderkey % 500) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey").collect()}


def test_order_graph(spark, sf_dir, orders):
    after, both = collections.defaultdict(set), collections.defaultdict(set)
    for a, b in orders:
        after[a].add(b)
        both[a].add(b)
        both[b].add(a)
    to = {x: reach(after, x) for x in both}
    weak = {x: min(reach(both, x)) for x in both}
    strong = {x: min([x, *(y for y in to[x] if x in to[y])]) for x in both}
    run = lambda name: rows(QUERIES[name](spark, sf_dir))
    assert run("g08_weak_components") == sorted(weak.items())
    sizes = collections.Counter(weak.values())
    assert run("g09_largest_component") == [min(sizes.items(), key=lambda x: (-x[1], x[0]))]
    assert run("g36_component_sizes") == sorted(collections.Counter(sizes.values()).items())
    assert run("g11_connectivity") == [(len(sizes) == 1, len(sizes))]
    assert run("g10_strong_components") == sorted(strong.items())
    core = max(collections.Counter(strong.values()).items(), key=lambda x: (x[1], x[0]))[0]
    region = {x: "core" if strong[x] == core else "in" if core in to[x] else "out" if x in to[core] else "other" for x in both}
    assert run("g17_bow_tie") == sorted(region.items())
    assert run("g18_descendants") == sorted((s, len(to[s] - {s})) for s in {a for a, _ in orders} if to[s] - {s})


def arrivals(events, seed, start):
    """Least times by Bellman-Ford over all events."""
    best, changed = {seed: start}, True
    while changed:
        changed = False
        for a, b, t in events:
            if a in best and best[a] <= t < best.get(b, 1 << 62):
                best[b], changed = t, True
    return {b: t for b, t in best.items() if b != seed}


def test_arrival_from_all_seeds(spark, sf_dir):
    ix = view(spark, sf_dir, "ix").select("src", "dst", F.unix_seconds(F.col("ts").cast("timestamp")))
    events = sorted((tuple(r) for r in ix.collect()), key=lambda r: r[2])
    after = collections.defaultdict(set)
    for a, b, _ in events:
        after[a].add(b)
    first = events[0][2]
    assert rows(QUERIES["t14_earliest_arrival"](spark, sf_dir)) == sorted((s, b, t) for s in after for b, t in arrivals(events, s, 1704672000).items())
    ratios = {r.seed: r.ratio for r in QUERIES["t15_reach_ratio"](spark, sf_dir).collect()}
    assert set(ratios) == set(after)
    for s in after:
        n = len(reach(after, s) - {s})
        assert ratios[s] == (len(arrivals(events, s, first)) / n if n else None)


@pytest.mark.parametrize("block, slab", [(3, 7), (100, 10**6)])
def test_arrival_by_blocks_and_slabs(spark, block, slab):
    """Ties in time, seeds that start late or twice, and many slabs, against brute force."""
    rng = np.random.default_rng(8)
    events = [(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), rng.integers(0, 25, 60))]
    seeds = [(k, int(rng.integers(0, 20))) for k in range(10)] + [(3, 30), (40, 0), (None, 1)]
    first = {}
    for k, t in seeds:
        first[k] = min(t, first.get(k, t))
    got = paths.earliest_arrival(spark.createDataFrame(events + [(None, 1, 1)], "src long, dst long, at long"), spark.createDataFrame(seeds, "seed long, start long"), block, slab)
    assert rows(got) == sorted((k, b, t) for k, start in first.items() if k is not None for b, t in arrivals(events, k, start).items())
    assert paths.earliest_arrival(spark.createDataFrame([], "src long, dst long, at long"), spark.createDataFrame(seeds, "seed long, start long")).count() == 0


def fewest_hops(events, seed, times):
    """By levels over the events that come at their target's own time."""
    times, hops, level = {**times, seed: min(times.values(), default=0) - 1}, {seed: 0}, 0
    while True:
        level += 1
        new = {b for a, b, t in events if a in hops and hops[a] < level and times.get(b) == t and times[a] <= t and b not in hops}
        if not new:
            return {b: h for b, h in hops.items() if b != seed}
        hops |= dict.fromkeys(new, level)


@pytest.mark.parametrize("block, size", [(3, 6), (100, 10**6)])
def test_arrival_with_hops(spark, block, size):
    """Nodes split over buckets, many rounds, events of one instant in chains and circles."""
    rng = np.random.default_rng(9)
    events = [(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, 14, 80) * rng.integers(0, 2, 80), rng.integers(0, 14, 80), rng.integers(0, 9, 80))]
    seeds = [(k, int(rng.integers(0, 4))) for k in range(14)]
    want = []
    for k, start in seeds:
        times = arrivals(events, k, start)
        hops = fewest_hops(events, k, times)
        want += [(k, b, t, hops[b]) for b, t in times.items()]
    got = arrival.arrivals(spark.createDataFrame(events, "src long, dst long, at long"), spark.createDataFrame(seeds, "seed long, start long"), block, size)
    assert len(want) > 60 and max(r[3] for r in want) > 3 and rows(got) == sorted(want)


@pytest.mark.parametrize("block, size", [(3, 6), (100, 10**6)])
def test_reach_sizes(spark, block, size):
    """In any order and in that of time, over small buckets and large ones, from seeds without events too."""
    rng = np.random.default_rng(7)
    events = [(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, 20, 40), rng.integers(0, 20, 40), rng.integers(0, 9, 40))]
    after = collections.defaultdict(set)
    for a, b, _ in events:
        after[a].add(b)
    seeds = [*range(20), 77]
    df = spark.createDataFrame(events, "src long, dst long, at long")
    got = arrival.reach_sizes(df.drop("at"), spark.createDataFrame([(k,) for k in seeds], "seed long"), block, size)
    assert rows(got) == [(k, len(reach(after, k) - {k}) if k in after else 0) for k in seeds]
    got = arrival.reach_sizes(df, spark.createDataFrame([(k, 2) for k in seeds], "seed long, start long"), block, size)
    assert rows(got) == [(k, len(arrivals(events, k, 2))) for k in seeds]


def test_all_seeds_and_users(spark, sf_dir):
    for whole, of in (("j19_neighbour_expansion", "pairs"), ("t16_unique_seeds", "pairs"), ("st08_holm", "post")):
        key = "u" if of == "post" else "src"
        n = QUERIES[whole](spark, sf_dir).select("u" if of == "post" else "seed").distinct().count()
        every = view(spark, sf_dir, of)
        if whole == "j19_neighbour_expansion":
            every = every.join(every.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        assert n == every.select(key).distinct().count()
        assert oracle.differ(spark, sf_dir, QUERIES[whole], registry.oracle_sql()[whole]) is None


@pytest.mark.parametrize("name, fn, draws", [("st02_bootstrap", "bootstrap", 2000), ("st10_permutation", "permutation_test", 2000), ("st11_uncentred_permutation", "permutation_test", 500)])
def test_draws_of_the_reference(spark, sf_dir, monkeypatch, name, fn, draws):
    seen, plain = [], getattr(stats, fn)
    monkeypatch.setattr(stats, fn, lambda *a, **k: seen.append(k["draws"]) or plain(*a, **k))
    assert QUERIES[name](spark, sf_dir).count() > 0 and seen == [draws]
