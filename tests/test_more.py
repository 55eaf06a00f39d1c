"""Operators that SQL has no twin for, against plain recomputation."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import metrics, models, neural, spectral, stats
from weftline.plans import more, registry
from weftline.plans.sql import view

QUERIES = registry.queries()


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_sign_flip_is_exact(n):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=n), np.ones(n), np.zeros(n), rng.integers(-2, 3, n).astype(float)):
        sums = [abs(sum(s * v for s, v in zip(signs, x))) for signs in itertools.product((-1, 1), repeat=n)]
        assert stats.sign_flip(list(x)) == pytest.approx(np.mean([s >= abs(x.sum()) - 1e-12 for s in sums]))


def test_students_quantiles():
    known = {(0.975, 1): 12.706204736, (0.975, 4): 2.776445105, (0.975, 19): 2.093024054, (0.95, 30): 1.697260887, (0.995, 200): 2.600634436}
    for (p, df), t in known.items():
        assert stats.t_quantile(p, df) == pytest.approx(t, abs=1e-6)


def test_permutations_shuffle_within_strata(spark):
    rng = np.random.default_rng(1)
    rows = [(int(s), float(x), float(x + rng.normal() * 0.1)) for s in range(3) for x in rng.normal(size=20)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, s int, x double, y double")
    got = stats.permutation_test(df, "x", "y", "k", stratum="s", draws=300).first()
    frame = pd.DataFrame(rows, columns=["s", "x", "y"])
    assert got.observed == pytest.approx(frame["x"].rank().corr(frame["y"].rank())) and got.p == pytest.approx(1 / 301)
    # one row a stratum: nothing can move, so every draw equals what is observed
    fixed = spark.createDataFrame([(1, k, float(k), float(k * k % 7)) for k in range(12)], "k int, s int, x double, y double")
    assert stats.permutation_test(fixed, "x", "y", "k", stratum="s", draws=50).first().null_sd == pytest.approx(0, abs=1e-12)
    constant = spark.createDataFrame([(1, 1.0, float(k)) for k in range(5)], "k int, x double, y double")
    assert stats.permutation_test(constant, "x", "y", "k", draws=10).first().p is None


def test_joint_bootstrap(spark):
    rows = [(1, s, w, float(s * 10 + w)) for s in range(6) for w in range(5) if (s, w) != (2, 3)]
    got = stats.joint_bootstrap(spark.createDataFrame(rows, "k int, s int, w int, v double"), "v", "s", "w", "k", draws=4000).first()
    values = {(s, w): v for _, s, w, v in rows}
    rng = np.random.default_rng(0)
    means = []
    for _ in range(4000):
        cells = [values[s, w] for s in rng.integers(0, 6, 6) for w in rng.integers(0, 5, 5) if (s, w) in values]
        means.append(np.mean(cells))
    assert got.mean == pytest.approx(np.mean(list(values.values())))
    # drawing weeks anew for each seed, as here, spreads no wider than one draw of weeks for all
    assert got.lo == pytest.approx(np.quantile(means, 0.025), abs=2.5) and got.hi == pytest.approx(np.quantile(means, 0.975), abs=2.5)


def test_replay_finds_changes(spark):
    rows = [(m, y, p) for m in range(3) for y, p in ((1, 0.9), (0, 0.2), (1, 0.4), (0, 0.7))]
    predictions = spark.createDataFrame(rows, "m int, y int, p double")
    saved = metrics.scores(metrics.confusion(predictions, "m"), "m")
    assert {r.replayed for r in metrics.replayed(saved, predictions, "m").collect()} == {True}
    changed = predictions.where("m <> 2").unionByName(spark.createDataFrame([(2, 1, 0.1)], "m int, y int, p double"))
    assert {r.m: r.replayed for r in metrics.replayed(saved, changed, "m").collect()} == {0: True, 1: True, 2: False}
    assert {r.m: r.replayed for r in metrics.replayed(saved.where("m < 2"), predictions, "m").collect()} == {0: True, 1: True, 2: False}


def test_edge_contributions_follow_the_dominant_vector(spark, sf_dir):
    edges = view(spark, sf_dir, "pairs").toPandas()
    got = more.g33(spark, sf_dir).toPandas()
    names = sorted(set(got["src"]) | set(got["dst"]))
    vector = {r.node: r.mass for r in spectral.dominant_vector(view(spark, sf_dir, "pairs")).collect()}
    own = edges[edges["src"].isin(vector) & edges["dst"].isin(vector)]
    a = pd.crosstab(own["src"], own["dst"], own["w"], aggfunc="sum").reindex(index=sorted(vector), columns=sorted(vector)).fillna(0).to_numpy()
    values, vectors = np.linalg.eig(a)
    top = np.abs(vectors[:, np.argmax(values.real)].real)
    assert np.allclose(top / top.sum(), [vector[k] for k in sorted(vector)], atol=1e-9) and names
    want = edges[edges["dst"].isin(vector)]
    assert len(got) == len(want) and np.allclose(sorted(got["contribution"]), sorted(want["w"] * want["dst"].map(vector)))


@pytest.mark.parametrize("model", neural.MODELS)
def test_gradients_of_graph_models(model):
    """Recorded gradients against differences, for every weight of every model."""
    rng = np.random.default_rng(3)
    n, features = 6, [rng.normal(size=(6, 2)) for _ in range(3)]
    graphs = [(rng.integers(0, n, 9), rng.integers(0, n, 9), rng.uniform(0.5, 2, 9)) for _ in range(3)]
    w = neural.model_weights(model, rng, 2)
    c = rng.normal(size=(n, 1))

    def loss() -> float:
        return float((neural.model_outputs(model, w, features, graphs, n)[-1].data * c).sum())

    neural.model_outputs(model, w, features, graphs, n)[-1].backward(c.copy())
    for v in w.values():
        grad = v.grad
        for at in list(np.ndindex(v.data.shape))[:4]:
            kept = v.data[at]
            v.data[at] = kept + 1e-6
            up = loss()
            v.data[at] = kept - 1e-6
            down = loss()
            v.data[at] = kept
            assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_graph_models_see_the_past_only(spark):
    """A node's label is its neighbour's feature of the period before: message passing learns it, nothing else can."""
    rng = np.random.default_rng(2)
    n, periods = 60, 6
    x = rng.choice([-1.0, 1.0], (periods, n))
    rows, edges = [], []
    for t in range(periods):
        for k in range(n):
            rows.append((t, k, float(x[t, k]), int(x[t - 1, (k + 1) % n] > 0) if t else 0))
            edges.append((t, (k + 1) % n, k, 1.0))
    r = spark.createDataFrame(rows, "t int, node long, x double, y int")
    got = neural.train_graph_models(r, spark.createDataFrame(edges, "t int, src long, dst long, w double"), "t", "node", ["x"], "y", models=("sage", "aligned_gru")).toPandas()
    hits = got.assign(hit=(got["p1"] > 0.5) == (got["y"] == 1)).groupby("model")["hit"].mean()
    assert set(got["period"]) == {periods - 1} and len(got) == 2 * n
    assert hits["sage"] > 0.9 > 0.75 > hits["aligned_gru"]


def test_sequences_learn_the_last_label(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        s = rng.integers(0, 2, int(rng.integers(1, 6))).astype(float).tolist()
        rows.append((0, k, int(s[-1]), s, "train" if k < 160 else "validation" if k < 200 else "test"))
    got = neural.train_sequences(spark.createDataFrame(rows, "job int, row long, y int, before array<double>, part string"), "before", "y", "part", "job").toPandas()
    assert len(got) == 40 and ((got["p1"] > 0.5) == (got["y"] == 1)).mean() > 0.9


def test_resumed_runs_only_what_is_missing(spark, tmp_path):
    seen = []
    rows = spark.createDataFrame([(j, r) for j in range(4) for r in range(3)], "job int, row int")

    def run(some):
        seen.append({r.job for r in some.select("job").distinct().collect()})
        return some.withColumn("result", some["job"] * 2)

    path = f"file://{tmp_path}/jobs"
    assert models.resumed(rows.where("job = 1"), run, path, "job") == 1
    (tmp_path / "jobs" / "part=cut-off").mkdir()  # a run that didn't end leaves no marker
    assert models.resumed(rows, run, path, "job") == 3 and models.resumed(rows, run, path, "job") == 0
    assert seen == [{1}, {0, 2, 3}] and spark.read.parquet(f"{path}/*").count() == 12


def test_directions_share_their_draws(spark, sf_dir):
    got = more.x11(spark, sf_dir, runs=3).collect()
    assert len(got) == len(more.CONFIGURATIONS) * len(more.DIRECTIONS) and {r.runs for r in got} == {3}
    assert {r.contrast for r in got if r.direction == "recorded"} == {0.0}


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_running_sums_over_many_ranges(spark, keys):
    """Against numpy; a key that is null and nulls to sum; no window without a partition in the plan."""
    from weftline.operators import scan

    rng = np.random.default_rng(4)
    rows = [(None if g == 0 else int(g), int(v), None if x < 3 else int(x)) for g, v, x in zip(rng.integers(0, 3, 400), rng.permutation(400), rng.integers(0, 30, 400))]
    df = spark.createDataFrame(rows, "g long, v long, x long").repartition(7)
    got = scan.running(df, [F.desc("v")], {"n": F.lit(1), "sum": F.col("x")}, *keys)
    want, total = [], {}
    for g, v, x in sorted(rows, key=lambda r: -r[1]):
        n, s = total.get(g if keys else 0, (0, 0))
        total[g if keys else 0] = n + 1, s + (x or 0)
        want.append((g, v, x, n + 1, s + (x or 0)))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
    assert scan.running(df.where("v < 0"), [F.col("v")], {"n": F.lit(1)}, *keys).count() == 0
