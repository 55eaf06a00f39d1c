"""Findings of the third review, each by a case that failed before."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.llm import repeats
from weftline.operators import neural, simulate
from weftline.plans import registry
from weftline.session import cut, discard


def test_functions_sent_out_carry_no_session(spark, sf_dir):
    """Modules are sent by value, so none may hold a session once a table was cut."""
    table = cut(spark.range(3))
    assert registry.queries()["st06_block_bootstrap"](spark, sf_dir).count() == 5
    import weftline.operators.stats as whole

    assert spark.range(2).select(F.udf(lambda x: len(whole.__name__), "int")("id").alias("n")).distinct().count() == 1
    discard(table)


@pytest.mark.parametrize("independent, normalisation", [(False, "max"), (True, "log")])
def test_spreading_over_tables_gives_the_same_runs(spark, monkeypatch, independent, normalisation):
    """Graphs of any size: before, more than a bound were refused, and all of a graph went through the driver."""
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (400, 2))} | {(99, 3)}
    edges = spark.createDataFrame([(a * 7, b * 7, int(rng.integers(1, 5))) for a, b in sorted(pairs)], "src long, dst long, w long")
    grid = spark.createDataFrame([("a", 1.0, 1.0, 0.25), ("b", 1.5, 0.0, 0.0), ("c", 0.0, 0.0, 0.5)], "cell string, beta_0 double, beta_1 double, gamma double")
    monkeypatch.setattr(simulate, "BUCKET", 150)
    monkeypatch.setattr(simulate, "LANES", 4)
    run = lambda small: sorted(map(str, simulate.simulate(edges, grid, 3, seeds=2, normalisation=normalisation, independent=independent, steps=6, small=small).collect()))
    whole = run(10_000)
    assert len(whole) == 9 and run(0) == whole


def test_keyed_draws_of_many_runs_are_those_of_each():
    ids, runs = np.arange(40), np.arange(40) % 7
    want = [simulate.keyed_uniform(ids[i : i + 1], int(runs[i]), 3, 1)[0] for i in range(40)]
    assert np.array_equal(simulate.keyed_uniform(ids, runs, 3, 1), want)


def plain_fit(w, forward, y, part):
    """Probabilities of all rows at once in one place: weighted cross-entropy on part 0 by Adam, stopped by that of part 1."""
    train, check = part == 0, part == 1 if (part == 1).any() else part == 0
    ones = y[train].mean() if train.any() else 0.5
    weight = np.where(y == 1, 0.5 / max(ones, 1e-9), 0.5 / max(1 - ones, 1e-9))
    first, second = ({k: np.zeros_like(v.data) for k, v in w.items()} for _ in range(2))
    best, kept, bad = np.inf, {k: v.data.copy() for k, v in w.items()}, 0
    for t in range(1, neural.EPOCHS + 1):
        out = forward(w)
        p = 1 / (1 + np.exp(-np.clip(out.data[:, 0], -30, 30)))
        loss = -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))[check].mean() if check.any() else 0.0
        if loss < best - 1e-6:
            best, kept, bad = loss, {k: v.data.copy() for k, v in w.items()}, 0
        else:
            bad += 1
            if bad > neural.PATIENCE:
                break
        out.backward(((p - y) * weight * train / max(train.sum(), 1))[:, None])
        for k, v in w.items():
            g = (v.grad if v.grad is not None else 0) + neural.DECAY * v.data
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            v.data = v.data - neural.RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    for k, v in w.items():
        v.data = kept[k]
    return 1 / (1 + np.exp(-np.clip(forward(w).data[:, 0], -30, 30)))


def test_sequences_are_trained_a_few_rows_at_a_time(spark, monkeypatch):
    """A job's rows lie in many tasks, some at a time; what comes out is what one pass over all rows gives."""
    monkeypatch.setattr(neural, "CHUNK", 7)
    rng = np.random.default_rng(8)
    rows = [(k % 2, k, int(rng.integers(0, 2)), rng.integers(0, 2, k % 5).astype(float).tolist(), ("train", "validation", "test")[k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "job int, row long, y int, before array<double>, part string")
    got = neural.train_sequences(df, "before", "y", "part", "job").toPandas().set_index("row")["p1"]
    for job in (0, 1):
        own = [r for r in rows if r[0] == job]
        lists = np.array([len(r[3]) for r in own]), np.array([v for r in own for v in r[3]])
        rng = np.random.default_rng(0)
        w = neural.gru_weights(rng, 2) | neural.weights(rng, o=(neural.HIDDEN, 1), bo=(1, 1))
        p = plain_fit(w, lambda w: neural._sequence_logits(w, lists, lists), np.array([r[2] for r in own], float), np.array([neural.PARTS[r[4]] for r in own]))
        assert all(got[r[1]] == pytest.approx(x, abs=1e-9) for r, x in zip(own, p) if r[4] == "test")


def test_graph_models_over_rows_are_those_over_graphs(spark, monkeypatch):
    """Every model against its form that holds all periods' graphs; some nodes have no features, some no edges."""
    monkeypatch.setattr(neural, "CHUNK", 5)
    rng = np.random.default_rng(4)
    n, periods = 9, 6
    rows = [(t, k, float(rng.normal()), float(rng.normal()), int(rng.integers(0, 2))) for t in range(periods) for k in range(n) if (t + k) % 4]
    edges = sorted({(int(t), int(a), int(b)) for t, a, b in zip(rng.integers(0, periods, 60), rng.integers(0, n, 60), rng.integers(0, n - 1, 60))})
    edges = [(*e, float(rng.uniform(0.5, 3))) for e in edges]
    got = neural.train_graph_models(spark.createDataFrame(rows, "t int, node long, a double, b double, y int"), spark.createDataFrame(edges, "t int, src long, dst long, w double"), "t", "node", ["a", "b"], "y").toPandas()
    own, links = pd.DataFrame(rows, columns=["t", "node", "a", "b", "y"]), pd.DataFrame(edges, columns=["t", "src", "dst", "w"])
    past = own[own["t"] < periods - 2][["a", "b"]]
    features, graphs, labels = [], [], []
    for t in range(periods - 1):
        x, r, e, later = np.zeros((n, 2)), own[own["t"] == t], links[links["t"] == t], own[own["t"] == t + 1]
        x[r["node"]] = (r[["a", "b"]] - past.mean()) / past.std(ddof=0)
        features.append(x)
        graphs.append((e["src"].to_numpy(), e["dst"].to_numpy(), e["w"].to_numpy()))
        labels.append((later["node"].to_numpy(), later["y"].to_numpy(float)))
    part = np.concatenate([np.full(len(i), max(0, t - periods + 4)) for t, (i, _) in enumerate(labels)])
    for model in neural.MODELS:

        def forward(w):
            some = [out.rows(i) for out, (i, _) in zip(neural.model_outputs(model, w, features, graphs, n), labels)]
            ends = np.cumsum([len(v.data) for v in some])[:-1]
            return neural.Value(np.concatenate([v.data for v in some]), tuple(some), lambda g: tuple(np.split(g, ends)))

        p = plain_fit(neural.model_weights(model, np.random.default_rng(0), 2), forward, np.concatenate([v for _, v in labels]), part)
        want = dict(zip(labels[-1][0], p[part == 2]))
        mine = got[got["model"] == model].set_index("node")["p1"]
        assert set(mine.index) == set(want) and all(mine[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


@pytest.mark.parametrize("copies", [5, 40])
def test_windows_of_near_copies_are_as_many_as_their_bytes(copies):
    """Runs split a text's windows, so what is exploded is linear in the distinct texts (no change of code; holds what the reply says)."""
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 1500, dtype=np.uint8)
    total = 0
    for k in range(copies):
        text = body.copy()
        text[k * 7] = 65
        first, last, *_ = repeats.runs(text)
        assert first[0] == 0 and np.array_equal(first[1:], last[:-1] + 1)
        total += int((last - first + 1).sum())
    assert total == copies * (1500 - repeats.LENGTH + 1)
