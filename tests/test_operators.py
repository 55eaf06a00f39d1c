"""Small cases with known answers."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import bins, checks, text
from weftline.operators import graph, metrics, models, panel, paths, simulate, spectral, stats
from weftline.operators.components import connected_components
from weftline.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_arrival_follows_time(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (3, 4, 4)], "src long, dst long, at long")
    seed = spark.createDataFrame([(1, 0)], "seed long, start long")
    assert rows(paths.earliest_arrival(e, seed)) == [(1, 2, 5), (1, 3, 5)]
    e = spark.createDataFrame([(1, 2, 1), (1, 3, 7), (2, 4, 2), (3, 4, 8)], "src long, dst long, at long")
    assert (1, 4, 2) in rows(paths.earliest_arrival(e, seed))
    assert rows(paths.earliest_arrival(spark.createDataFrame([(1, 1, 0)], "src long, dst long, at long"), seed)) == []


@pytest.mark.parametrize("n, m", [(30, 40), (60, 70), (12, 30)])
def test_components_of_random_graphs(spark, n, m):
    rng = np.random.default_rng(n)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(rows(connected_components(spark.createDataFrame(pairs, "a long, b long"))))
    ends = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: label[x] for x in ends}
    reach = np.eye(n, dtype=bool)
    for a, b in pairs:
        reach[a, b] = True
    for k in range(n):
        reach |= reach[:, [k]] & reach[[k], :]
    strong = {x: min(y for y in range(n) if reach[x, y] and reach[y, x]) for p in pairs for x in p}
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert dict(rows(paths.strong_components(edges))) == strong
    if n == 12:  # several rounds and buckets
        assert dict(rows(paths.strong_components(edges, pivots=4, size=12))) == strong


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, None), (2, 2)], "a long, b long")).count() == 0


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (1, 4, 3.0)], "src long, dst long, w double")
    got = paths.pagerank(e, rounds=200, tolerance=1e-9)
    assert abs(got.agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_handles(spark):
    df = spark.createDataFrame([(" @@AbC ",), (" @AbC ",)], "h string")
    assert [r[0] for r in df.select(text.handle_one(F.col("h"))).collect()] == ["@abc", "abc"]
    assert [r[0] for r in df.select(text.handle_all(F.col("h"))).collect()] == ["abc", "abc"]
    posts = spark.createDataFrame([(1, "RT @ann: hi @bob @ann x@mail.test @toolonghandle123456"), (2, "@cat hello @cat @dan"), (3, None)], "id long, text string")
    assert rows(text.interactions(posts).select("id", "target", "kind")) == [(1, "ann", "retweet"), (1, "bob", "mention"), (2, "cat", "reply_inferred"), (2, "dan", "mention")]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.pearson("x", "y")).first()[0] is None


def test_holm_and_sign_flip(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = {r.p: r.holm_p for r in stats.holm(df, "p").collect()}
    assert got[None] is None and [round(got[p], 9) for p in (0.01, 0.03, 0.04)] == [0.03, 0.06, 0.06]
    assert stats.sign_flip([1.0] * 5) == 2 / 32


def test_wilson_edges(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in spark.createDataFrame([(0, 0), (5, 5)], "k long, n long").select(lo, hi).collect()]
    assert got[0] == (None, None) and got[1][1] == 1.0


def test_history_is_strict(spark):
    d = datetime.date
    df = spark.createDataFrame([("a", d(2024, 1, 1), 1), ("a", d(2024, 2, 1), None), ("a", d(2024, 3, 1), 0)], "u string, m date, y int")
    got = {r.m.month: r for r in panel.history(df, "u", "m", "y").collect()}
    assert not got[1].previous_available and got[2].previous_label == 1 and got[3].previous_label == 1
    assert got[3].past_count == 1 and got[3].periods_since == 2


def test_asof_ties(spark):
    left = spark.createDataFrame([("a", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 3, 2)], "k string, t long, v long")
    assert rows(panel.asof(left, right, "k", "t", ["v"])) == [("a", 5, 2, 3)]
    assert rows(panel.asof(left, right, "k", "t", ["v"], strict=False)) == [("a", 5, 1, 5)]


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, p double")
    got = metrics.scores(metrics.confusion(df)).first()
    assert got.balanced_accuracy is None and got.mcc is None and got.macro_f1 is not None
    assert metrics.roc_auc(df).first().roc_auc is None


def test_keyed_draws_differ():
    a, b = simulate.keyed_uniform(np.arange(50), 1, 0, 0), simulate.keyed_uniform(np.arange(30, 80), 0, 1, 0)
    assert ((0 <= a) & (a < 1)).all() and not np.array_equal(a, b)


def test_certain_competition():
    g = simulate.Graph(np.array([0, 1]), np.array([2, 2]), np.array([1.0, 1.0]), 4)
    for independent in (False, True):
        got = simulate.compete(g, np.array([0]), np.array([1]), (1.0, 1.0), 0, independent=independent)
        assert (got["secondary_0"] + got["secondary_1"], got["exposed_both"], got["contests"]) == (1, 1, 1)
    none = simulate.compete(simulate.Graph(np.array([], int), np.array([], int), np.array([]), 4), np.array([0]), np.array([1]), (0.0, 0.0), 0)
    assert none["secondary_0"] == 0 and none["signed_secondary"] is None and none["outcome"] is None


def test_rewiring_keeps_strengths(spark):
    e = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (3, 1, 2), (1, 1, 1)], "src long, dst long, w long")
    a, b = (rows(graph.degrees(x).select("node", "in_strength", "out_strength")) for x in (e, graph.rewire(e)))
    assert a == b


def test_spectral_radius_of_a_cycle(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (2, 1, 2.0), (2, 3, 9.0)], "src long, dst long, w double")
    got = spectral.spectral_radius(e).collect()
    assert len(got) == 1 and abs(got[0].radius - 2) < 1e-9 and abs(got[0].beta_c - 0.125) < 1e-9


def test_logistic_gradient_vanishes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = models.logistic(df, ["a", "b"], "y", c=2.0).stages[-1]
    w, b = np.array(m.coefficients), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w / 2.0).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_mlp_gradients():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(6, 3)), np.array([0, 1, 1, 0, 1, 0.0]), np.ones(6)
    m = models.Mlp(3, 4, decay=0.0)
    g = m.gradients(x, y, w)[0]
    e = 1e-6
    m.w[0][1, 2] += e
    hi = m.loss(x, y, w)
    m.w[0][1, 2] -= 2 * e
    assert abs((hi - m.loss(x, y, w)) / (2 * e) - g[1, 2]) < 1e-5


def test_gru_ignores_padding():
    rng = np.random.default_rng(2)
    weights = {k + g: rng.normal(size=(2, 3) if k == "w" else (3, 3) if k == "u" else 3) for k in "wub" for g in "zrh"}
    x = rng.normal(size=(2, 4, 2))
    y = x.copy()
    y[0, 2:] = 99
    n = np.array([2, 0])
    assert np.allclose(models.gru(x, n, weights), models.gru(y, n, weights)) and not models.gru(x, n, weights)[1].any()


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,)], "x double")
    assert [r[0] for r in df.select(bins.equal_width(F.col("x"), 0, 1, 2)).collect()] == [0, 1, 1, None]
    assert [r[0] for r in df.select(bins.right_closed(F.col("x"), [0, 0.5, 1])).collect()] == [0, 0, 1, None]
    assert [r.x for r in bins.min_max(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").collect()] == [0.0, 0.0]


def test_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "a long, b long")
    with pytest.raises(ValueError):
        checks.assert_unique(df, ["a"])
    with pytest.raises(ValueError):
        checks.assert_schema(df, ["c"])
    with pytest.raises(ValueError):
        checks.assert_schema(df, ["a"], forbidden=("b",))


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", None, 1), ("y", 2.5, 2)], "name string, v double, week int")
    out = str(tmp_path / "csv")
    files.write_csv(df, out)
    assert rows(files.differing_rows(files.read_typed_csv(spark, out, "name string, v double, week int"), df)) == []
    with pytest.raises(Exception):
        files.write_csv(df, out)
    with pytest.raises(FileExistsError):
        files.refuse_existing(spark, [out])
    table = str(tmp_path / "table")
    files.write_table(df, table, ("week",))
    assert files.read_partition(spark, table, "week", 2).count() == 1
    before = files.manifest(spark, table, "*.parquet")
    saved = spark.createDataFrame(before.collect(), before.schema)
    assert files.read_verified(spark, table, saved).count() == 2
    wrong = saved.withColumn("sha256", F.lit("0"))
    with pytest.raises(ValueError):
        files.read_verified(spark, table, wrong)


def test_streams(spark, tmp_path):
    from weftline.streaming import weekly

    source = str(tmp_path / "in")
    d = datetime.datetime
    for k, day in enumerate((2, 9, 20)):
        spark.createDataFrame([(d(2024, 1, day), 1, 2, "view")], "ts timestamp, src long, dst long, kind string").coalesce(1).write.mode("append").parquet(source)
    stream = weekly.event_stream(spark, source, "ts timestamp, src long, dst long, kind string")
    q = weekly.monday_weeks(stream).writeStream.format("memory").queryName("weeks").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.week.day for r in spark.table("weeks").collect()} <= {1, 8, 15} and spark.table("weeks").count() >= 2
    q = weekly.write_split(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 3
