"""Findings of the third review that were open after it, each by a case that failed before."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, repeats
from weftline.operators import arrival


def test_a_large_group_of_near_copies_makes_few_rows(spark, monkeypatch):
    """Windows of large buckets were a row each; now they are a row for each class and part, with the same results."""
    monkeypatch.setattr(repeats, "CLASSES", 4)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    a = word(1500)
    texts = [a[:k] + word(1) + a[k + 1 :] for k in rng.integers(500, 1000, 30)] + ["ab" * 500, a[200:900], word(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for part in (1, 5, 1000):
        monkeypatch.setattr(repeats, "PART", part)
        out = repeats.report(df)
        got[part] = sorted(map(tuple, out.collect()))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode(windows" not in plan
    monkeypatch.setattr(repeats, "CLASSES", 10_000)  # all buckets sorted
    assert got[1] == got[5] == got[1000] == sorted(map(tuple, repeats.report(df).collect()))
    assert sum(r[2] for r in got[1]) > 20_000


def test_few_targets_give_the_bits(spark, monkeypatch):
    """Seeds that nobody leads to took a bit each and part in all rounds; now targets have the bits if they are few. Circles and self-loops too."""
    rng = np.random.default_rng(4)
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, 90, 150), rng.integers(0, 12, 150))} | {(3, 3), (90, 90), (91, 90)}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(seed):
        found, waiting = set(), [seed]
        while waiting:
            for b in after.get(waiting.pop(), ()):
                if b not in found:
                    found.add(b)
                    waiting.append(b)
        return len(found - {seed})

    called, plain = [], arrival._targets_of
    monkeypatch.setattr(arrival, "_targets_of", lambda *a: called.append(a) or plain(*a))
    seeds = [*range(92), 500]
    df, asked = spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(k,) for k in seeds], "seed long")
    for block, size in ((None, None), (3, 6)):
        got = arrival.reach_sizes(df, asked, block, size)
        assert sorted(map(tuple, got.collect())) == [(k, reached(k)) for k in seeds]
    assert len(called) == 2


def test_timed_events_are_one_sweep(spark, monkeypatch):
    """Events dealt to buckets by number took as many rounds as paths cross buckets; a chain now is one sweep for each block, with its hops."""
    monkeypatch.setattr(arrival, "_rounds", None)
    n = 300
    df = spark.createDataFrame([(k, k + 1, k // 3) for k in range(n)], "src long, dst long, at long")
    got = arrival.arrivals(df, spark.createDataFrame([(k, 0) for k in range(n)], "seed long, start long"))
    assert sorted(map(tuple, got.collect())) == [(a, b, max(0, (b - 1) // 3), b - a) for a in range(n) for b in range(a + 1, n + 1)]


def test_the_pipeline_encodes_and_decodes_in_one_step(spark, sf_dir):
    """A worker that encoded and one that decoded stood beside that of the texts: over an executor's memory at half a gigabyte."""
    import corpus_pipeline
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 5 = 0")
    got = corpus_pipeline.to_tokens(spark, docs, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    want = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN), ranks)
    want = want.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
