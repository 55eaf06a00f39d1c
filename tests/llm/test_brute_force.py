"""The registered queries and the pipeline against plain re-computations."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, decontaminate, embedding_dedup, hmm_score, ngram_join, repeats, token_counts, toxicity
from weftline.llm.queries import QUERIES

LOWER = {i: i + 32 for i in range(65, 91)}
hexed = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def by_id(spark, sf_dir, name):
    return {r[0]: r for r in QUERIES[name](spark, sf_dir).collect()}


def linked(texts):
    """Set sizes and least reachable ids, from all pairs."""
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    label = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {k: (len(s), label[k]) for k, s in sets.items()}


def repeated(texts, length=400):
    """Removed runs of each text's bytes, from counts of all strings of so many bytes."""
    raw = {k: (t or "").encode() for k, t in texts.items()}
    n = collections.Counter(x[i : i + length] for x in raw.values() for i in range(len(x) - length + 1))
    out = {}
    for k, x in raw.items():
        spans = repeats.united([(i, i + length) for i in range(len(x) - length + 1) if n[x[i : i + length]] > 1])
        out[k] = (len(x), sum(b - a for a, b in spans), len(spans), hexed(repeats.kept_bytes(x, spans)), spans)
    return out


def hits(texts, items):
    windows = collections.defaultdict(set)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    out = {}
    for k, t in texts.items():
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[x]
        out[k] = (len(w), len(hit), len(found), hexed(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_op1(spark, sf_dir, texts):
    got = by_id(spark, sf_dir, "op1_ngram_join")
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == linked(texts)


def test_op1_chains_and_groups(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    rows, passage = [], " ".join(f"p{i}" for i in range(60))
    for k in range(40):  # a chain: neighbours are alike, ends are not
        w = list(base)
        w[: k * 2] = [f"c{i}" for i in range(k * 2)]
        rows.append((k, " ".join(w)))
    for k in range(100, 160):  # one passage in unlike texts
        rows.append((k, passage + " " + " ".join(f"r{x}" for x in rng.integers(0, 10**6, 90))))
    for k in range(200, 260):  # near copies of one text
        w = [f"n{i}" for i in range(150)]
        w[int(rng.integers(0, 150))] = f"edit{k}"
        rows.append((k, " ".join(w)))
    texts = dict(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(texts)


def test_op1_ids_with_several_texts(spark):
    """A document with two texts links with what either links with; the other orders and screens lose no link."""
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(60))
    rows = [(5, a), (5, b), (9, b), (12, b + " more"), (13, a + " more"), (20, "else"), (None, a), (None, b)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 56): 5, (9, 56): 5, (12, 57): 5, (13, 57): 5, (20, 1): 20, (None, 56): None}
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, b), (20, "else"), (0, a), (0, b)])


def test_op1_long_words_that_sums_confuse(spark):
    """The Thue-Morse string and its complement have equal sums modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = ("".join("ab"[k ^ f] for k in bits) for f in (0, 1))
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    df = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.report(df).collect()} == {k: v[1] for k, v in repeated({1: x, 2: y}).items()}


def test_op2(spark, sf_dir, texts):
    got, want = by_id(spark, sf_dir, "op2_repeats"), repeated(texts)
    assert {k: tuple(r)[1:5] for k, r in got.items()} == {k: v[:4] for k, v in want.items()}
    assert {k: r.n_passage_bytes for k, r in got.items()} == {k: v[1] for k, v in repeated(texts, 250).items()}


@pytest.mark.parametrize("length", [20, 64, 250, 400])
def test_op2_ranks_order_suffixes(length):
    """Ranks are those of a plain sort, within and across places of the difference cover, for ties of any length."""
    rng = np.random.default_rng(length)
    base = rng.integers(0, 3, 2 * length).astype(np.uint8)
    parts = [np.concatenate([rng.integers(0, 3, k).astype(np.uint8), base[k % 5 :], rng.integers(0, 3, 40).astype(np.uint8)]) for k in range(9)] + [np.zeros(2 * length + 7, np.uint8)]
    raw, start, at = np.concatenate(parts), [], 0
    for x in parts:
        start += range(at, at + x.size - length + 1)
        at += x.size
    less, equal = repeats.suffix_ranks(raw, np.array(start), length)
    strings = [raw[i : i + length].tobytes() for i in start]
    n, order = collections.Counter(strings), sorted(strings)
    assert equal.tolist() == [n[x] for x in strings] and equal.max() > 1
    assert [order[k] for k in less] == strings and all(k == 0 or order[k - 1] < x for k, x in zip(less, strings))
    for r in range(repeats.COVER):
        for s in range(repeats.COVER):
            assert {(r + repeats.shift_of(r, s)) % repeats.COVER, (s + repeats.shift_of(r, s)) % repeats.COVER} <= set(repeats.DIFFERENCE_COVER)


def test_op2_planted_passage_of_55_words(spark):
    """A passage of over 50 words that 30 texts share is under 400 bytes: the pipeline's length takes it out, and nothing else."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 7))))
    passage = " ".join(word() for _ in range(55))
    assert 250 <= len(passage) < 400
    own = {k: (" ".join(word() for _ in range(80)) + " ", " " + " ".join(word() for _ in range(60))) for k in range(60)}
    df = spark.createDataFrame([(k, a + (passage if k < 30 else "") + b) for k, (a, b) in own.items()], "doc_id long, text string")
    left = {r.doc_id: r.text for r in repeats.without_repeats(df, repeats.PASSAGE).collect()}
    whole = {k: a + (passage if k < 30 else "") + b for k, (a, b) in own.items()}
    strings = collections.Counter(t[i : i + repeats.PASSAGE] for t in whole.values() for i in range(len(t) - repeats.PASSAGE + 1))
    for k in range(30):  # letters beside the passage go where two texts have them by chance
        gone = {j for i in range(len(whole[k]) - repeats.PASSAGE + 1) if strings[whole[k][i : i + repeats.PASSAGE]] > 1 for j in range(i, i + repeats.PASSAGE)}
        assert left[k] == "".join(c for j, c in enumerate(whole[k]) if j not in gone) and passage[5:-5] not in left[k]
    assert all(left[k] == "".join(own[k]) for k in range(30, 60))


def test_op2_passages_without_ids(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    a = word(700)
    texts = {k: word(int(rng.integers(0, 200))) + a[int(rng.integers(0, 90)) : 700 - int(rng.integers(0, 90))] + word(int(rng.integers(0, 200))) for k in range(8)}
    df = spark.createDataFrame([(None, t) for t in texts.values()], "doc_id long, text string")
    assert sorted(tuple(r)[1:5] for r in repeats.report(df).collect()) == sorted(tuple(v[:4]) for v in repeated(texts).values())


@pytest.mark.parametrize("classes", [repeats.CLASSES, 1])
def test_op2_passages(spark, monkeypatch, classes):
    monkeypatch.setattr(repeats, "CLASSES", classes)  # 1: every bucket goes the way of the large ones
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefghij é漢"), n))
    a, b = word(500), word(399)
    texts = {k: word(int(rng.integers(0, 300))) + a[int(rng.integers(0, 60)) :] + word(int(rng.integers(0, 300))) for k in range(12)}
    texts |= {20: "xy" * 700, 21: "z" * 401, 22: "z" * 400, 23: b + "1", 24: b + "2", 25: a + a, 26: word(900), 27: word(50) + "xy" * 300}
    texts[28] = texts[26]
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: v[:4] for k, v in repeated(texts).items()}


def test_op4(spark, sf_dir, texts):
    got = by_id(spark, sf_dir, "op4_hmm_score")
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for k, t in texts.items()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c = collections.Counter(w for k, ws in words.items() if not out[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, r in got.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[k])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[k], len(words[k]), sum(w in c for w in words[k]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # latent states help on texts not learnt from


def plain_likelihood(m, s):
    a = m.start * m.emit[s[0]]
    for x in s[1:]:
        a = (a @ m.move) * m.emit[x]
    return math.log(a.sum())


def plain_expected(m, s):
    """Expected counts of one sequence, from forward and backward variables that aren't scaled."""
    alpha, beta = [m.start * m.emit[s[0]]], [np.ones(m.start.size)]
    for x in s[1:]:
        alpha.append((alpha[-1] @ m.move) * m.emit[x])
    for x in s[:0:-1]:
        beta.insert(0, m.move @ (m.emit[x] * beta[0]))
    total = alpha[-1].sum()
    emit, move = np.zeros_like(m.emit), np.zeros_like(m.move)
    for t, x in enumerate(s):
        emit[x] += alpha[t] * beta[t] / total
        if t:
            move += np.outer(alpha[t - 1], m.emit[x] * beta[t]) * m.move / total
    return alpha[0] * beta[0] / total, move, emit


def some_model(rng, states=3, symbols=5):
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm_score.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0), np.full(symbols, 1 / symbols))


def test_op4_equal_counts_keep_their_emissions(spark):
    """Of words that tie, the lesser ones are taken up to the bound: a model of 3 symbols is left, not of the end alone."""
    counts = spark.createDataFrame([(b"", 9), *((bytes([c]), 20) for c in b"edcba")], "word binary, c long")
    assert hmm_score.most_frequent(counts, 3) == [(b"", 9), (b"a", 20), (b"b", 20)]
    assert hmm_score.most_frequent(counts.where("length(word) > 0"), 99) == [(bytes([c]), 20) for c in b"abcde"]


def test_op4_forward_is_exact(monkeypatch):
    monkeypatch.setattr(hmm_score, "GROUP", 30)
    rng = np.random.default_rng(3)
    m = some_model(rng)
    seqs = [np.array(s) for s in ([0], [1, 2, 4], [4, 4, 0, 3, 1], [2], rng.integers(0, 5, 40).tolist(), rng.integers(0, 5, 17).tolist())]
    seen = []
    for places, symbols, live in hmm_score.grouped(seqs):
        assert np.allclose(m.forward(symbols, live), [plain_likelihood(m, seqs[i]) for i in places])
        for got, want in zip(m.expected(symbols, live), map(sum, zip(*(plain_expected(m, seqs[i]) for i in places)))):
            assert np.allclose(got, want)
        seen += places.tolist()
    assert sorted(seen) == list(range(len(seqs)))
    # all texts of two tokens have probability 1 together
    two = [np.array([a, b]) for a in range(5) for b in range(5)]
    assert math.isclose(sum(math.exp(plain_likelihood(m, s)) for s in two), 1)


def test_op4_rounds_use_all_rows(spark, monkeypatch):
    """Training is plain Baum-Welch over all rows: the same as rounds in one process, and each makes the texts likelier."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(hmm_score, "GROUP", 50)
    monkeypatch.setattr(hmm_score, "MOVES", 0.0)
    monkeypatch.setattr(hmm_score, "SMOOTH", 1e-9)
    seqs = [rng.integers(0, 12, 9) % (3 + k % 9) for k in range(60)]
    parts = list(hmm_score.grouped(seqs))
    rows = [(True, symbols.astype(np.int32).tobytes(), live.astype(np.int32).tobytes()) for _, symbols, live in parts]
    overall = np.full(13, 1 / 13)
    has = np.stack([np.bincount(s, minlength=13) > 0 for s in seqs])[:, 1:12].astype(float)
    groups = spark.createDataFrame(rows, "train boolean, symbols binary, live binary").repartition(3)
    shared, texts = hmm_score.together(groups, 11)
    assert texts == len(seqs) and (shared == has.T @ has).all()
    want = hmm_score.starting(shared, texts, overall)
    risen = [sum(plain_likelihood(want, s) for s in seqs)]
    for _ in range(hmm_score.ROUNDS):
        want = hmm_score.improved(want, *(sum(x) for x in zip(*(plain_expected(want, s) for s in seqs))))
        risen.append(sum(plain_likelihood(want, s) for s in seqs))
    assert risen == sorted(risen) and risen[-1] > risen[0]
    got = hmm_score.train(groups, overall)
    assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit)


def test_op4_scores_are_those_of_the_model(spark, sf_dir, texts):
    """Scores of the query from the model's parameters, by plain recursion over words."""
    kept = {}
    real = hmm_score.train
    try:
        hmm_score.train = lambda groups, overall: kept.setdefault("model", real(groups, overall))
        got = by_id(spark, sf_dir, "op4_hmm_score")
    finally:
        hmm_score.train = real
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), ""] for k, t in texts.items()}
    c = collections.Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    own = sorted((w for w in c if c[w] >= hmm_score.LEAST or not w), key=lambda w: (w != "", -c[w], w.encode()))
    symbol, n, v = {w: i for i, w in enumerate(own)}, sum(c.values()), len(c)
    rest = n + v + 1 - sum(c[w] + 1 for w in own)
    assert kept["model"].overall.size == len(own) + 1
    for k in list(texts)[:40]:
        want = sum(math.log10((c[w] + 1) / rest) for w in words[k] if w not in symbol)
        a = None
        for w in words[k]:
            a = (kept["model"].start if a is None else a @ kept["model"].move) * kept["model"].emit[symbol.get(w, len(own))]
            want += math.log10(a.sum())
            a = a / a.sum()
        assert math.isclose(got[k].score, want, rel_tol=1e-9)


def test_op5(spark, sf_dir, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = by_id(spark, sf_dir, "op5_decontaminate")
    assert {k: tuple(r)[1:] for k, r in got.items()} == hits(texts, items)
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    many = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench, most=10_000).collect()}
    assert many == {k: (a, b, c, e) for k, (a, b, c, _, e) in hits(texts, items).items()}
    kept = {r[0] for r in decontaminate.drop_contaminated(docs, bench, most=10_000).select("doc_id").collect()}
    assert kept == {k for k, v in hits(texts, items).items() if not v[4]}


def test_op6(spark, sf_dir):
    turns = collections.defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.role, r.text or ""))
    got = by_id(spark, sf_dir, "op6_chat_format")
    assert len(got) == len(turns) + 1
    for k, t in turns.items():
        said = "".join(x for r, x in t if r == "assistant")
        assert tuple(got[k])[1:5] == (len(t), hexed("".join(f"{r}\n{x}\n" for r, x in t).encode()), len(said), hexed(said.encode()))


def test_op7_recall(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = []
    for cosine in (0.945, 0.951, 0.955, 0.97, 0.99):
        other = rng.normal(size=base.shape)
        other -= (other * base).sum(1)[:, None] * base
        other /= np.linalg.norm(other, axis=1)[:, None]
        near.append(cosine * base + math.sqrt(1 - cosine**2) * other)
    x = np.concatenate([base, *near, np.repeat(base[:1], 1500, 0) + rng.normal(size=(1500, 64)) * 0.01]).astype(np.float32)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hit = y @ y.T >= 0.95
    np.fill_diagonal(hit, False)
    want, found = hit.sum(1), np.array([got[k].n_links for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    rest = slice(0, 1800)
    assert found[rest].sum() >= 0.95 * want[rest].sum()
    assert all(r.component_id <= k and r.kept == (r.component_id == k) for k, r in got.items())


@pytest.mark.parametrize("n", [64, 388, 3873, 12248])
def test_op7_recall_by_points(n):
    """Pairs just over the threshold meet in a list and share points enough, up to the points of 100 million rows."""
    rng = np.random.default_rng(9)
    x, other = rng.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other -= (other * x).sum(1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    a, b = (embedding_dedup.nearest(v, n) for v in (x, 0.951 * x + math.sqrt(1 - 0.951**2) * other))
    far = -x @ embedding_dedup.points(n, 64).T
    assert (a == np.argsort(far, axis=1, kind="stable")[:, : embedding_dedup.NEAREST]).all()
    meet = (embedding_dedup.list_keys(a)[:, :, None] == embedding_dedup.list_keys(b)[:, None, :]).any((1, 2))
    shared = np.array([len(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())])
    assert (np.diag(embedding_dedup.shared_points(a, b)) == shared).all()
    assert (meet & (shared >= embedding_dedup.SHARED)).mean() >= 0.9


def test_op8_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = by_id(spark, sf_dir, "op8_toxicity")
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for k, r in got.items())
    pairs = [(marked[k], r.predicted) for k, r in got.items() if r.held_out and k in marked]
    assert sum(p for y, p in pairs if not y) <= 0.02 * len(pairs)
    assert sum(p for y, p in pairs if y) >= 0.7 * sum(y for y, _ in pairs)
    assert toxicity.fit(["x"] * 5, []).weights[1:] == (0.0,) * 5


def test_op8_scores_are_savings_of_windows(spark):
    """Scores from plain compression of each window with either dictionary, and the curve written out."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmno"), int(rng.integers(2, 8))))
    plain = [" ".join(word() for _ in range(60)) for _ in range(160)]
    bad = ["zwzqwx", "qxzwvvy", "wvzzqxw"]
    toxic = [" ".join(bad[int(rng.integers(0, 3))] if rng.random() < 0.15 else word() for _ in range(60)) for _ in range(120)]
    model = toxicity.fit(toxic, plain)
    assert model.toxic.endswith(model.ordinary) and all(w.encode() in model.toxic and w.encode() not in model.ordinary for w in bad)

    def score(text):
        raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.lower().encode() + b" ") if text else b""
        saved = []
        for i in range(0, len(raw), toxicity.WINDOW):
            size = []
            for content in (model.ordinary, model.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size.append(len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[i : i + toxicity.WINDOW + toxicity.OVERLAP])))
            saved.append(size[0] - size[1])
        saved = sorted(saved, reverse=True) or [0]
        over = lambda s: max(s - toxicity.NOISE, 0)
        second = saved[1] if len(saved) > 1 else 0
        x = (1, max(saved[0], 0) / 4, over(saved[0]) / 4, over(second) / 4, math.log1p(sum(map(over, saved))), math.log1p(len(saved)) / 4)
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x))))

    texts = [*plain[:10], *toxic[:10], "", "A " + bad[0].upper(), "x" * 5000]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string"), model).collect()}
    for k, t in enumerate([*texts, None]):
        assert math.isclose(got[k].score, score(t or ""), rel_tol=1e-6) and got[k].predicted == int(got[k].score >= 0.7)
    assert all(got[k].predicted == 0 for k in range(10)) and sum(got[k].predicted for k in range(10, 20)) >= 9


def test_op9(spark, sf_dir, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    hard = {-1: "a<|endoftext|>b <|STARTOFTEXT|> Σας ΑΣ İstanbul é   x's 12³½ _a_ 漢字🙂👍🏽", -2: "q" * 300 + "!" * 90}
    both = texts | hard
    want = {k: len(e.ids) for k, e in zip(both, t.encode_batch([x or "" for x in both.values()], add_special_tokens=False))}
    got = by_id(spark, sf_dir, "op9_token_counts")
    more = token_counts.count_tokens(spark.createDataFrame(list(hard.items()), "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()
    assert {r.doc_id: r.n_tokens for r in [*got.values(), *more]} == want
    assert all(r.n_bytes == len((texts[k] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for k, r in got.items())


def test_op10(spark, sf_dir, texts, monkeypatch):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hard = {-1: "a  b   c \n d\n\n e's !!!! ....... \t x\0y", -2: "q" * 500 + " " + "ab" * 40, -3: "İ Σς 漢字🙂👍🏽 é  x <|endoftext|>"}
    got = by_id(spark, sf_dir, "op10_byte_bpe")
    hard |= {-4: "", -5: None, -6: " a", -7: "a ", -8: " ", -9: "  ", -10: "\n \n a\u00a0b\u2003c \u2003d", -11: "a\t b \tc\r\n d", -12: "xyz", -13: "xyz xyz zyx"}
    for chunk, most in ((0, 0), (0, 50), (byte_bpe.CHUNK, 0), (byte_bpe.CHUNK, byte_bpe.DICTIONARY)):  # small chunks or one, nothing, little or all known beforehand: the same ids
        monkeypatch.setattr(byte_bpe, "CHUNK", chunk)
        df = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(list(hard.items()), "doc_id long, text string"), ranks, P.PATTERN, most), ranks)
        rows = df.collect()
        assert len(rows) == len(hard)
        for r in rows:
            assert r.ids == lib.encode_ordinary(hard[r.doc_id] or "") and bytes(r.decoded) == (hard[r.doc_id] or "").encode()
    for k, r in got.items():
        ids = lib.encode_ordinary(texts[k] or "")
        assert tuple(r)[1:] == (len(ids), hexed(",".join(map(str, ids)).encode()), hexed((texts[k] or "").encode()))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "repeats", "decontaminate", "byte_bpe"]
    rows = lambda d: {r.doc_id: r.text for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = rows(docs), corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns
        after = rows(out)
        if name == "toxicity":
            scored = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
            assert set(after) == {r.doc_id for r in scored if not r.predicted}
        elif name == "ngram_join":
            assert set(after) == {c for _, c in linked(before).values()} and all(after[k] == before[k] for k in after)
        elif name == "repeats":
            want = {}
            for k, v in repeated(before, repeats.PASSAGE).items():  # the stage's own length
                raw = (before[k] or "").encode()
                want[k] = repeats.kept_bytes(raw, repeats.whole_characters(raw, v[4])).decode()
            assert after == want and all(r.n_chars == len(r.text) for r in out.collect() if len(before[r.doc_id]) != len(r.text))
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {k for k, v in hits(before, items).items() if not v[4]}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {k: hexed((t or "").encode()) for k, t in rows(docs).items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in last}
