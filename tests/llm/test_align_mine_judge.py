"""Alignment, hard negatives and quality rules against plain re-computations, with hard rows."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import hard_negatives, quality_rules, token_align
from weftline.llm.queries import QUERIES

HARD = [(1, None), (2, ""), (3, "a▁b"), (None, "x  y\n\t 　 z"), (4, "漢字🙂 <|endoftext|> </s>"), (4, "漢字🙂 <|endoftext|> </s>"), (5, "a" * 5000), (6, " " * 3000 + "x"), (7, "\x00\x01"), (8, "1234567890 " * 30), (9, "é" * 3000 + "🙂" * 500), (10, "the cat́ sat" * 200)]
CLASHING = ("a.b", "chunk", "pair", "n", "words", "lines", "windows", "label_", "block", "codes", "score", "rank", "id", "vec")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def both():
    return token_align.read_tokenizers(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))


def plain_groups(texts):
    """Lists of (A ids, B ids) of each text, or None."""
    a_library, b_library = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_library.encode_special_tokens = True
    raw_a = lambda i: a_library.decoder.decode([a_library.id_to_token(i)])
    for text in texts:
        if not text:
            yield None
            continue
        whole = b" " + text.encode()
        a = a_library.encode(" " + text, add_special_tokens=False)
        b = b_library.encode(text)
        pieces = [b_library.id_to_piece(i) for i in b]
        sizes_b = [1 if b_library.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in zip(b, pieces)]
        joined = b"".join(bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces))
        if joined != whole:
            yield None
            continue
        assert raw_a(a.ids[0]) is not None
        ends_a = np.cumsum([len(t) for t in a.tokens])  # a character of the byte-level alphabet is a byte
        ends_b = np.cumsum(sizes_b)
        shared = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups = [([], []) for _ in shared]
        for side, (ids, ends) in enumerate(((a.ids, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends):
                groups[np.searchsorted(shared, e)][side].append(i)
        yield groups


def plain_counts(texts):
    found = list(plain_groups(texts))
    links = [[(a, b) for x, y in g or [] for a in x for b in y] for g in found]
    count = collections.Counter(p for some in links for p in set(some))
    top = collections.defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for g, some in zip(found, links):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        yield (sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(some), sum(count[p] == top[p[0]] for p in some), sum(count[p] for p in some), hashlib.sha256(shown.encode()).hexdigest() if g else "")


def test_op12_against_plain_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], plain_counts([r.text for r in docs])))
    got = QUERIES["op12_token_align"](spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert len(got) == len(docs) and {r.doc_id: tuple(r)[1:] for r in got} == want


def test_op12_hard_rows(spark, both, monkeypatch):
    df = clashing(spark.createDataFrame(HARD, "doc_id long, text string"))
    got = token_align.linked_counts(df, both).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(plain_counts([t for _, t in HARD]))
    monkeypatch.setattr(token_align, "CHUNK", 100)  # several chunks
    again = token_align.linked_counts(df, both).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert token_align.linked_counts(df.limit(0), both).count() == 0


def test_op12_large_groups_expand_in_blocks(both, monkeypatch):
    a, b = both.cuts([t for _, t in HARD])
    g = token_align.grouped(a, b, both.sizes)
    rng = np.random.default_rng(1)
    one = token_align.Groups(rng.integers(0, 40, 300), rng.integers(0, 30, 200), np.zeros(300, int), np.zeros(200, int), np.zeros(1, int), np.array([300]), np.array([200]), np.array([9]))
    for groups in (g, one):
        whole = token_align.pairs(groups, 32_000, 32_000 * 50_257)
        monkeypatch.setattr(token_align, "BLOCK", 50)
        parts = token_align.pairs(groups, 32_000, 32_000 * 50_257)
        monkeypatch.undo()
        assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and whole[1].sum() == (groups.n_a * groups.n_b).sum()


def test_op12_alignments_hold_the_groups(spark, both):
    df = clashing(spark.createDataFrame([r for r in HARD if r[0] not in (None, 4)], "doc_id long, text string"))
    want = dict(zip([k for k, _ in HARD], plain_groups([t for _, t in HARD])))
    for r in token_align.alignments(df, both).collect():
        at_a, at_b = np.cumsum([0, *r.a_sizes]), np.cumsum([0, *r.b_sizes])
        assert [(r.a_ids[at_a[k] : at_a[k + 1]], r.b_ids[at_b[k] : at_b[k + 1]]) for k in range(len(r.ends))] == (want[r.doc_id] or [])


def plain_negatives(rows):
    own = {}
    for k, e, label in rows:
        if k is None or label is None or e is None or any(c is None or not np.isfinite(c) for c in e):
            continue
        label = (label + 1) % 10 if k % 7 == 0 else label
        x = tuple(int(v) for v in np.floor(256 * np.array(e, np.float64)))
        own[k] = min(own.get(k, (label, x)), (label, x), key=lambda r: (r[0], np.array(r[1], np.int32).tobytes()))
    for a, (label, x) in own.items():
        if a % 100:
            continue
        score = {k: sum(p * q for p, q in zip(x, y)) for k, (_, y) in own.items() if k != a and len(y) == len(x)}
        order = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in order if own[k][0] == label][:5]:
            fine = [k for k in order if own[k][0] != label and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            for n, k in enumerate(fine[:10]):
                yield a, p, n + 1, k, score[p], score[k]


@pytest.mark.parametrize("seed", [1, 2])
def test_op11_against_all_scores(spark, seed, monkeypatch):
    """Ties, copies, rows that take no part, other lengths, odd lengths; many small blocks."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 7))
    rows = [(int(k) * (5 if seed == 1 else 1), [float(np.float32(v)) for v in base[rng.integers(40)] + (rng.random() < 0.5) * rng.normal(size=7) * 0.2], int(rng.integers(4))) for k in range(600)]
    rows += [(1000 + 50 * k, [0.5, -0.25], k % 3) for k in range(12)] + [(2000, None, 1), (2100, [1.0] * 7, None), (2200, [float("nan")] * 7, 1), (2300, [None] * 7, 2), (None, [1.0] * 7, 1), (2400, [], 1), (2401, [], 2), (2403, [], 1), (2500, [0.0] * 7, 1)]
    rows += rows[:3] + [(k, [0.3] * 7, 3) for k in range(3000, 3400, 1)]  # one vector many times
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = sorted(plain_negatives(rows))
    monkeypatch.setattr(hard_negatives, "FEWEST", 128)
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert len(want) > 100 and got == want


def test_op11_bounds_hold_and_empty(spark):
    rng = np.random.default_rng(3)
    x, a = (rng.integers(-200, 200, (n, 31)).astype(np.int32) for n in (3000, 20))
    book = hard_negatives.fit(x[:500])
    codes, norms = book.encode(x)
    block = hard_negatives.Block([{"vec_id": k, "label": 0, "vec": v.tobytes(), "codes": c.tobytes(), "norms": n.tobytes()} for k, (v, c, n) in enumerate(zip(x, codes, norms))], book)
    total = 0
    for level in (0, 1):
        total = total + block.approximate(codes, book.tables(a, level), level)
        off = np.abs(total - a.astype(int) @ x.T.astype(int))
        assert (off <= norms[:, level] * np.linalg.norm(a, axis=1)[:, None] + 1e-6).all()
    assert (norms[:, 1] < norms[:, 0] / 3).mean() > 0.9  # the second codes are much nearer
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_op13_counts_of_hard_rows(spark):
    rows = HARD + [(11, "a b c a b c a b c"), (12, "\n \n x\n x\nx\n…\n- q ...\n • z\x00# 漢字🙂"), (13, "a a a a"), (14, "a b"), (15, "word " * 40_000), (16, "  \x85 x"), (17, "a\rb\x0bc\x0cd")]
    got = quality_rules.judge(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(plain_measures(t) for _, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) and r.kept == (not r.broken)
    by = {r.doc_id: r for r in got}
    assert by[1].broken == by[2].broken == ["length"] and by[15].n_repeat_words == 40_000
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op13_keeps_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = QUERIES["op13_quality_rules"](spark, sf_dir).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept) for r in got} == {(0, False), (1, True)}


def test_op13_rules_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "x y # z"), (2, "x y z")], "doc_id long, text string")
    rules = (quality_rules.Rule("few symbols", "n_symbols", "n_words", most=249),)
    assert {(r.doc_id, r.kept, r.base_failed, tuple(r.broken)) for r in quality_rules.judge(df, rules).collect()} == {(1, False, False, ("few symbols",)), (2, True, False, ())}
    assert {r.kept for r in quality_rules.judge(df, ()).collect()} == {True}
