"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every text operator."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from weftline.llm import byte_bpe, chat_format, decontaminate, embedding_dedup, hmm_score, ngram_join, repeats, token_counts, toxicity, url_filter

RANKS = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, LONG), (None, "no id here at all"), (6, "  \n\t "), (7, "ÄÖ漢字🙂 İß Σς")]
EXTRA = "id long, n long, token string, row long, text_a string, component string, at long, words string, runs long, Items string, _runs long, _hit_runs string, _n_words string, removed string, spans string, score string, held_out string"


def docs(spark, rows=ROWS, more=()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in EXTRA.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def labels(spark, rows=((3, 1), (5, 0), (7, None), (None, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


def bench(spark, rows=((1, "a"), (2, None), (3, ""), (1, "a"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


RUNS = {
    "ngram_join": lambda s, d: ngram_join.link(d),
    "one_of_each": lambda s, d: ngram_join.one_of_each(d),
    "repeats": lambda s, d: repeats.report(d),
    "without_repeats": lambda s, d: repeats.without_repeats(d),
    "hmm": lambda s, d: hmm_score.score(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, bench(s)),
    "drop_contaminated": lambda s, d: decontaminate.drop_contaminated(d, bench(s)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.learn(d, labels(s))),
    "keep_ordinary": lambda s, d: toxicity.keep_ordinary(d, toxicity.learn(d, labels(s))),
    "token_counts": lambda s, d: token_counts.count_tokens(d, P.path("word_bpe_49k.json")),
    "byte_bpe": lambda s, d: byte_bpe.digests(d, RANKS, P.PATTERN),
}
FILTERS = {"one_of_each", "drop_contaminated", "keep_ordinary"}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_hard_rows(spark, name):
    got = RUNS[name](spark, docs(spark)).collect()
    assert len(got) == len(ROWS) if name not in FILTERS else 0 < len(got) <= len(ROWS)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_tables(spark, name):
    assert RUNS[name](spark, docs(spark, [])).count() == 0


NAMES = ("a.b", "c0", "__weft_sha", "__weft_salt", "__weft_removed0", "__weft_row", "x`y", "Words")


@pytest.mark.parametrize("name", sorted(FILTERS | {"without_repeats"}))
def test_columns_of_any_name_pass_through(spark, name):
    df = spark.createDataFrame([(1, "some words here", *range(8)), (2, LONG, *range(8))], ["doc_id", "text", *NAMES])
    got = RUNS[name](spark, df)
    assert got.columns == df.columns and all(tuple(r)[2:] == tuple(range(8)) for r in got.collect())


def test_defined_results(spark):
    d = docs(spark)
    link = {r.doc_id: r for r in ngram_join.link(d).collect()}
    assert link[1].n_shingles == link[2].n_shingles == link[6].n_shingles == 0 and link[2].component_id == 2
    assert link[3].component_id == link[4].component_id == 3 and link[5].n_shingles == 3
    gone = {r.doc_id: r for r in repeats.report(d).collect()}
    assert gone[5].n_removed == gone[5].n_bytes and gone[1].n_bytes == 0 and gone[3].n_removed == 0
    hit = {r.doc_id: r for r in decontaminate.contamination(d, bench(spark)).collect()}
    assert hit[3].contaminated and hit[3].n_words == 1 and not hit[5].contaminated and hit[1].n_words == 0
    enc = {r.doc_id: r for r in byte_bpe.digests(d, RANKS, P.PATTERN).collect()}
    assert enc[1].n_tokens == 0 and enc[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.score for r in toxicity.score(d, toxicity.fit([], [])).collect()} == {0.5}
    none = hmm_score.score(docs(spark, [(k, "x y") for k in range(3) if False])).count()
    assert none == 0


def test_pages(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://EXAMPLE.com/en/7?x"), (5, "http://a.example.com/en/8#t"), (6, "http://example.com"), (None, "x://Y\nz/a//b///c"), (4, "http://net/de/"), (8, "http://xnet/de/"), (9, "://example.net/de/8x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "shape", "n", "template")})
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == 9 and (got[1].host, got[1].path, got[3].host) == ("", "", "")
    assert (got[5].rule, got[5].verdict, got[8].rule, got[9].rule, got[9].verdict) == ("com/en/", "block", None, "example.net/de/8", "block")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_generalise_and_reject(spark):
    rows = [(k, f"http://shop.test/item/word{'abcdefghijklmnopqrstuvwxyz'[k % 26] * (1 + k // 26)}") for k in range(60)] + [(100 + k, f"http://shop.test/spam/{k}") for k in range(40)]
    rules = (("block", "shop.test", "/spam/1"), ("block", "shop.test", "/spam/2"))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {r.template for r in got if "/item/" in r.path} == {"/item/*"}
    assert {r.verdict for r in got if "/spam/" in r.path} == {"block"} and {r.verdict for r in got if "/item/" in r.path} == {"allow"}


def test_templates_decide_pages_without_labels(spark):
    words = [x + y for x in "abcde" for y in "fghij"]
    rows = [f"http://h.test/{a}/{w}" for a in ("one", "two", "three") for w in words]
    rows += [f"http://g.test/spam/{w}?{k}" for w in ("seen", "other") for k in range(12)] + ["http://g.test/item/x"]
    rules = (("block", "h.test", "/one/a"), ("block", "h.test", "/two/b"), ("block", "g.test", "/spam/seen"))
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = url_filter.judge(df, rules).collect()
    assert len(got) == len(rows)
    # alike siblings move whole, and the third, which has no labels, joins them
    assert {(r.template, r.verdict) for r in got if r.host == "h.test"} == {("/+/*", "block")}
    # without labels of its own, a template takes those of its nearest parent, but not of the host
    assert {(r.path, r.verdict) for r in got if r.host == "g.test"} == {("/spam/seen", "block"), ("/spam/other", "block"), ("/item/x", "allow")}


def test_chats(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", f"a{chat_format.ESCAPE}.<|end|>\n</s>[INST]"), (2, None, "us\ner", "<|turn|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(chat_format.from_rows(df))).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == len(rows[3][3])
    assert got[2].turns_sha256 == hashlib.sha256("us\ner\n<|turn|>\n".encode()).hexdigest()
    records = ['{"prompt": "p", "response": "r"}', '{"instruction": "i", "input": "", "output": "o"}', '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": null}]}', '{"x": 1}', "[]", "not json", None, '{"messages": []}']
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert [got[k].layout for k in range(8)] == ["prompt/response", "instruction/input/output", "conversations/from", None, None, None, None, "messages/text"]
    assert chat_format.read(got[1].formatted) == [("user", "i"), ("assistant", "o")] and chat_format.read(got[2].formatted) == [("user", "h"), ("assistant", "")]
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, record string")).count() == 0


def test_every_mapping_and_odd_records(spark):
    """All layouts, with further fields; records that can't be read have none."""
    said = {"list": lambda m: {m["list"]: [{m["role"]: "user", m["text"]: "q", "more": 1}, {m["role"]: "assistant", m["text"]: "a"}]}}
    records, want = [], []
    for m in chat_format.MAPPINGS:
        body = said["list"](m) if "list" in m else {n: f"{role} {n}" for role, names in m["fields"] for n in names}
        for extra in ({}, {"id": 7, "meta": {"source": ["x", {"y": None}]}}):
            records.append(json.dumps(body | extra))
            turns = [("user", "q"), ("assistant", "a")] if "list" in m else [(role, "\n\n".join(f"{role} {n}" for n in names)) for role, names in m["fields"]]
            want.append((m["name"], turns))
    odd = ["[" * 200_000, '{"prompt": ' + "[" * 50_000 + "]" * 50_000 + ', "response": "r"}', '{"messages": ["x"]}', '{"messages": [1, {"role": "user", "text": "t"}]}', '{"prompt": "p", "response": "r", "completion": "c"}', "1" * 5000, '{"id": 1}']
    df = spark.createDataFrame(list(enumerate([*records, *odd, '{"prompt": "\\ud800x", "response": 5}'])), "conv_id long, record string")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert [(got[k].layout, chat_format.read(got[k].formatted)) for k in range(len(want))] == want
    assert {(got[len(want) + k].layout, got[len(want) + k].formatted) for k in range(len(odd))} == {(None, "")}
    assert chat_format.read(got[len(want) + len(odd)].formatted) == [("user", "\ufffdx"), ("assistant", "5")]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "key", "vec", "n")})
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (2, 1, True) and by[2] == by[10] == (2, 1, False) and all(by[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_conversations_query_has_the_hard_one(spark, sf_dir):
    got = chat_format.op6_chat_format(spark, sf_dir).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (got.n_turns, got.loss_chars) == (2, len(said)) and got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
