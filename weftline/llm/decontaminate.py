"""Benchmark decontamination with one Aho-Corasick automaton.

The normalised benchmark items are cut into windows of 13 words; all windows form one automaton, and each normalised
text is scanned once. Matches are mapped back to words, and to offsets of the original text.

The automaton's size is checked: items are dealt into shards of at most ``SHARD_BYTES`` of window text. A usual benchmark is one
shard, which is broadcast, and texts are scanned once. Of a larger one a shard is broadcast at a time: a row passes one scan after
the other and gathers its hits, with a table between two scans. Nothing is shuffled.

Null, empty and wordless texts have no words, no hits and aren't contaminated; null or wordless items have no window.
Repeated items count once each; repeated documents are kept one for one. A text of any length is scanned whole. Other columns are kept by
``drop_contaminated``, whatever their names; an empty table, or an empty benchmark, hits nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import plain_names, small_batches, table, tidied
from weftline.session import cut

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
SHARD_BYTES = 8 << 20

#: Bytes of words: digits, small letters (after lower-casing A-Z) and all beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode().lower())


def windows(items: list[tuple[object, str | None]]) -> dict[bytes, set[str]]:
    """Item ids by window; a window is its words with a space before, between and after."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[i : i + WINDOW]) + b" ", set()).add(str(item))
    return found


def automaton(found: dict[bytes, set[str]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for window, items in found.items():
        a.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, sorted(items)))
    a.make_automaton()
    return a


def hit_words(words: list[bytes], a: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of hit words as [first, end), and the ids of the items with occurring windows."""
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    spans, items, starts = [], set(), None
    for end, (_, n, ids) in a.iter(text):
        if starts is None:  # where each word's end is followed by a space
            starts, at = [], 0
            for w in words:
                at += len(w) + 1
                starts.append(at)
        last = bisect.bisect_left(starts, end) + 1
        spans.append((last - n, last))
        items.update(ids)
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return [(lo, hi) for lo, hi in runs], items


def spans_in(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of runs of words."""
    at = [m.span() for m in WORDS.finditer(text.encode().lower())]
    return [(at[lo][0], at[hi - 1][1]) for lo, hi in runs]


def shards(benchmark: DataFrame, most: int = SHARD_BYTES) -> Iterator[dict[bytes, set[str]]]:
    """The benchmark's windows, at most so many bytes at a time (or those of a single item)."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        part.append((r[0], r[1]))
        size += WINDOW * len((r[1] or "").encode())
        if size > most:
            yield windows(part)
            part, size = [], 0
    yield windows(part)


PAIRS = "array<struct<lo: bigint, hi: bigint>>"
_PAIRS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping runs made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, most: int = SHARD_BYTES) -> tuple[DataFrame, list[str]]:
    """All rows and columns of docs (text, ...), and columns with names of their own: number of words, runs of hit words, ids
    of items with occurring windows."""
    spark, at, columns = docs.sparkSession, docs.columns.index("text"), docs.columns
    names = []
    for name in ("words", "runs", "items"):
        while name.lower() in (c.lower() for c in columns):
            name = f"_{name}"
        names.append(name)
    rows = docs.select(*(F.col(f"`{c}`") for c in columns), F.lit(0).cast("long").alias(names[0]), F.array().cast(PAIRS).alias(names[1]), F.array().cast("array<string>").alias(names[2]))
    before = None
    for k, found in enumerate(shards(benchmark, most)):
        if k:  # the scan of the shard before ends here, and its automaton isn't needed any longer
            rows = cut(rows, [before] if before is not None else [])
            shared.destroy()  # noqa: F821
            before = rows
        shared = spark.sparkContext.broadcast(found)
        small_batches(spark)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a, n = automaton(shared.value), len(columns)
            for b in batches:
                words, runs, items = [], [], []
                for text, had, known in zip(b.column(at).to_pylist(), b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()):
                    own = words_of(text)
                    hit, found = hit_words(own, a) if own and len(a) else ([], set())
                    words.append(len(own))
                    runs.append([{"lo": lo, "hi": hi} for lo, hi in (united([*hit, *((x["lo"], x["hi"]) for x in had)]) if had else hit)])
                    items.append(sorted(found.union(known)) if known else sorted(found))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(words, pa.int64()), pa.array(runs, _PAIRS), pa.array(items, pa.list_(pa.string()))], names=b.schema.names)

        rows = rows.mapInArrow(tidied(run), rows.schema)
    return rows, names


def _contaminated(words: str, runs: str) -> tuple[Column, Column]:
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return hit, (hit > 0) & (hit * SHARE >= F.col(words))


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (byte offsets of hits in the original), contaminated of each text."""
    rows, _ = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, most)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"lo": lo, "hi": hi} for lo, hi in spans_in(t, [(x["lo"], x["hi"]) for x in r])] if r else [] for t, r in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(spans, _PAIRS)], ["doc_id", "n_words", "runs", "items", "spans"])

    got = rows.mapInArrow(tidied(located), f"doc_id bigint, n_words bigint, runs {PAIRS}, items array<string>, spans {PAIRS}")
    hit, contaminated = _contaminated("n_words", "runs")
    return got.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans", contaminated.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    plain = plain_names(docs, "text")
    rows, (words, runs, _) = scanned(plain, benchmark, most)
    return rows.where(~_contaminated(words, runs)[1]).select(*plain.columns).toDF(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
