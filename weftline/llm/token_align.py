"""Alignment of two tokenizers' cuts of the same bytes, and which token pairs go together over a corpus.

Both tokenizers cut the same bytes (a space and the text), so each has the places where its tokens end. ``np.union1d`` of both makes
elementary intervals; ``np.searchsorted`` finds the token of either side that owns each. A place where both end closes a group, and every
token of a group on one side is linked with every one on the other: the product of the group expands, in blocks of at most ``BLOCK`` links; a larger
group is expanded over its distinct ids with multiplicities.

``alignments`` gives the tokens and groups of each document. ``linked_counts`` counts, over the whole corpus, in how many documents each
pair of ids is linked: a task gathers texts to chunks of ``CHUNK`` bytes (or one longer text), whose pairs are numbered by sorting and
counted by document; a pair is then one row for each chunk that has it, whatever its frequency, is added up by a group-by,
and its count goes back to the chunks that have it. Nothing that grows with the corpus is broadcast or collected: the only broadcast is of the two vocabulary
files. The pairs of one A id are at most as many as there are B ids.

Texts that are null, empty, or whose joined token bytes of either side aren't the space and the text (a literal U+2581, for instance)
have no tokens: zeros, and an empty string for their groups. Rows are kept one for one; a repeated row is a document of its
own, a null doc_id too. Texts of any length are cut whole. Columns other than doc_id and text don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, table, tidied
from weftline.session import cut

#: Bytes of text in a chunk, and links that are expanded at once.
CHUNK, BLOCK = 3 << 20, 2_000_000
#: Runs of white space beyond which the library that has the file's own format cuts a text; the faster one overflows its stack there.
RUN = re.compile(r"\s{500}")


class Tokenizers:
    """The two libraries over the bytes of their files; made once in a worker."""

    def __init__(self, spec: bytes, ranks: bytes, pattern: str, pieces: bytes):
        self.files = spec, ranks, pattern, pieces

    def __reduce__(self):
        return Tokenizers, self.files

    @cached_property
    def _fast(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.files[1].splitlines())}
        return tiktoken.Encoding("a", pat_str=self.files[2], mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def _whole(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.files[0].decode())
        made.encode_special_tokens = True
        return made

    @cached_property
    def _pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.files[3])

    @cached_property
    def a_bytes(self) -> list[bytes]:
        from weftline.llm.token_counts import byte_chars

        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = self._whole.get_vocab(with_added_tokens=False)
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in back for c in token):
                out[i] = bytes(back[c] for c in token)
        return out

    @cached_property
    def b_bytes(self) -> list[bytes]:
        sp = self._pieces
        shown = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in part], np.int64) for part in (self.a_bytes, self.b_bytes))

    @cached_property
    def written(self) -> list[str]:
        """Every id with each of the marks that may follow it, a mark after the other."""
        n = max(len(self.a_bytes), len(self.b_bytes))
        return [f"{i}{mark}" for mark in ",|;" for i in range(n)]

    def cuts(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides, by text; none for texts that don't come out as their bytes."""
        none = np.zeros(0, np.int32)
        a, b = [none] * len(texts), [none] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        for i, own in zip(some, self._pieces.encode([texts[i] for i in some], num_threads=1)):
            raw = b" " + texts[i].encode()
            if b"".join(map(self.b_bytes.__getitem__, own)) != raw:
                continue
            other = self._whole.encode(" " + texts[i], add_special_tokens=False).ids if RUN.search(texts[i]) else self._fast.encode_ordinary(" " + texts[i])
            if b"".join(map(self.a_bytes.__getitem__, other)) == raw:
                a[i], b[i] = np.array(other, np.int32), np.array(own, np.int32)
        return a, b


def read_tokenizers(spec: str, ranks: str, pattern: str, pieces: str) -> Tokenizers:
    """From paths: a byte-level file and the same vocabulary as ranks, and a piece model."""
    found = []
    for path in (spec, ranks, pieces):
        with open(path, "rb") as f:
            found.append(f.read())
    return Tokenizers(found[0], found[1], pattern, found[2])


@dataclass
class Groups:
    """Texts one after the other: ids of each side, the group of each token, and by group its text, tokens of each side and end."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    text: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    end: np.ndarray


def grouped(a: list[np.ndarray], b: list[np.ndarray], sizes: tuple[np.ndarray, np.ndarray]) -> Groups:
    ids = [np.concatenate([*x, np.zeros(0, np.int32)]) for x in (a, b)]
    ends = [np.cumsum(s[i]) for s, i in zip(sizes, ids)]  # texts have the same bytes on both sides, so their ends agree
    intervals = np.union1d(*ends)
    owners = [np.searchsorted(e, intervals) for e in ends]
    closed = (ends[0][owners[0]] == intervals) & (ends[1][owners[1]] == intervals)
    group = np.cumsum(closed) - closed
    of = [group[np.searchsorted(intervals, e)] for e in ends]
    end, n = intervals[closed], int(closed.sum())
    own = np.cumsum([int(sizes[0][x].sum()) for x in a])
    text = np.searchsorted(own, end)
    start = np.concatenate([[0], own])[text] if n else own[:0]
    return Groups(*ids, *of, text, *(np.bincount(o, minlength=n) for o in of), end - start)


def pairs(g: Groups, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(text * stride + pair, links) of all linked pairs of ids, sorted; a pair is a * width + b."""
    links = g.n_a * g.n_b
    begin_a, begin_b = np.cumsum(g.n_a) - g.n_a, np.cumsum(g.n_b) - g.n_b
    keys, many = [], []

    def add(text, a, b, n):
        key, back = np.unique(text * stride + a.astype(np.int64) * width + b, return_inverse=True)
        keys.append(key)
        many.append(np.bincount(back, weights=n).astype(np.int64) if n is not None else np.bincount(back))

    ends = np.cumsum(links)
    lo = 0
    while lo < links.size:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - links[lo] + BLOCK, "right")))
        if hi == lo + 1 and links[lo] > BLOCK:  # one large group: distinct ids with multiplicities
            (x, m), (y, k) = (np.unique(i[s : s + n], return_counts=True) for i, s, n in ((g.a, begin_a[lo], g.n_a[lo]), (g.b, begin_b[lo], g.n_b[lo])))
            step = max(1, BLOCK // y.size)
            for s in range(0, x.size, step):
                own = x[s : s + step]
                add(g.text[lo], np.repeat(own, y.size), np.tile(y, own.size), np.repeat(m[s : s + step], y.size) * np.tile(k, own.size))
        else:
            a = np.arange(begin_a[lo], begin_a[hi - 1] + g.n_a[hi - 1])
            times = g.n_b[g.of_a[a]]
            first = np.repeat(a, times)
            place = np.arange(first.size) - np.repeat(np.cumsum(times) - times, times)
            of = g.of_a[first]
            add(g.text[of], g.a[first], g.b[begin_b[of] + place], None)
        lo = hi
    if len(keys) == 1:
        return keys[0], many[0]
    key, back = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate([*many, np.zeros(0, np.int64)]), minlength=key.size).astype(np.int64)


def written(g: Groups, marks: list[str], texts: int) -> list[str]:
    """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
    wide = len(marks) // 3
    out = np.empty(g.a.size + g.b.size, np.int32)
    last = lambda of: np.append(of[1:] != of[:-1], True)[: of.size]
    end_a, begin_b = np.cumsum(g.n_a), np.cumsum(g.n_b) - g.n_b
    out[np.arange(g.a.size) + begin_b[g.of_a]] = g.a + wide * last(g.of_a)
    out[np.arange(g.b.size) + end_a[g.of_b]] = g.b + 2 * wide * last(g.of_b)
    ends = np.cumsum(np.bincount(g.text, weights=g.n_a + g.n_b, minlength=texts)).astype(np.int64)
    return ["".join([marks[c] for c in out[lo:hi].tolist()])[:-1] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]


def alignments(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """doc_id, ids of both sides, and of each group its tokens on either side and its end in the bytes of a space and the text."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    names = ("a_ids", "b_ids", "a_sizes", "b_sizes", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, rows = shared.value, []
            for a, b in zip(*t.cuts(batch.column(1).to_pylist())):
                g = grouped([a], [b], t.sizes)
                rows.append((g.a, g.b, g.n_a, g.n_b, g.end))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(5))], ["doc_id", *names])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id bigint, " + ", ".join(f"{c} array<bigint>" for c in names))


def chunks(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Chunks of documents: lists of what is known of each, the chunk's pairs and the documents that have each of them, and by document its
    pairs (places among the chunk's, and links of each; int32 and int64 as bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    lists = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "pairs", "docs")
    schema = pa.schema([("chunk", pa.int64()), *((c, pa.list_(pa.int64())) for c in lists), ("groups_sha256", pa.list_(pa.string())), ("place", pa.binary()), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def passed() -> pa.RecordBatch:
            t = shared.value
            ids, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in range(2))
            n = len(ids)
            a, b = t.cuts(texts.to_pylist())
            width = len(t.b_bytes)
            g, stride = grouped(a, b, t.sizes), width * len(t.a_bytes)
            key, links = pairs(g, width, stride)
            text, pair = np.divmod(key, stride)
            own, place = np.unique(pair, return_inverse=True)
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in written(g, t.written, n)]
            count = lambda w=None: np.bincount(g.text, weights=w, minlength=n).astype(np.int64)
            values = [number, ids.to_pylist(), count(g.n_a), count(g.n_b), count(), count(g.n_a * g.n_b), np.bincount(text, minlength=n), own, np.bincount(place, minlength=own.size), digests, place.astype(np.int32).tobytes(), links.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            lo = 0
            for k, m in enumerate(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                size += m
                if size >= CHUNK:
                    held.append(batch.slice(lo, k + 1 - lo))
                    yield passed()
                    held, size, number, lo = [], 0, number + 1, k + 1
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if held:
            yield passed()

    small_batches(docs.sparkSession)
    kinds = "chunk bigint, " + ", ".join(f"{c} array<bigint>" for c in lists) + ", groups_sha256 array<string>, place binary, links binary"
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), kinds))


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of rows of chunks: the documents that have the pair linked, and whether no other pair of its A id has more."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    return each.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / width))))


def linked_counts(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    rows = chunks(docs, tokenizers)
    counts = cut(pair_counts(rows, len(tokenizers.b_bytes)))
    found = rows.select("chunk", F.explode("pairs").alias("pair")).join(counts, "pair").select(F.col("chunk").alias("of"), "pair", "n", "best")
    names = ("n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", *names, "n_best", "count_sum")] + [("groups_sha256", pa.string())])

    def run(key, own: pa.Table, seen: pa.Table) -> pa.Table:
        flat = lambda c: pa.concat_arrays(own[c].chunks).flatten() if own.num_rows else pa.array([])
        order = np.argsort(seen["pair"].to_numpy(), kind="stable")
        n, best = seen["n"].to_numpy()[order], seen["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        place, links = np.frombuffer(own["place"][0].as_py(), np.int32), np.frombuffer(own["links"][0].as_py(), np.int64)
        text = np.repeat(np.arange(len(flat("doc_id"))), flat("n_pairs").to_numpy())
        total = np.zeros((2, len(flat("doc_id"))), np.int64)
        for out, each in zip(total, (best, n)):
            np.add.at(out, text, links * each[place]) if place.size else None
        return pa.Table.from_arrays([flat("doc_id"), *map(flat, names), pa.array(total[0]), pa.array(total[1]), flat("groups_sha256")], schema=schema)

    kinds = ", ".join(f"{c} bigint" for c in ("doc_id", *names, "n_best", "count_sum")) + ", groups_sha256 string"
    own = rows.select("chunk", "doc_id", *names, "n_pairs", "groups_sha256", "place", "links")
    return own.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, kinds)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    both = read_tokenizers(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
    return linked_counts(table(spark, sf_dir, "documents"), both)
