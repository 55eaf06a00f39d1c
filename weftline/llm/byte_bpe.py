"""Byte-level BPE encoding and decoding.

Ranked merges are folded over byte arrays of distinct words by Spark's higher-order functions, with the vocabulary's
merges as one literal rank map; decoding concatenates binary pieces.

Shape: texts are gathered into chunks of at most ``CHUNK`` bytes (or one text), of which each distinct stretch between spaces is
looked at once. A count over the whole corpus finds the words that are no vocabulary entry themselves and that most stretches
have (at most ``DICTIONARY``, the bound of what the driver and a broadcast hold); these are folded once each. All other distinct words
of a chunk are folded in the row of their chunk, so no text is shuffled, and nothing is dropped whatever the size of the corpus.
Words are found by hash and then compared. Words of more than ``LONG`` bytes, where a fold takes quadratic time, are
merged with a heap in the worker: the same merges, hence the same ids.

Null texts count as empty: no ids, the digests of nothing. Rows are kept one for one, repeated ids too; other columns
of the input don't matter. A text of any length is encoded whole, in a chunk of its own if it is long. An empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, table, tidied
from weftline.session import cut, trim

#: Words of more bytes than this are merged in the worker.
LONG = 64
#: Bytes of text in a chunk, and words whose ids are broadcast at most, about 50 bytes each.
CHUNK, DICTIONARY = 6 << 20, 1_000_000
#: Stretches whose ids a worker remembers from chunk to chunk.
REMEMBERED = 150_000
#: Texts that are assembled together.
TOGETHER = 256
#: Buckets of the literal rank map.
BUCKETS = 1 << 14
#: Marks keys of the rank map.
KEY = 1 << 50
#: Ids and ranks are below 2^20; a pair without a rank has this one.
BITS, NO_RANK = 20, 1 << 30
LOW = (1 << BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges with a heap of pairs: n log n, for words too long to fold."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    nxt, prv, piece = list(range(1, n + 1)), list(range(-1, n - 1)), [word[i : i + 1] for i in range(n)]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not piece[i] or (j := nxt[i]) >= n or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i], piece[j] = piece[i] + piece[j], b""
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for a, b in ((i, nxt[i]), (prv[i], i)):
            if a >= 0 and b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, len(piece[a]) + len(piece[b])))
    return [ranks[p] for p in piece if p]


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Pairs of ids and the id of what they merge to, as one literal.

    A map of Spark is searched from end to end, so the literal is an array of buckets, each a few keys with the rank
    right after its key. A key is 2^50 + left * 2^20 + right.
    """
    buckets: list[list[int]] = [[NO_RANK] for _ in range(BUCKETS)]
    for word, rank in ranks.items():
        for i in range(1, len(word)):
            left, right = ranks.get(word[:i]), ranks.get(word[i:])
            if left is not None and right is not None:
                buckets[(left * 31 + right) % BUCKETS] += [KEY + (left << BITS) + right, rank]
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, and written once into the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(words: Column, merges: Column) -> Column:
    """The ids of words, from the ids of their bytes (array<array<bigint>>), by folding merges of least rank, leftmost first."""
    return _let(merges, lambda m: F.transform(words, lambda w: _fold(w, m)))


def _fold(word: Column, merges: Column) -> Column:
    """Folds over an array of rank * 2^20 + id; the rank is that of the pair which the entry makes with the next."""
    empty = F.array().cast("array<bigint>")

    def entry(left: Column, right: Column) -> Column:
        bucket = F.get(merges, F.pmod(left * 31 + right, F.lit(BUCKETS)).cast("int"))
        # array_position counts from 1 and get from 0: the entry after the key, or the first, which says that there is none
        rank = _let(bucket, lambda b: F.get(b, F.array_position(b, F.lit(KEY) + left * (1 << BITS) + right).cast("int")))
        return F.coalesce(rank, F.lit(NO_RANK)) * (1 << BITS) + left

    n = F.size(word)
    first = F.transform(F.sequence(F.lit(1), n), lambda i: entry(F.get(word, i - 1), F.get(word, i)))

    def step(acc: Column, _: Column) -> Column:
        def merged(least: Column) -> Column:
            def at(i: Column) -> Column:
                new = F.shiftright(least, BITS)
                before = F.when(i > 1, F.array(entry(F.get(acc, i - 2).bitwiseAND(LOW), new))).otherwise(empty)
                after = F.array(entry(new, F.get(acc, i + 1).bitwiseAND(LOW)))
                return F.concat(F.slice(acc, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(acc, i + 2, n))

            return F.when(least >= F.lit(NO_RANK << BITS), acc).otherwise(_let(F.array_position(acc, least).cast("int"), at))

        return _let(F.array_min(acc), merged)

    folded = F.aggregate(F.sequence(F.lit(2), n), first, step, lambda acc: F.transform(acc, lambda e: e.bitwiseAND(LOW)))
    return F.when(n < 2, word).otherwise(folded)


def _bytes_of(words: list[bytes], to_id: bytes) -> pa.ListArray:
    """Words as arrays of their bytes' ids."""
    flat = np.frombuffer(b"".join(words).translate(to_id), np.uint8).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _byte_ids(ranks: dict[bytes, int]) -> bytes:
    ids = [ranks[bytes([b])] for b in range(256)]
    if max(ids) > 255:
        raise ValueError("the single bytes have to come first in the ranks")
    return bytes(ids)


class Words:
    """The words of a chunk that have to be folded, numbered -1, -2 ... as they are met, and the codes of stretches of text: ids, and
    these numbers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.vocabulary, self.ids = pa.array(list(ranks), pa.binary()), np.fromiter(ranks.values(), np.int32, len(ranks))
        self.number: dict[bytes, int] = {}
        self.ready: dict[str, list[int]] = {}

    def codes(self, stretch: str) -> list[int]:
        if (out := self.ready.get(stretch)) is not None:
            return out
        out = []
        for x in self.find(stretch):
            w = x.encode()
            if (rank := self.ranks.get(w)) is not None:
                out.append(rank)
            elif len(w) > LONG:
                out += heap_merge(w, self.ranks)
            else:
                out.append(self.number.setdefault(w, -1 - len(self.number)))
        if len(self.ready) < REMEMBERED and len(stretch) < LONG and min(out, default=0) >= 0:  # the same in any chunk
            self.ready[stretch] = out
        return out

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all texts, how many each has). Texts are cut before single spaces, where no match of the pattern goes across,
        and each distinct stretch is looked at once; those in which spaces meet are not cut."""
        texts = texts.fill_null("")
        uncut = pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~uncut)), " ")
        lengths = np.ones(len(texts), np.int64)
        lengths[~uncut] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(split).dictionary_encode()
        row, first = np.repeat(np.arange(lengths.size), lengths), np.cumsum(lengths) - lengths
        which = np.empty(row.size, np.int64)
        which[~uncut[row]] = coded.indices.to_numpy(zero_copy_only=False)
        # the stretch at the begin of a text has no space before it
        which[first] = len(coded.dictionary) + np.arange(lengths.size)
        begins = [t if whole else t.split(" ", 1)[0] for t, whole in zip(texts.to_pylist(), uncut.tolist())]
        stretches = pa.concat_arrays([pc.binary_join_element_wise(" ", coded.dictionary, ""), pa.array(begins, pa.string())])
        # letters alone after a space are one word, mostly of the vocabulary
        single = np.zeros(len(stretches), bool)
        single[: len(coded.dictionary)] = pc.utf8_is_alpha(coded.dictionary).to_numpy(zero_copy_only=False)
        single &= pc.binary_length(stretches).to_numpy() <= LONG
        one = stretches.cast(pa.binary()).filter(pa.array(single))
        found = pc.index_in(one, value_set=self.vocabulary)
        new = found.is_null().to_numpy(zero_copy_only=False)
        code = self.ids[found.fill_null(0).to_numpy()]
        code[new] = [self.number.setdefault(w, -1 - len(self.number)) for w in one.filter(pa.array(new)).to_pylist()]
        more, many = array("i"), array("q")
        for stretch in stretches.filter(pa.array(~single)).to_pylist():
            codes = self.codes(stretch) if stretch else []
            more.extend(codes)
            many.append(len(codes))
        sizes = np.ones(single.size, np.int64)
        sizes[~single] = many
        flat = np.empty(sizes.sum(), np.int32)
        at = np.repeat(single, sizes)
        flat[at], flat[~at] = code, more
        start = np.cumsum(sizes) - sizes
        each = sizes[which]
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return flat[np.repeat(start[which], each) + inside], np.bincount(row, weights=each, minlength=lengths.size).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows in chunks of so many bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for lo in range(0, b.num_rows, 32):
            held.append(b.slice(lo, 32))
            size += pc.sum(pc.binary_length(held[-1].column(column))).as_py() or 0
            if size > CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int) -> DataFrame:
    """(word, n): words of the corpus that are no vocabulary entry, so many at most, those of most stretches."""
    small_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, 0):
            counts = pc.value_counts(pc.list_flatten(pc.split_pattern(pa.concat_arrays([b.column(0) for b in held]).fill_null(""), " ")))
            for lo in range(0, len(counts), 20_000):
                some = counts.slice(lo, 20_000)
                yield pa.RecordBatch.from_arrays([some.field("values"), some.field("counts")], ["stretch", "n"])

    def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, find = vocabulary.value, regex.compile(pattern).findall
        for b in batches:
            words = [(w, n) for stretch, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in find(" " + stretch) if (w := x.encode()) not in ranks and len(w) <= LONG]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.binary()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

    # stretches are counted first, so that each is cut into words once; one that occurs once has no frequent words
    found = docs.select("text").mapInArrow(tidied(count), "stretch string, n bigint").groupBy("stretch").agg(F.sum("n").alias("n")).where("n > 1")
    found = cut(found.mapInArrow(tidied(cut_words), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total, least = 0, 1 << 62
    for r in found.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("size")).collect():
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return found.where(F.col("n") >= least).select("word")


class Known:
    """Ids of many words in flat arrays, by the words' hashes."""

    def __init__(self, words: pa.Array, ids: pa.ListArray):
        prints = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
        by = np.argsort(prints)
        size = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat, self.prints, self.words = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), prints[by], words.take(pa.array(by))
        self.first, self.size = (np.cumsum(size) - size)[by], size[by]

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin and how many they are; 0 for an unknown word."""
        if not self.prints.size or not words:
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.prints, own), self.prints.size - 1)
        same = pc.equal(self.words.take(pa.array(at)), pa.array(words, pa.binary())).to_numpy(zero_copy_only=False)
        return self.first[at], np.where(same, self.size[at], 0)


def folded_chunks(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int) -> DataFrame:
    """A row a chunk: doc_id and size (number of codes) of each text, codes (int32 as bytes; -1, -2 ... for words that are
    folded here), and folded (the ids of these words)."""
    spark = docs.sparkSession
    merges, to_id = rank_map(ranks), _byte_ids(ranks)
    small_batches(spark)

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _bytes_of(b.column(0).to_pylist(), to_id)], ["word", "bytes"])

    words = frequent_words(docs, ranks, pattern, most).mapInArrow(tidied(as_bytes), "word binary, bytes array<bigint>")
    table = words.select("word", F.get(fold_merges(F.array("bytes"), merges), F.lit(0)).cast("array<int>").alias("ids")).toArrow()
    columns = [table[c].combine_chunks() for c in ("word", "ids")]
    del table
    shared = spark.sparkContext.broadcast((Known(*(c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns)), ranks))
    del columns
    trim()  # the driver has done with the words

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shared.value
        words = Words(ranks, pattern)
        for held in gathered(batches, 1):
            words.number = {}
            codes, sizes = words.coded(pa.concat_arrays([b.column(1) for b in held]))
            new = list(words.number)
            first, size = known.find(new)
            number = -np.cumsum(size == 0)  # what is left is numbered anew
            at = np.flatnonzero(codes < 0)
            word = -1 - codes[at]
            row, each = np.repeat(np.arange(sizes.size), sizes), np.ones(codes.size, np.int64)
            each[at] = np.maximum(size[word], 1)
            codes = codes.copy()
            codes[at] = number[word]
            found = size[word] > 0
            codes = filled(codes, at[found], first[word[found]], size[word[found]], known.flat)
            sizes = np.bincount(row, weights=each, minlength=sizes.size).astype(np.int64)
            ids = pa.concat_arrays([b.column(0) for b in held]).to_pylist()
            left = _bytes_of([w for w, n in zip(new, size.tolist()) if not n], to_id)
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), left)], ["doc_id", "size", "codes", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(gather), "doc_id array<bigint>, size array<bigint>, codes binary, bytes array<array<bigint>>")
    small_batches(spark, 1)
    return rows.select("doc_id", "size", "codes", fold_merges(F.col("bytes"), merges).cast("array<array<int>>").alias("folded"))


def filled(ids: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """ids with flat[first : first + size] in place of each entry at the places given."""
    if not at.size:
        return ids
    each = np.ones(ids.size, np.int64)
    each[at] = size
    out = np.repeat(ids, each)
    start = (np.cumsum(each) - each)[at]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(start, size) + inside] = flat[np.repeat(first, size) + inside]
    return out


def assembled(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of all texts, how many each has) of rows of folded_chunks, some texts at a time."""
    for k in range(batch.num_rows):
        doc_id, size, raw, folded = (batch.column(c).slice(k, 1) for c in range(4))
        words = folded.flatten()
        many = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, first = words.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(many) - many
        doc_id, size, codes = doc_id.flatten(), size.flatten().to_numpy(), np.frombuffer(raw[0].as_py(), np.int32)
        end = np.cumsum(size)
        for lo in range(0, size.size, TOGETHER):
            some = size[lo : lo + TOGETHER]
            own = codes[end[lo] - size[lo] : end[lo + some.size - 1]]
            at = np.flatnonzero(own < 0)
            word = -1 - own[at]
            row = np.repeat(np.arange(some.size), some)
            each = np.ones(own.size, np.int64)
            each[at] = many[word]
            yield doc_id.slice(lo, TOGETHER), filled(own, at, first[word], many[word], flat), np.bincount(row, weights=each, minlength=some.size).astype(np.int64)


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = DICTIONARY) -> DataFrame:
    """doc_id, ids (array<int>): the ids of each text, each match of the pattern merged by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, ids, sizes in assembled(b):
                yield pa.RecordBatch.from_arrays([doc_id, _lists(ids, sizes)], ["doc_id", "ids"])

    return folded_chunks(docs, ranks, pattern, most).mapInArrow(tidied(run), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds decoded (binary): the pieces of each row's ids, concatenated."""
    pieces = encoded.sparkSession.sparkContext.broadcast({r: w for w, r in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = pieces.value
        for b in batches:
            texts = [b"".join([by_id[i] for i in ids]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False, most: int = DICTIONARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, and its ids if asked for: encoded, decoded and digested."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id, text_of = {r: w for w, r in shared.value.items()}, {r: str(r) for r in shared.value.values()}
        for b in batches:
            for doc_id, flat, sizes in assembled(b):
                ids_sha, decoded_sha, at = [], [], 0
                for n in sizes.tolist():
                    ids = flat[at : at + n].tolist()
                    at += n
                    ids_sha.append(hashlib.sha256(",".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join(map(by_id.__getitem__, ids))).hexdigest())
                columns = [doc_id, pa.array(sizes, pa.int64()), *[_lists(flat, sizes)] * with_ids]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    return folded_chunks(docs, ranks, pattern, most).mapInArrow(tidied(run), f"doc_id bigint, n_tokens bigint, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
