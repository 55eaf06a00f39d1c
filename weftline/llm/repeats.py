"""Removal of long repeated byte strings, by blockwise suffix sorting with difference-cover ranks.

A byte goes if some string of ``length`` bytes over it also starts anywhere else, in the same or another text.

Only suffixes that can have a partner are sorted, bucket by bucket:

1. Each window of ``length`` bytes of a text belongs to the bucket of its least string of a fifth of that length (its
   anchor, by fingerprint). Equal windows have equal anchors at equal places, so partners are always in one bucket, and a
   text has a run of windows for each of its anchors. Equal stretches under runs are one class; a class that stands at
   two places repeats whole, and a class alone in its bucket, at one place, repeats nowhere.
2. The suffixes of all other buckets, those that start at the windows of its classes, are sorted, a block of buckets at a
   time. First the suffixes at the places of a difference cover (places of the block modulo ``COVER``) get ranks in
   lexicographic order, by doubling. Then all suffixes are ordered by their first 16 bytes, and long ties by those ranks
   at the shift at which both suffixes reach the cover, so no two suffixes are compared byte by byte however long they
   agree. Suffixes of equal rank agree over the whole length.

A bucket with more than ``CLASSES`` classes (an edge of a passage that very many texts share) isn't sorted in one task: its windows are
dealt by 64-bit hashes to a part for each ``PART`` classes, in a row for each class and part, and those that a part has twice are found by
their hashes, which gives the same result for any size.
Stretches and texts are taken as equal by hashes too (128 bits with the anchor, 128 bits).

Null and empty texts have no bytes. Rows are kept one for one, whatever their ids; repeated rows are copies, so they lose
all of their bytes if these are ``length`` or more. Long texts are cut into runs of bounded size. Other columns are kept and may
have any names but ``__weft_sha``, ``__weft_salt`` and ``__weft_removed``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import plain_names, small_batches, table, tidied
from weftline.llm.hashing import fingerprints, prefix_sums, slide
from weftline.session import cut

#: Bytes of a repeated string: of the query, and of passages of some fifty words, which the pipeline removes.
LENGTH, PASSAGE = 400, 250
#: Bytes of a window to a byte of its anchor.
TO_ANCHOR = 5
#: Windows of a run at most, which bounds what is cut out of a periodic text at once.
RUN = 4096
#: Any two residues modulo COVER reach this difference cover by one shift of less than COVER.
COVER, DIFFERENCE_COVER = 3, (0, 1)
#: Bytes that suffixes are ordered by before ranks are needed.
HEAD = 16
#: Classes of a bucket that one task sorts at most, and bytes of a block of buckets that are sorted together.
CLASSES, BLOCK = 2000, 300_000
#: Classes of a larger bucket to a part, which a task counts.
PART = 250
#: Rows of copies of one text are dealt to so many tasks.
SALTS = 32


def runs(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first, last, anchor's fingerprint, stretch's hash, whether the anchor stands at several places of the text) of each
    run of windows with one anchor; runs of more than ``RUN`` windows are several."""
    anchor = length // TO_ANCHOR
    sums, width = prefix_sums(raw), length - anchor + 1
    at = np.arange(raw.size - anchor + 1)
    each = fingerprints(sums, at, at + anchor).view(np.int64)
    least = slide(each, width, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.concatenate([first, [least.size]]))
    if size.max() > RUN:
        parts = -(-size // RUN)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + inside * RUN
    last = np.concatenate([first[1:], [least.size]]) - 1
    # places of anchors: a string is one if a window that it is in has no smaller string
    border = np.full(width - 1, np.iinfo(np.int64).min)
    best = slide(np.concatenate([border, least, border]), width, np.maximum)
    values, n = np.unique(each[best == each], return_counts=True)
    several = np.isin(least[first], values[n > 1])
    view = memoryview(raw)
    stretch = np.fromiter((xxhash.xxh3_64_intdigest(view[lo : hi + length]) for lo, hi in zip(first.tolist(), last.tolist())), np.uint64, first.size)
    return first, last, least[first], stretch.view(np.int64), several.astype(np.int64)


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks by the key, equal for equal ones."""
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.zeros(order.size, np.int64)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    out = np.empty(order.size, np.int64)
    out[order] = np.cumsum(new)
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    most = int(b.max(initial=0)) + 1
    return _dense(a * most + b)


def cover_ranks(raw: np.ndarray, head: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Ranks of the suffixes at places of the difference cover (at these places of the array), and by how many bytes they
    are ordered: depth, or up to ``COVER`` - 1 less. head has the ranks of all places by ``HEAD`` bytes."""
    places = np.flatnonzero(np.isin(np.arange(raw.size) % COVER, DIFFERENCE_COVER))
    rank = np.zeros(raw.size + depth, np.int64)  # nothing is behind the end
    rank[places] = head[places] + 1
    reached = HEAD
    while (shift := min(reached, depth - reached) // COVER * COVER) > 0:
        rank[places] = _pairs(rank[places], rank[places + shift]) + 1
        reached += shift
    return rank, reached


def shift_of(r: int, s: int) -> int:
    """By how much places with these residues both reach the cover."""
    return next(d for d in range(COVER) if (r + d) % COVER in DIFFERENCE_COVER and (s + d) % COVER in DIFFERENCE_COVER)


def suffix_ranks(raw: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes at these places, by their first ``length`` bytes: how many are less than each, and how many equal it (itself included).

    Each start has so many bytes. Sorted by the first, the suffixes are a suffix array of that depth.
    """
    padded = np.concatenate([raw, np.zeros(HEAD, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (raw.size + 8, 8), (1, 1))
    word = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    eight = _dense(word)
    head = _pairs(eight[: raw.size], eight[8 : raw.size + 8])
    ranks, reached = cover_ranks(raw, head, length - COVER + 1)
    if length - reached > HEAD:
        raise ValueError("strings have to be longer")
    group, tail = head[start], head[start + length - HEAD]
    many = np.bincount(group)
    less, equal = (np.cumsum(many) - many)[group], np.ones(start.size, np.int64)
    tied = np.flatnonzero(many[group] > 1)
    residues = [tied[start[tied] % COVER == r] for r in range(COVER)]
    equal[tied] = 0
    bits = [int(x.max(initial=0)).bit_length() for x in (ranks, tail)]
    low = sum(bits)
    middle = {}
    if low + int(group.max(initial=0)).bit_length() > 62:  # a very large block: two ranks are made one
        middle = {d: _pairs(ranks[start + d], tail) for d in range(COVER)}
        low = max(int(x.max(initial=0)).bit_length() for x in middle.values())

    def key(own: np.ndarray, shift: int) -> np.ndarray:
        rest = middle[shift][own] if middle else (ranks[start[own] + shift] << bits[1]) + tail[own]
        return (group[own] << low) + rest

    def counted(own: np.ndarray, keys: np.ndarray, others: np.ndarray, first: np.ndarray) -> None:
        """Adds those of others (sorted keys) in the same group that are less than own, and those that are equal."""
        lo = np.searchsorted(others, keys, "left")
        less[own] += lo - np.searchsorted(others, first, "left")
        equal[own] += np.searchsorted(others, keys, "right") - lo

    for r in range(COVER):
        for s in range(r, COVER):
            a, b, d = residues[r], residues[s], shift_of(r, s)
            if not a.size or not b.size:
                continue
            x, y = key(a, d), key(b, d)
            i, j = np.argsort(x), np.argsort(y)
            a, b, x, y = a[i], b[j], x[i], y[j]
            counted(a, x, y, group[a] << low)
            if r != s:
                counted(b, y, x, group[b] << low)
    return less, equal


def repeated_in_block(stretches: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch of a block of buckets, distinct ones in each bucket, which of its windows occur in the block more than once."""
    sizes = np.array([len(s) for s in stretches])
    raw = np.frombuffer(b"".join(stretches), np.uint8)
    counts = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    start = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    _, equal = suffix_ranks(raw, start, length)
    return np.split(equal > 1, np.cumsum(counts)[:-1])


def _spans(first: int, repeated: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes under repeated windows, as [from, to), from a mask over windows."""
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(first + a, first + b - 1 + length) for a, b in zip(lo.tolist(), hi.tolist())]


def united(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _cells(names: str, kinds: dict[str, pa.DataType]) -> dict[str, tuple[list, pa.DataType]]:
    return {k: ([], kinds.get(k, pa.int64())) for k in names.split()}


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sha, spans) for texts (sha, doc_id, raw): what repeats, as merged [lo, hi), of texts with any; by distinct text."""
    spark = texts.sparkSession
    binary = {"sha": pa.binary(), "bytes": pa.binary(), "windows": pa.list_(pa.int64())}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _cells("sha first last anchor stretch several", binary)
            for sha, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = np.frombuffer(text, np.uint8)
                if raw.size >= length:
                    got = runs(raw, length)
                    out["sha"][0].extend([sha] * got[0].size)
                    for k, v in zip(("first", "last", "anchor", "stretch", "several"), got):
                        out[k][0].extend(v.tolist())
            yield _batch(out)

    small_batches(spark)
    every = texts.select("sha", "raw").mapInArrow(tidied(found), "sha binary, first bigint, last bigint, anchor bigint, stretch bigint, several bigint")
    # copies of a text are one; a class is a distinct stretch, with the number of its runs and one of them
    every = cut(every.distinct())
    place = F.struct("sha", "first", "last")
    classes = cut(every.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.max("several").alias("several"), F.min(place).alias("at")))
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.max("several").alias("several")).where("k > 1 or several = 1").drop("several")
    whole = every.join(classes.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"]).select("sha", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    doubtful = cut(classes.join(sizes, "anchor").select("anchor", "k", "n", "at.*"))
    # only classes of one run are in doubt, but any may be their partner
    doubtful = doubtful.join(doubtful.where("n = 1").select("anchor").distinct(), "anchor", "left_semi")
    asked = doubtful.groupBy("sha").agg(F.collect_list(F.struct("anchor", "k", "n", "first", "last")).alias("asked"))
    least = texts.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    asked = cut(asked.join(least, "sha").select(F.col("sha").alias("of"), F.col("doc_id").alias("least"), "asked"))
    small_batches(spark)
    # ids may be null
    sources = texts.join(asked, (F.col("sha") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("sha", "raw", "asked").dropDuplicates(["sha"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _cells("anchor sha first n bytes windows k", binary)
            for sha, raw, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for a in asked:
                    lo, hi = a["first"], a["last"]
                    big = a["k"] > CLASSES
                    # a signed hash for each window of a bucket that isn't sorted in one task
                    windows = np.array([xxhash.xxh3_64_intdigest(raw[i : i + length]) for i in range(lo, hi + 1)], np.uint64).view(np.int64) if big else None
                    for k, v in (("anchor", a["anchor"]), ("sha", sha), ("first", lo), ("n", a["n"]), ("bytes", None if big else raw[lo : hi + length]), ("windows", windows), ("k", a["k"])):
                        out[k][0].append(v)
            yield _batch(out)

    small_batches(spark, 64)
    pieces = cut(sources.mapInArrow(tidied(cut_out), "anchor bigint, sha binary, first bigint, n bigint, bytes binary, windows array<bigint>, k bigint"))

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after the other; a block of whole ones is sorted at a time."""
        held: list[dict] = []
        size = 0

        def sorted_out() -> pa.RecordBatch:
            out = _cells("sha lo hi", binary)
            for r, repeated in zip(held, repeated_in_block([r["bytes"] for r in held], length) if held else []):
                for lo, hi in _spans(r["first"], repeated, length) if r["n"] == 1 else []:
                    for k, v in (("sha", r["sha"]), ("lo", lo), ("hi", hi)):
                        out[k][0].append(v)
            held.clear()
            return _batch(out)

        for b in batches:
            for r in b.to_pylist():
                if size > BLOCK and held[-1]["anchor"] != r["anchor"]:
                    yield sorted_out()
                    size = 0
                held.append(r)
                size += len(r["bytes"])
        yield sorted_out()

    small = pieces.where("bytes is not null").drop("windows", "k").repartition("anchor").sortWithinPartitions("anchor")
    small = small.mapInArrow(tidied(sort_blocks), "sha binary, lo bigint, hi bigint")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of a class, dealt by their hashes to parts of its bucket: a row for each part that has any."""
        for b in batches:
            out = _cells("anchor part sha first n places windows", dealt)
            for anchor, sha, first, n, windows, k in zip(*(b.column(c).to_pylist() for c in range(6))):
                each = np.array(windows, np.int64)
                part = each % -(-k // PART)
                order = np.argsort(part, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    for c, v in (("anchor", anchor), ("part", int(part[own[0]])), ("sha", sha), ("first", first), ("n", n), ("places", own.astype(np.int32).tobytes()), ("windows", each[own].tobytes())):
                        out[c][0].append(v)
            yield _batch(out)

    def count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come one after the other. Of one, distinct hashes are held, each with its place until it comes again."""
        current, seen = None, {}
        for b in batches:
            out = _cells("sha lo hi", binary)

            def add(sha: bytes, first: int, places: list[int]) -> None:
                for lo, hi in united([(first + i, first + i + length) for i in places]):
                    for c, v in (("sha", sha), ("lo", lo), ("hi", hi)):
                        out[c][0].append(v)

            for anchor, part, sha, first, n, places, windows in zip(*(b.column(c).to_pylist() for c in range(7))):
                if current != (anchor, part):
                    current, seen = (anchor, part), {}
                row, twice = (sha, first), []
                for place, window in zip(np.frombuffer(places, np.int32).tolist(), np.frombuffer(windows, np.int64).tolist()):
                    if window not in seen:
                        seen[window] = (row, place) if n == 1 else None  # a class of several runs repeats whole
                        continue
                    if before := seen[window]:
                        add(*before[0], [before[1]])
                        seen[window] = None
                    twice.append(place)
                if n == 1:
                    add(sha, first, twice)
            yield _batch(out)

    dealt = binary | {"windows": pa.binary(), "places": pa.binary()}
    parts = pieces.where("windows is not null").select("anchor", "sha", "first", "n", "windows", "k").mapInArrow(tidied(deal), "anchor bigint, part bigint, sha binary, first bigint, n bigint, places binary, windows binary")
    large = parts.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(tidied(count_parts), "sha binary, lo bigint, hi bigint")
    return _united(whole.unionByName(small).unionByName(large))


def _united(spans: DataFrame) -> DataFrame:
    """(sha, spans: merged) of (sha, lo, hi)."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = [united([(x["lo"], x["hi"]) for x in s]) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(merged, pa.list_(pa.list_(pa.int64())))], ["sha", "spans"])

    return spans.groupBy("sha").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).mapInArrow(tidied(unite), "sha binary, spans array<array<bigint>>")


def _sha(raw: Column) -> Column:
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)


def _raw(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b""))


def spans_of_texts(docs: DataFrame, length: int) -> DataFrame:
    """(sha, copies, doc_id: the least, size, spans) of the distinct texts of docs (doc_id, text) with so many bytes; spans may be null."""
    raw = _raw(F.col("text"))
    texts = docs.where(F.octet_length("text") >= length).select(_sha(raw).alias("sha"), F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    copies = texts.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max(F.octet_length("raw")).cast("long").alias("size"))
    return copies.join(repeated_spans(texts, length), "sha", "left")


def longer(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(sha, spans) for a greater length, from what spans_of_texts has found for a lesser one.

    A longer repeat lies, with its partners, within the shorter ones; so these pieces are all that is sorted anew.
    """
    raw = _raw(F.col("text"))
    some = found.select(F.col("sha").alias("of"), F.col("doc_id").alias("least"), F.filter("spans", lambda s: s[1] - s[0] >= length).alias("spans")).where(F.size("spans") > 0)
    texts = docs.where(F.octet_length("text") >= length).select(_sha(raw).alias("sha"), F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    texts = texts.join(some, (F.col("sha") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["sha"])
    piece = F.transform("spans", lambda s: F.struct(s[0].alias("lo"), F.substr("raw", (s[0] + 1).cast("int"), (s[1] - s[0]).cast("int")).alias("raw")))
    pieces = texts.select("sha", F.explode(piece).alias("p")).select("sha", "p.lo", "p.raw")
    pieces = cut(pieces.select(F.col("sha").alias("text_sha"), "lo", _sha(F.col("raw")).alias("sha"), F.xxhash64("sha", "lo").alias("doc_id"), "raw"))
    copies = pieces.groupBy("sha").agg(F.count("*").alias("copies"), F.max(F.octet_length("raw")).cast("long").alias("size"))
    inside = copies.join(repeated_spans(pieces.select("sha", "doc_id", "raw"), length), "sha", "left")
    inside = inside.select("sha", F.when(F.col("copies") > 1, F.array(F.array(F.lit(0).cast("long"), F.col("size")))).otherwise(F.col("spans")).alias("inside")).where("inside is not null")
    back = pieces.select("sha", "text_sha", F.col("lo").alias("from")).join(cut(inside), "sha").select(F.col("text_sha").alias("sha"), F.explode("inside").alias("s"), "from")
    return _united(back.select("sha", (F.col("s")[0] + F.col("from")).alias("lo"), (F.col("s")[1] + F.col("from")).alias("hi")))


def with_spans(docs: DataFrame, *lengths: int) -> DataFrame:
    """All rows and columns of docs (doc_id, text, ...), and a column ``__weft_removed`` for each length (falling, the last
    one being sorted for in whole texts): arrays of the repeated spans of each text, merged, or null.

    Rows of copies are dealt to several tasks, and the spans of a text that has copies along with them.
    """
    sha = _sha(_raw(F.col("text")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*own, sha.alias("__weft_sha"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("__weft_salt"))
    spans = spans_of_texts(docs, lengths[-1])
    if len(lengths) > 1:
        spans = cut(spans)
    for k, length in enumerate(lengths):
        these = spans
        if length != lengths[-1]:
            these = spans.drop("spans").join(longer(docs, spans, length), "sha", "left")
        whole = F.array(F.array(F.lit(0).cast("long"), F.col("size")))
        these = these.select("sha", "copies", "doc_id", F.when((F.col("copies") > 1) & (F.col("size") >= length), whole).otherwise(F.col("spans")).alias("removed")).where("removed is not null")
        salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
        dealt = cut(these.select(F.col("sha").alias("__weft_sha"), F.explode(salts.cast("array<bigint>")).alias("__weft_salt"), F.col("removed").alias(f"__weft_removed{k}")))
        keyed = keyed.join(dealt, ["__weft_sha", "__weft_salt"], "left")
    return keyed.select(*own, *(F.col(f"__weft_removed{k}") for k in range(len(lengths))))


def kept_bytes(raw: bytes, removed: list[list[int]] | None) -> bytes:
    if not removed:
        return raw
    out, at = [], 0
    for lo, hi in removed:
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[list[int]] | None) -> list[list[int]]:
    """The spans without the bytes of characters that they cut."""
    out = []
    for lo, hi in spans or []:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append([lo, hi])
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows of docs with what repeats cut out of their texts (whole characters only), n_chars following if there."""
    names, docs = docs.columns, plain_names(docs, "doc_id", "text", "n_chars")
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist()):
                raw = (text or "").encode()
                texts.append(kept_bytes(raw, whole_characters(raw, spans)).decode() if spans else text)
            kept = list(b.columns[: len(columns)])
            kept[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(kept, columns)

    rows = with_spans(docs, length)
    small_batches(docs.sparkSession)
    out = rows.mapInArrow(tidied(run), docs.schema)
    if "n_chars" in columns:
        size = F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))
    return out.toDF(*names)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for docs (doc_id, text), by strings of ``LENGTH`` bytes, and
    n_passage_bytes: the bytes under strings of ``PASSAGE`` bytes that start elsewhere too, which are not removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, n, digests, passages = [], [], [], [], []
            for text, spans, shorter in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw = (text or "").encode()
                sizes.append(len(raw))
                gone.append(sum(hi - lo for lo, hi in spans or []))
                n.append(len(spans or []))
                digests.append(hashlib.sha256(kept_bytes(raw, spans)).hexdigest())
                passages.append(sum(hi - lo for lo, hi in shorter or []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(digests), pa.array(passages, pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    docs = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), LENGTH, PASSAGE)
    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidied(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_bytes bigint")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
