"""N-gram Jaccard join with prefixes under several global token orders.

Tokens are 64-bit fingerprints of word n-grams. Two sets of similarity t share a token among the first
floor((1 - t) n) + 1 of each, under any order of all tokens; so candidates have to share prefix tokens under several.

* Order 1 finds candidates. It puts tokens that many texts share last (rarest first among them), so that boilerplate
  hardly enters a prefix. Which tokens those are, at most ``DEMOTED``, comes from counts over the whole corpus; the order
  is a matter of speed only, any order gives the same links.
* A candidate is screened by the sizes of its sets and by bitmaps of their tokens, which bound the intersection from above.
* Orders 2 and 3 are hash orders. What two sets have among their first tokens under each (32 bits of them) is intersected
  before anything of the texts is moved; a candidate stays only if the prefixes meet under both.
* What is left is verified by the exact size of the intersection, of token sets that were made once for each of them.

Equal sets are one class from the start, so copies are never paired. Pairs are not listed within a prefix list: first
each member is compared with a few leaders of its list, and components are formed; only members of different components
that a length and position bound allows are then compared too. That finds the same components as all pairs would.
Lists are joined, not collected, so a hot one is split by the adaptive join.

Null, empty and wordless texts have an empty set and link with nothing. Rows are kept one for one; rows that share a
doc_id count as one document for links, whatever their texts are. A null doc_id is never a partner, its component is null. Sets
are equal where 128-bit hashes are. A text of any length is read whole. Columns other than doc_id and text don't matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import plain_names, small_batches, table, tidied
from weftline.llm.hashing import STURDY, fingerprints, mix, prefix_sums
from weftline.operators.components import connected_components
from weftline.session import cut, discard

WORDS = 5
#: Similarity from which documents link: so many hundredths.
PERCENT = 80
#: Tokens that order 1 puts last, at most: 16 bytes each in a broadcast.
DEMOTED = 200_000
#: A token is counted where a stretch of the corpus of so many tokens has it in so many different texts.
STRETCH, REPEATED = 4_000_000, 2
#: Bits of the sieve for texts to verify, as a power of two (2 MB).
SIEVE = 24
ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams of words of a text as sorted fingerprints; a shorter text is one n-gram."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not raw.size:
        return np.zeros(0, np.uint64)
    gap = np.concatenate([[True], _GAP[raw], [True]])
    lo, hi = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    if not lo.size:
        return np.zeros(0, np.uint64)
    lowered = _LOWER[raw]
    each = fingerprints(prefix_sums(lowered), lo, hi)
    for i in np.flatnonzero(hi - lo > STURDY).tolist():  # sums over long ranges have known collisions
        each[i] = xxhash.xxh3_64_intdigest(lowered[lo[i] : hi[i]].tobytes())
    k = min(words, each.size)
    n = each.size - k + 1
    total = np.full(n, np.uint64(k))
    for i in range(k):
        total = total * np.uint64(0x9FB21C651E98DF25) + each[i : i + n]
    return np.unique(mix(total))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many first tokens two sets of the similarity can't both do without."""
    return n - -(-percent * n // 100) + 1 if n else 0


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union."""
    n, m = x.size, y.size
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (n + m - both)


def first_tokens(tokens: np.ndarray, order: np.uint64, percent: int = PERCENT) -> np.ndarray:
    """32 bits of each of the first tokens under a hash order."""
    size = prefix_size(tokens.size, percent)
    if not size:
        return np.zeros(0, np.int32)
    return (np.partition(tokens * order, size - 1)[:size] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each leading-bits value of the tokens: twice as many bits as tokens at least, 2^16 at most."""
    size = min(16, max(6, int(2 * tokens.size).bit_length()))
    bits = np.zeros(1 << size, bool)
    bits[(tokens >> np.uint64(64 - size)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def most_common(n: int, x: bytes, m: int, y: bytes) -> int:
    """An upper bound of the intersection of sets of n and m tokens with these bitmaps.

    Shared tokens have shared bits, and a set has as many tokens beyond one to a bit as it is larger than its bit count.
    """
    a, b = (np.unpackbits(np.frombuffer(v, np.uint8)).astype(bool) for v in (x, y))
    size = min(a.size, b.size)
    a, b = a.reshape(size, -1).any(1), b.reshape(size, -1).any(1)
    return int((a & b).sum() + min(n - a.sum(), m - b.sum()))


def _fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _frequent(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Each row's (doc_id, n, fp), and the tokens to put last with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one buffer, sorted where it lies: several copies of it would not fit beside other workers
        held, size, seen = np.empty(STRETCH, np.uint64), 0, set()

        def counted() -> pa.RecordBatch:
            part = held[:size]
            part.sort()
            first = np.flatnonzero(np.concatenate([np.ones(min(size, 1), bool), part[1:] != part[:-1]]))
            n = np.diff(np.append(first, size))
            first, n = first[n >= REPEATED], n[n >= REPEATED]
            nothing = [pa.nulls(first.size, t) for t in (pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(part[first].view(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "n", "fp", "token", "seen"])

        for b in batches:
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            prints = [_fingerprint(s) for s in sets]
            nothing = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array(prints, pa.binary()), nothing, nothing], ["doc_id", "n", "fp", "token", "seen"])
            for s, f in zip(sets, prints):
                if f in seen:
                    continue
                if size + s.size > held.size:
                    yield counted()
                    size, seen = 0, set()
                    if s.size > held.size:
                        held = np.empty(s.size, np.uint64)
                seen.add(f)
                held[size : size + s.size] = s
                size += s.size
        yield counted()

    small_batches(docs.sparkSession)
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id bigint, n bigint, fp binary, token bigint, seen bigint"))
    tokens = rows.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    tokens = cut(tokens.where(F.col("seen") > 2 * REPEATED))
    total, least = 0, 1 << 62
    for r in tokens.groupBy(F.floor(F.log2("seen") * 8).alias("size")).agg(F.count("*").alias("k"), F.min("seen").alias("seen")).orderBy(F.desc("size")).collect():
        total += r["k"]
        if total > DEMOTED:
            break
        least = r["seen"]
    last = tokens.where(F.col("seen") >= least).toArrow()
    token, seen = last["token"].to_numpy().astype(np.int64).view(np.uint64), last["seen"].to_numpy()
    place = np.zeros(token.size, np.int64)
    place[np.lexsort((token, seen))] = np.arange(token.size)
    by = np.argsort(token)
    return rows.where("fp is not null").select("doc_id", "n", "fp"), token[by], place[by]


def _prefix(tokens: np.ndarray, last: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens under order 1."""
    size = prefix_size(tokens.size, percent)
    if not last.size or not size:
        return tokens[:size]
    at = np.minimum(np.searchsorted(last, tokens), last.size - 1)
    common = last[at] == tokens
    rare = tokens[~common][:size]
    return np.concatenate([rare, tokens[common][np.argsort(place[at[common]])][: size - rare.size]])


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, tokens) of the classes wanted (id, doc_id, fp): a bitmap of 2^SIEVE bits, whatever the number of ids, lets few other
    rows of docs through, so that few texts are cut into n-grams and the exact join moves few sets."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SIEVE))
    bits_of = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (SIEVE - 6), np.int64)
    bits[bits_of["word"].to_numpy().astype(np.int64)] = bits_of["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            p = b.column(2).to_numpy()
            out = b.filter(pa.array((bits[p >> 6] >> (p & 63)) & 1 == 1))
            if out.num_rows:
                sets = [shingles(t, words) for t in out.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "fp", "tokens"])

    small_batches(docs.sparkSession)
    found = docs.where("doc_id is not null").select("doc_id", "text", place.alias("p")).mapInArrow(tidied(run), "doc_id bigint, fp binary, tokens binary")
    return found.join(wanted, ["doc_id", "fp"]).select("id", "tokens").dropDuplicates(["id"])


def _meeting(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """Pairs (a, b) whose prefixes meet under each of the other orders; orders has id, first2, first3."""
    of = lambda c: orders.select(F.col("id").alias(c), F.col("first2").alias(f"{c}2"), F.col("first3").alias(f"{c}3"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar. The sets of each pair meet by two joins."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = cut(wanted.join(classes.select("id", "doc_id", "fp"), "id"))
    sets = cut(_sets(docs, wanted, words), [wanted])
    side = lambda c: sets.select(F.col("id").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(tidied(run), "a bigint, b bigint"), [sets])


def _apart(pairs: DataFrame, part: DataFrame | None, tried: DataFrame | None) -> DataFrame:
    """Pairs that are not in one component yet and haven't been tried."""
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    if part is None:
        return pairs
    of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _screened(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(k).to_pylist() for k in range(2, 6))
            keep = [(100 + percent) * most_common(*v) >= percent * (v[0] + v[2]) for v in zip(n, x, m, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(tidied(run), "a bigint, b bigint")


def _linked(docs: DataFrame, pairs: DataFrame, links: DataFrame | None, part: DataFrame | None, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The links so far with those of pairs, and their components."""
    screened = _screened(pairs, classes.select("id", "n", "bits"), percent)
    pairs = cut(_meeting(screened, classes.select("id", "first2", "first3")))
    if pairs.isEmpty():
        return links, part
    found = _verify(docs, pairs, classes, words, percent)
    links = found if links is None else links.unionByName(found)
    return links, connected_components(links)


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, id) of each class, with its least document; the id is that document, or a hash where several classes have the
    same one. And links (a, b) between classes that a doc_id with several texts has."""
    own = rows.where("n > 0 and doc_id is not null")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    first = least.groupBy("doc_id").agg(F.min("fp").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    classes = cut(least.join(first, "doc_id", "left").select("doc_id", "fp", F.when(F.col("first").isNull() | (F.col("first") == F.col("fp")), F.col("doc_id")).otherwise(F.xxhash64("fp")).alias("id")))
    several = own.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    of = own.join(several, "doc_id", "left_semi").select("doc_id", "fp").distinct().join(classes.select("fp", "id"), "fp")
    return classes, cut(of.join(of.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b"))


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for docs (doc_id, text), a row for each of its rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, last, place = _frequent(docs, words)
    shared = spark.sparkContext.broadcast((last, place))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = shared.value
        listed = lambda parts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([f.size for f in parts])]).astype(np.int32)), pa.array(np.concatenate(parts)))
        for b in batches:
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            first = listed([_prefix(s, last, place, percent).view(np.int64) for s in sets])
            others = [listed([first_tokens(s, order, percent) for s in sets]) for order in ORDERS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary()), first, *others], ["doc_id", "n", "fp", "bits", "prefix", "first2", "first3"])

    # one row a class of equal sets, by its least document
    numbered, linked = _numbered(rows)
    small_batches(spark)
    found = docs.mapInArrow(tidied(prefixes), "doc_id bigint, n bigint, fp binary, bits binary, prefix array<bigint>, first2 array<int>, first3 array<int>")
    classes = cut(found.join(numbered, ["doc_id", "fp"]).dropDuplicates(["id"]))
    tokens = classes.select("id", "n", F.posexplode("prefix").alias("at", "token"))
    # lists of two at least, with three leaders each: the least, the greatest and one by scattered bits
    scattered = 0x5A5A5A5A5A5A5A5
    lists = cut(
        tokens.groupBy("token")
        .agg(F.count("*").alias("m"), F.min("id").alias("l1"), F.max("id").alias("l2"), F.min(F.col("id").bitwiseXOR(scattered)).alias("l3"))
        .where("m > 1")
        .withColumn("l3", F.col("l3").bitwiseXOR(scattered))
    )
    members = cut(tokens.join(lists.select("token", "l1", "l2", "l3"), "token"), [lists])
    links = part = None
    if not linked.isEmpty():
        links, part = linked, connected_components(linked)
    # all leaders at once: rounds cost more than the pairs that a component of the round before would spare
    pairs = members.select("id", F.explode(F.array_distinct(F.array("l1", "l2", "l3"))).alias("leader")).where("id <> leader")
    tried = cut(_apart(pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), part, None))
    links, part = _linked(docs, tried, links, part, classes, words, percent)
    # members of different components whose sizes and places in the list allow the similarity
    own = members.select("token", "id", "n", "at")
    known = cut((own.join(part.withColumnRenamed("node", "id"), "id", "left") if part is not None else own.withColumn("component", F.col("id"))).withColumn("component", F.coalesce("component", "id")), [members])
    open_lists = known.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("token")
    rest = cut(known.join(open_lists, "token", "left_semi"), [known])
    x = rest.select("token", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "at", "component")))
    y = rest.select("token", *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "at", "component")))
    fits = (F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    # as the first token that two sets share, it leaves them at most this many to share
    most = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    fits = fits & ((100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y")))
    more = x.join(y, "token").where(fits).select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()
    more = cut(_apart(more, None, tried), [rest, tried])
    links, part = _linked(docs, more, links, part, classes, words, percent)
    discard(more)
    own = classes.select("fp", "id", "doc_id")
    if part is not None:  # the least document of each component
        own = own.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = part.select(F.col("node").alias("id"), "component").join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
        own = own.join(least, "component", "left").withColumn("doc_id", F.coalesce("least", "doc_id"))
    of = cut(own.select("fp", F.col("doc_id").alias("component")))
    return rows.join(of, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their component, one for each (of several rows of one doc_id, one with the least text); rows
    without a doc_id stay as they are."""
    names, docs = docs.columns, plain_names(docs, "doc_id", "text")
    linked = link(docs, words, percent)
    kept = cut(linked.where("doc_id = component_id").select("doc_id").distinct())
    row = F.struct(*docs.columns)
    with_id = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__weft_id")).agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("__weft_row"))
    return with_id.select("__weft_row.*").unionByName(docs.where("doc_id is null")).toDF(*names)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
