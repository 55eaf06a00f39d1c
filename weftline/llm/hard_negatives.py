"""Hard negatives of anchors, by product quantisation with residual bounds.

Components are whole numbers, scores their inner products. The index holds for every row two codes for each ``WIDTH`` components: the
nearest of ``CENTRES`` whole-number centres, and that of what is left, with the norm of what is left after either (rounded up). The score
of an anchor lies within a sum of table entries plus or minus the product of both norms, so comparing bounds drops only
rows that cannot be in a result: the first codes are compared for all rows, the second for those that are left, and the vectors of the
rest give exact scores. Recall is therefore 1; the centres (fitted by k-means on the ``SAMPLE`` rows of least hash, a bounded
sample; dimensions beyond ``DIMENSIONS`` have the centre 0) only decide how much work is left.

Rows are dealt to blocks by hash, anchors go to every block: a stated set of queries against all rows. A block gives each anchor its own
best rows, and the best of all blocks are ranked. Anchors stream through a block's rows, so a task holds one block and a batch of
anchors. Rows with equal vector and label, however many, can only be ranked by id, so the first few ids of such a class stand for it exactly; they
are chosen by a rank that Spark limits before its shuffle.

First pass: an anchor's positives, its best other rows of the same label. Second: for each positive a window of scores, of which the best rows
of other labels are returned. Ties go to the smaller vec_id.

Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part. Rows of one vec_id count once, by the
least label, then the least bytes of the vector. Vectors of different lengths aren't compared; empty ones have the score 0. Components saturate at 2^25 in size
(|x| of 131,072), so scores fit a long. Columns other than vec_id, embedding and label don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, table, tidied
from weftline.session import cut

EVERY, MOVED, BUCKETS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 10
#: Least and most share of the positive's score, in hundredths.
LOW, HIGH = 30, 90
WIDTH, CENTRES, DIMENSIONS = 2, 256, 4096
#: Rows, and at most so many numbers, that centres are fitted on.
SAMPLE, NUMBERS, STEPS = 4096, 1 << 20, 6
SATURATED = 1 << 25
#: Rows of a block: at least, at most; blocks that are aimed at in between. Scores that are held at once.
FEWEST, MOST, BLOCKS = 1024, 65_536, 32
SCORES = 1 << 20


def _vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec: int32 as bytes) of rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, vecs = [], []
            for k, v in enumerate(b.column(2).to_pylist()):
                if v is None or any(c is None for c in v):
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        vecs.append(np.clip(np.floor(SCALE * x), -SATURATED, SATURATED).astype(np.int32).tobytes())
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(vecs, pa.binary())], ["vec_id", "label", "vec"])

    small_batches(rows.sparkSession, 1024)
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % BUCKETS).otherwise(F.col("label"))
    return some.withColumn("label", moved).mapInArrow(tidied(run), "vec_id bigint, label bigint, vec binary")


@dataclass
class Codebook:
    """Centres by level and place: int32 (2, places, CENTRES, WIDTH)."""

    centres: np.ndarray

    def padded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of vectors that the centres are for, by place, and the rest."""
        places = self.centres.shape[1]
        head = np.zeros((len(x), places * WIDTH), np.int64)
        n = min(x.shape[1], head.shape[1])
        head[:, :n] = x[:, :n]
        return head.reshape(len(x), places, WIDTH), x[:, n:].astype(np.int64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, 2 * places) and the norms that are left after either level, rounded up."""
        left, rest = self.padded(x)
        codes, norms = [], []
        more = np.square(rest.astype(np.float64)).sum(1)
        for centres in self.centres:
            code = np.stack([nearest(left[:, p], centres[p]) for p in range(left.shape[1])], 1) if left.shape[1] else np.zeros((len(x), 0), np.uint8)
            left = left - centres[np.arange(left.shape[1]), code]
            codes.append(code)
            norms.append(np.nextafter(np.sqrt((np.square(left.astype(np.float64)).sum((1, 2)) + more) * (1 + 1e-12)), np.inf))
        return np.concatenate(codes, 1).astype(np.uint8), np.stack(norms, 1)

    def tables(self, anchors: np.ndarray, level: int) -> np.ndarray:
        """Scores of centres, (anchors, places, CENTRES): whole numbers, exact in doubles for components that don't saturate."""
        head, _ = self.padded(anchors)
        return np.einsum("apw,pcw->apc", head.astype(np.float64), self.centres[level].astype(np.float64))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    x, c = x.astype(np.float64), centres.astype(np.float64)
    return np.argmin(np.square(c).sum(1) - 2 * (x @ c.T), 1)


def fit(x: np.ndarray) -> Codebook:
    """Centres of both levels, by k-means for each place, from sampled vectors."""
    rng, places = np.random.default_rng(11), -(-min(x.shape[1], DIMENSIONS) // WIDTH)
    out = Codebook(np.zeros((0, places, CENTRES, WIDTH), np.int32))
    left, _ = Codebook(np.zeros((2, places, CENTRES, WIDTH), np.int32)).padded(x)
    levels = []
    for _ in range(2):
        made = np.zeros((places, CENTRES, WIDTH), np.int32)
        for p in range(places if len(x) else 0):
            own = left[:, p]
            c = own[rng.permutation(len(own))[np.arange(CENTRES) % len(own)]].astype(np.float64)
            for _ in range(STEPS):
                code = nearest(own, c)
                n = np.bincount(code, minlength=CENTRES)
                total = np.stack([np.bincount(code, weights=own[:, w], minlength=CENTRES) for w in range(WIDTH)], 1)
                c[n > 0] = total[n > 0] / n[n > 0][:, None]
            made[p] = np.rint(c)
            left[:, p] -= made[p][nearest(own, made[p])]
        levels.append(made)
    out.centres = np.stack(levels)
    return out


def sampled(rows: DataFrame) -> np.ndarray:
    """Vectors of the rows of least hash, as many as fit NUMBERS; shorter ones end in zeros."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(F.substring("vec", 1, 4 * DIMENSIONS).alias("vec")).toArrow()["vec"].to_pylist()
    wide = max([len(v) // 4 for v in got], default=0)
    got = got[: max(CENTRES, NUMBERS // max(wide, 1))]
    out = np.zeros((len(got), wide), np.int64)
    for k, v in enumerate(got):
        out[k, : len(v) // 4] = np.frombuffer(v, np.int32)
    return out


def indexed(rows: DataFrame, book: Codebook) -> DataFrame:
    """Rows with their codes and norms (doubles as bytes)."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(2).to_pylist()
            codes, norms = [b""] * len(vecs), [b""] * len(vecs)
            for size in {len(v) for v in vecs}:
                own = [k for k, v in enumerate(vecs) if len(v) == size]
                x = np.frombuffer(b"".join([vecs[k] for k in own]), np.int32).reshape(len(own), -1)
                for k, c, n in zip(own, *shared.value.encode(x)):
                    codes[k], norms[k] = c.tobytes(), n.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(norms, pa.binary())], [*b.schema.names, "codes", "norms"])

    small_batches(rows.sparkSession, 1024)
    return rows.mapInArrow(tidied(run), "vec_id bigint, label bigint, vec binary, codes binary, norms binary")


class Block:
    """Rows of a block by (length, label), in the order of labels."""

    def __init__(self, rows: list[dict], book: Codebook):
        self.book, self.parts = book, {}
        sizes: dict[int, list[dict]] = {}
        for r in rows:
            sizes.setdefault(len(r["vec"]) // 4, []).append(r)
        for size, own in sizes.items():
            own.sort(key=lambda r: (r["label"], r["vec_id"]))
            x = np.frombuffer(b"".join([r["vec"] for r in own]), np.int32).reshape(len(own), size)
            codes = np.frombuffer(b"".join([r["codes"] for r in own]), np.uint8).reshape(len(own), -1)
            norms = np.frombuffer(b"".join([r["norms"] for r in own]), np.float64).reshape(len(own), 2)
            self.parts[size] = (np.array([r["vec_id"] for r in own]), np.array([r["label"] for r in own]), x, codes, norms)

    def approximate(self, codes: np.ndarray, tables: np.ndarray, level: int) -> np.ndarray:
        """Sums of table entries, (anchors, rows)."""
        places = tables.shape[1]
        out = np.zeros((tables.shape[0], len(codes)))
        for p in range(places):
            out += tables[:, p][:, codes[:, level * places + p]]
        return out


def exact(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    if x.size and float(np.abs(x).max()) * float(np.abs(anchor).max(initial=0)) * x.shape[1] < 2**52:
        return (x.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ anchor.astype(np.int64)


def _norm(x: np.ndarray) -> float:
    return float(np.nextafter(np.sqrt(np.square(x.astype(np.float64)).sum() * (1 + 1e-12)), np.inf))


def best(k: int, low: float, high: float, score: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Places of rows that can be among the k best with a score in [low, high]: score and bound are of all rows that may be chosen."""
    least, most = score - bound, score + bound
    sure = least[(least >= low) & (most <= high)]
    floor = max(low, np.partition(sure, sure.size - k)[sure.size - k]) if sure.size >= k else low
    return np.flatnonzero((most >= floor) & (least <= high))


def chosen(block: Block, anchors: list[dict], same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, number of its window, vec_id, exact score) of the block's best rows; same: of the anchor's label, without a window."""
    sizes: dict[int, list[dict]] = {}
    for a in anchors:
        sizes.setdefault(len(a["vec"]) // 4, []).append(a)
    k = POSITIVES if same else NEGATIVES
    for size, group in sizes.items():
        if size not in block.parts:
            continue
        ids, labels, x, codes, norms = block.parts[size]
        step = max(1, min(SCORES // len(ids), SCORES // max(1, block.book.centres.shape[1] * CENTRES)))
        for at in range(0, len(group), step):
            own = group[at : at + step]
            vecs = np.frombuffer(b"".join([a["vec"] for a in own]), np.int32).reshape(len(own), size)
            rough = block.approximate(codes, block.book.tables(vecs, 0), 0)
            fine = block.book.tables(vecs, 1)
            for n, a in enumerate(own):
                norm = _norm(vecs[n])
                lo, hi = np.searchsorted(labels, [a["label"], a["label"] + 1])
                may = np.arange(lo, hi)[ids[lo:hi] != a["id"]] if same else np.concatenate([np.arange(lo), np.arange(hi, len(ids))])
                slack = 1e-6 + 1e-12 * np.abs(rough[n]).max(initial=0)
                for w, (low, high) in enumerate([(-np.inf, np.inf)] if same else zip(a["low"], a["high"])):
                    left = may[best(k, low, high, rough[n][may], norms[may, 0] * norm + slack)]
                    if not left.size:
                        continue
                    second = rough[n][left] + block.approximate(codes[left], fine[n : n + 1], 1)[0]
                    left = left[best(k, low, high, second, norms[left, 1] * norm + slack)]
                    score = exact(x[left], vecs[n])
                    inside = (score >= low) & (score <= high)
                    left, score = left[inside], score[inside]
                    for i in np.lexsort((ids[left], -score))[:k].tolist():
                        yield a["id"], w, int(ids[left[i]]), int(score[i])


def _passed(index: DataFrame, anchors: DataFrame, blocks: int, book: Codebook, same: bool) -> DataFrame:
    """(anchor, window, vec_id, score): the best rows of every block for anchors (id, label, vec, low, high)."""
    shared = index.sparkSession.sparkContext.broadcast(book)
    no = F.lit(None)
    rows = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("id"), "label", "vec", "codes", "norms", no.cast("array<bigint>").alias("low"), no.cast("array<bigint>").alias("high"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "label", "vec", no.cast("binary").alias("codes"), no.cast("binary").alias("norms"), "low", "high")
    dealt = rows.unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("codes").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else ([],) * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["anchor", "window", "vec_id", "score"])

        for b in batches:
            asking: list[dict] = []
            for r in b.to_pylist():
                if r["block"] != number:
                    if asking:
                        yield out(list(chosen(block, asking, same)))
                    number, held, block, asking = r["block"], [], None, []
                if r["codes"] is not None:
                    held.append({"vec_id": r["id"], **{c: r[c] for c in ("label", "vec", "codes", "norms")}})
                else:
                    if block is None:
                        block, held = Block(held, shared.value), []
                    asking.append(r)
            if asking:
                yield out(list(chosen(block, asking, same)))

    small_batches(index.sparkSession, 1024)
    return dealt.mapInArrow(tidied(run), "anchor bigint, window bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, embedding, label)."""
    own = cut(_vectors(rows).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.*"))
    first = Window.partitionBy("label", "vec").orderBy("vec_id")
    classes = own.withColumn("place", F.row_number().over(first)).where(F.col("place") <= max(POSITIVES + 1, NEGATIVES)).drop("place")
    book = fit(sampled(own))
    index = cut(indexed(classes, book))
    n = index.count()
    blocks = max(1, -(-n // int(np.clip(n // BLOCKS, FEWEST, MOST))))
    none = F.lit(None).cast("array<bigint>")
    anchors = own.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("id"), "label", "vec", none.alias("low"), none.alias("high"))
    near = cut(_ranked(_passed(index, anchors, blocks, book, True), POSITIVES, "anchor"))
    down = lambda x: f"({x} - pmod({x}, 100)) div 100"  # noqa: E731  of hundredths, in whole numbers
    windows = near.withColumns({"low": F.expr(f"-({down(f'(-score * {LOW})')})"), "high": F.expr(down(f"(score * {HIGH})"))}).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive"), "score", "low", "high"))).alias("of"))  # POSITIVES at most
    windows = cut(windows)
    asked = anchors.drop("low", "high").join(windows.select(F.col("anchor").alias("id"), F.col("of.low").alias("low"), F.col("of.high").alias("high")), "id")
    found = _ranked(_passed(index, asked, blocks, book, False), NEGATIVES, "anchor", "window")
    both = found.join(windows, "anchor").withColumn("p", F.get("of", F.col("window").cast("int")))
    return both.select(F.col("anchor").alias("anchor_id"), F.col("p.positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
