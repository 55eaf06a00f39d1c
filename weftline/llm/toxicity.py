"""Toxicity by compression distance.

Two dictionaries are trained by zstandard, one on ordinary text and one on toxic text; each window of a text is compressed with
both, and what the toxic dictionary saves is the evidence. The toxic dictionary's samples are those words of toxic texts that
hold letters which ordinary texts never have side by side, as all else that toxic texts say is ordinary; it carries the
ordinary dictionary behind its own, so that ordinary windows come out alike and only toxic ones differ. A logistic curve, fitted on
labelled rows that trained no dictionary, calibrates savings into a score, whose threshold is ``THRESHOLD``.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled rows of each class, in the order of a hash of their
id; of a text of over ``SAMPLE_CHARS`` characters, pieces from all over it. Every window of every text is scored.

Null and empty texts have no window and get the score of texts without evidence; a text of any length is scored whole. Without rows
of both classes every score is the smoothed share of toxic rows. Of several labels of a row any toxic one counts; repeated
documents are kept one for one, whatever their ids. Other columns are kept by ``keep_ordinary``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import crc_mod, plain_names, small_batches, table, tidied
from weftline.session import trim

#: Labelled rows of each class that the model is fitted on, and the most characters of one of them, in pieces of so many.
SAMPLE, SAMPLE_CHARS, PIECE = 3000, 60_000, 200
WINDOW, OVERLAP = 80, 24
LEVEL = 12
DICT_BYTES = 16_384
#: Bytes that a window may save by chance.
NOISE = 3
#: Bytes of a passage that is compared with ordinary text, and the toxic rows that have to share it.
GRAM, SHARED = 5, 6
#: Words of a sample that the toxic dictionary is trained on, and the lengths that zstandard looks for there.
TOGETHER, SEGMENT, MATCH = 8, 64, 8
THRESHOLD = 0.7
HELD_OUT = (3, 1)


_GAPS = re.compile(rb"[^a-z\x80-\xff]+")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def scorer(self) -> "Scorer":
        return Scorer(self)


def as_bytes(text: str | None) -> bytes:
    """Lower-cased, with one space for whatever is no letter; what the dictionaries see."""
    return _GAPS.sub(b" ", b" " + (text or "").lower().encode() + b" ") if text else b""


def _grams(text: bytes) -> np.ndarray:
    """Hashes (24 bits) of the passages that begin at each byte."""
    u = np.frombuffer(text, np.uint8).astype(np.uint32)
    n = u.size - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(0x01000193) + u[k : k + n] + np.uint32(1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(8)


def _inside(text: bytes) -> np.ndarray:
    """Whether a passage lies in one word, with a space before or after it at most."""
    gap = np.frombuffer(text, np.uint8) == 32
    n = gap.size - GRAM + 1
    return ~np.logical_or.reduce([gap[k : k + max(n, 0)] for k in range(1, GRAM - 1)]) if n > 0 else np.zeros(0, bool)


def _trained(samples: list[bytes], size: int, **lengths: int) -> bytes:
    """The content that zstandard picks from the samples; all of them where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **lengths).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _telling_words(text: bytes, telling: np.ndarray) -> list[bytes]:
    """The words of a text, with the spaces around them, that hold a telling passage."""
    out, end = [], 0
    for i in np.flatnonzero(telling[_grams(text)] & _inside(text)).tolist():
        if i + GRAM > end:
            lo, end = text.rfind(b" ", 0, i + 1), text.find(b" ", i + GRAM - 1) + 1
            out.append(text[lo:end])
    return out


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.dicts = [zstandard.ZstdCompressionDict(d or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic)]
        for d in self.dicts:
            d.precompute_compress(level=LEVEL)
        self.ordinary, self.toxic = map(make, self.dicts)

    def savings(self, text: str | None) -> list[int]:
        """Bytes that the toxic dictionary saves in each window."""
        raw = as_bytes(text)
        cut = [raw[i : i + WINDOW + OVERLAP] for i in range(0, len(raw), WINDOW)]
        return [len(self.ordinary(w)) - len(self.toxic(w)) for w in cut]

    def features(self, text: str | None) -> tuple[float, ...]:
        saved = sorted(self.savings(text), reverse=True) or [0]
        most, second = saved[0], saved[1] if len(saved) > 1 else 0
        return 1.0, max(most, 0) / 4, max(most - NOISE, 0) / 4, max(second - NOISE, 0) / 4, float(np.log1p(sum([s - NOISE for s in saved if s > NOISE]))), float(np.log1p(len(saved))) / 4

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.model.weights, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    share = (len(toxic) + 1) / (len(toxic) + len(ordinary) + 2)
    constant = (float(np.log(share / (1 - share))),) + (0.0,) * 5
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", constant)
    t, o = [as_bytes(x) for x in toxic[::2]], [as_bytes(x) for x in ordinary]
    usual = np.zeros(1 << 24, bool)
    for x in o:
        usual[_grams(x)] = True
    shared = np.zeros(1 << 24, np.uint16)
    for x in t:
        shared[np.unique(_grams(x))] += 1
    telling = (shared >= min(SHARED, max(2, len(t) // 50))) & ~usual
    words = [w for x in t for w in _telling_words(x, telling)]
    counted = Counter(words)
    words = [w for w in words if counted[w] >= min(SHARED, max(counted.values()) // 4)]
    plain = _trained([w for x in o[::2] for w in (x[i : i + 256] for i in range(0, len(x), 256))][:40_000], DICT_BYTES)
    toxic_content = _trained([b"".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)], DICT_BYTES, k=SEGMENT, d=MATCH) + plain
    model = Model(plain, toxic_content, constant)
    scorer = Scorer(model)
    x = np.array([scorer.features(d) for d in [*toxic[1::2], *ordinary[1::2]]])
    y = np.array([1.0] * len(toxic[1::2]) + [0.0] * len(ordinary[1::2]))
    return Model(plain, toxic_content, _logistic(x, y))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps on a logistic curve with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows of docs (doc_id, text) and labels (doc_id, toxic), without those held out."""
    m, out = HELD_OUT
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", m) != out)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    pieces = SAMPLE_CHARS // PIECE
    size = F.char_length("text")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substr("text", (i * size / pieces).cast("int") + 1, F.lit(PIECE))), " ")
    short = docs.select("doc_id", F.when(size > SAMPLE_CHARS, spread).otherwise(F.col("text")).alias("text")).where("text is not null")

    def of(kind: int) -> DataFrame:
        # a row of each class and id: which ids are taken is settled before any text is moved
        ids = known.where(F.col("toxic") == kind).join(short.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
        return short.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(kind).alias("kind"), "doc_id", "text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[list[str], list[str]] = [], []
        for b in batches:
            for kind, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                got[kind].append(text)
        model = fit(got[1], got[0])
        del got
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([model.ordinary], pa.binary()), pa.array([model.toxic], pa.binary()), pa.array([list(model.weights)], pa.list_(pa.float64()))], ["ordinary", "toxic", "weights"])

    # the sample is bounded: one task fits on it, as the driver's memory is small
    rows = of(0).unionByName(of(1)).repartition(1).sortWithinPartitions("kind", "doc_id")
    one = rows.mapInArrow(fitted, "ordinary binary, toxic binary, weights array<double>").first()
    return Model(bytes(one.ordinary), bytes(one.toxic), tuple(one.weights)) if one else fit([], [])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and all other columns of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            scores = [scorer.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    m, out = HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod("doc_id", m) == out).alias("held_out"))
    return rows.mapInArrow(tidied(run), "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            yield b.filter(pa.array([scorer.score(t) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    rows = plain_names(docs)
    return rows.mapInArrow(tidied(run), rows.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
