"""Near-duplicate embeddings through a pivot-permutation index.

Each vector is described by the permutation of its ``NEAREST`` nearest reference points, nearest first. Inverted lists hold
the vectors for which two points are near together: pairs of points whose places in the permutation have a product of ``REACH``
at most, as the first places are the surest. Vectors that meet in a list are candidates if they share ``SHARED`` points at least, which
are counted in their permutations; each candidate pair is verified once, in the least list that both are in, by its
cosine in double precision. All vectors are indexed and every link found is exact; a pair that shares fewer points is missed
(recall is measured in the tests).

There are as many reference points as keep a list short (their number grows with the square root of the rows), drawn
from a fixed seed. A list of more than ``BLOCK`` vectors is compared block by block, each pair of blocks in a group of
its own, so that no group grows with the data. Equal vectors are one class from the start, with a multiplicity.

Vectors may have any length. A vector that is null, empty or zero, or holds null or non-finite components, links with nothing and is its own
component; so do vectors of different lengths. Rows are kept one for one; rows of one vec_id count once, by the least of
their vectors. A null vec_id is never a partner, its component is null. Columns other
than vec_id and embedding don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, table, tidied
from weftline.operators.components import connected_components
from weftline.session import cut

COSINE = 0.95
NEAREST, REACH, SHARED = 9, 18, 3
#: Places in a permutation whose points make a list.
PLACES = tuple((s, t) for s in range(NEAREST) for t in range(s + 1, NEAREST) if (s + 1) * (t + 1) <= REACH)
#: Products of vectors and reference points that are held at once.
PRODUCTS = 4_000_000
#: Reference points: at least, at most, and rows to a list that they are chosen for.
FEWEST, MOST, LIST = 64, 65_536, 20
BLOCK = 1024
SEED = 20


@cache
def points(n: int, dim: int) -> np.ndarray:
    found = np.random.default_rng([SEED, n, dim]).normal(size=(n, dim))
    return found / np.linalg.norm(found, axis=1)[:, None]


def nearest(x: np.ndarray, n: int) -> np.ndarray:
    """The numbers of each row's nearest reference points, nearest first; some rows at a time."""
    ref, k = points(n, x.shape[1]), min(NEAREST, n)
    out = np.empty((len(x), k), np.int32)
    step = max(1, PRODUCTS // n)
    for lo in range(0, len(x), step):
        far = x[lo : lo + step] @ -ref.T
        some = np.argpartition(far, k - 1, axis=1)[:, :k]
        out[lo : lo + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return out


def list_keys(near: np.ndarray) -> np.ndarray:
    """The lists that each permutation is in."""
    near = near.astype(np.int64)
    return np.stack([np.minimum(near[:, s], near[:, t]) * MOST + np.maximum(near[:, s], near[:, t]) for s, t in PLACES], 1)


def shared_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many points each permutation of a has in common with each of b."""
    total = np.zeros((len(a), len(b)), np.int8)
    for k in range(a.shape[1]):
        total += (a[:, k, None, None] == b[None, :, :]).any(2)
    return total


def point_count(rows: int) -> int:
    return int(np.clip(np.ceil(np.sqrt(2 * len(PLACES) * max(rows, 1) / LIST)), FEWEST, MOST))


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) >= COSINE * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec: doubles as bytes) of rows that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, np.float64)
                with np.errstate(over="ignore"):
                    norm = float(x @ x)
                if not np.isfinite(x).all() or not x.any():
                    continue
                if not np.isfinite(norm) or norm < 1e-200:
                    x = x / np.abs(x).max()
                ids.append(i)
                vecs.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    small_batches(vectors.sparkSession, 1024)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(tidied(run), "vec_id bigint, vec binary")


def _compare(rows: list[dict]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of a list, or two blocks of it: ids with the multiplicities linked to them here, and ids with the least id they are connected with."""
    dims: dict[int, list[dict]] = {}
    for r in rows:
        dims.setdefault(len(r["vec"]), []).append(r)
    counts, edges = ([], []), ([], [])
    for group in dims.values():
        left = [r for r in group if r["side"] <= 0]
        right = [r for r in group if r["side"] >= 0]
        if not left or not right:
            continue
        x, y = (np.frombuffer(b"".join([r["vec"] for r in part]), np.float64).reshape(len(part), -1) for part in (left, right))
        a, b = (np.frombuffer(b"".join([r["near"] for r in part]), np.int32).reshape(len(part), -1) for part in (left, right))
        hit = np.concatenate([shared_points(a[lo : lo + 64], b) for lo in range(0, len(a), 64)]) >= SHARED
        hit &= linked(x, y)
        if left[0]["side"] == 0:
            hit = np.triu(hit, 1)  # both are the same rows
        i, j = np.nonzero(hit)
        if not i.size:
            continue
        u, v = list_keys(a), list_keys(b)
        ids, jds = np.array([r["id"] for r in left]), np.array([r["id"] for r in right])
        once = np.zeros(i.size, bool)
        for lo in range(0, i.size, 50_000):  # in the least list that both are in
            p, q = u[i[lo : lo + 50_000]], v[j[lo : lo + 50_000]]
            both = (p[:, :, None] == q[:, None, :]).any(2)
            once[lo : lo + 50_000] = np.where(both, p, np.iinfo(np.int64).max).min(1) == rows[0]["key"]
        i, j = i[once], j[once]
        m, k = np.array([r["copies"] for r in left]), np.array([r["copies"] for r in right])
        for own, other, at, many in ((ids, jds, (i, j), k), (jds, ids, (j, i), m)):
            total = np.bincount(at[0], weights=many[at[1]], minlength=own.size).astype(np.int64)
            counts[0].extend(own[total > 0].tolist())
            counts[1].extend(total[total > 0].tolist())
        every, back = np.unique(np.concatenate([ids[i], jds[j]]), return_inverse=True)
        s, t = back[: i.size], back[i.size :]
        label = np.arange(every.size)
        while s.size:
            new = label.copy()
            np.minimum.at(new, s, label[t])
            np.minimum.at(new, t, label[s])
            new = new[new]
            if (new == label).all():
                break
            label = new
        edges[0].extend(every.tolist())
        edges[1].extend(every[label].tolist())
    return counts[0], counts[1], edges[0], edges[1]


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding), a row for each of its rows."""
    own = cut(_valid(vectors).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    classes = cut(own.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    n = point_count(classes.count())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, near, lists = [], [], []
            vecs = b.column(0).to_pylist()
            for size in sorted({len(v) for v in vecs}):
                own = [k for k, v in enumerate(vecs) if len(v) == size]
                found = nearest(np.frombuffer(b"".join([vecs[k] for k in own]), np.float64).reshape(len(own), -1), n)
                at += own
                near += [row.tobytes() for row in found]
                lists += list_keys(found).tolist()
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1).take(own), b.column(2).take(own), b.column(0).take(own), pa.array(near, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["id", "copies", "vec", "near", "keys"])

    small_batches(classes.sparkSession, 1024)
    indexed = cut(classes.mapInArrow(tidied(keys), "id bigint, copies bigint, vec binary, near binary, keys array<bigint>"))
    lists = cut(indexed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")))
    entries = indexed.select("id", "copies", "vec", "near", F.explode("keys").alias("key")).join(lists.select("key", "blocks"), "key")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"), F.signum(F.col("block") - o).cast("int").alias("side")))
    groups = entries.withColumn("block", block).select("key", "id", "copies", "vec", "near", F.explode(meet).alias("g")).select("key", "g.i", "g.j", "g.side", "id", "copies", "vec", "near")
    groups = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def passed() -> pa.RecordBatch:
            ids, many, a, b = _compare(held) if len(held) > 1 else ([], [], [], [])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids + a, pa.int64()), pa.array(many + [None] * len(a), pa.int64()), pa.array([None] * len(ids) + b, pa.int64())], ["id", "n", "other"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and any(held[0][k] != r[k] for k in ("key", "i", "j")):
                    if (out := passed()).num_rows:
                        yield out
                held.append(r)
        if held:
            yield passed()

    found = cut(groups.mapInArrow(tidied(compare), "id bigint, n bigint, other bigint"))
    counts = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of = classes.join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    of = cut(of.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    each = own.join(of, "vec").select("vec_id", "n_links", "component_id")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(each, "vec_id", "left")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
