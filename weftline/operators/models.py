"""Baselines and models by rolling origin; jobs are rows, and a job's rows of training and validation are what one task holds."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, discard


def class_weights(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Adds weight: N / (2 N_c)."""
    n = F.count("*").over(Window.partitionBy(*keys)) if keys else None
    by_class = df.groupBy(*keys, label).agg(F.count("*").alias("_c"))
    total = df.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else df.agg(F.count("*").alias("_n"))
    del n
    both = by_class.join(total, list(keys)) if keys else by_class.crossJoin(total)
    return df.join(F.broadcast(both.withColumn("weight", F.col("_n") / (2 * F.col("_c"))).drop("_n", "_c")), [*keys, label])


def standardise(train: DataFrame, every: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Scale by the training rows' mean and population sd; a constant column is only centred."""
    stats = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    fitted = train.groupBy(*keys).agg(*stats) if keys else train.agg(*stats)
    both = every.join(F.broadcast(fitted), list(keys)) if keys else every.crossJoin(F.broadcast(fitted))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return both.withColumns(scaled).drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def majority(train: DataFrame, test: DataFrame, label: str, *keys: str) -> DataFrame:
    """Adds p1 (training prevalence) and prediction (1 only if ones prevail)."""
    fitted = train.groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("p1")) if keys else train.agg(F.avg(F.col(label).cast("double")).alias("p1"))
    both = test.join(F.broadcast(fitted), list(keys)) if keys else test.crossJoin(F.broadcast(fitted))
    return both.withColumn("prediction", (F.col("p1") > 0.5).cast("int"))


def persistence(rows: DataFrame, last: str, fallback: str) -> DataFrame:
    """Adds prediction: the last earlier label, or the fallback's."""
    return rows.withColumn("prediction", F.coalesce(last, fallback))


def impute(train: DataFrame, rows: DataFrame, rate: str, recency: str, label: str) -> DataFrame:
    """Missing rates become the training prevalence, missing and too long recencies the training maximum + 1."""
    fitted = train.agg(F.avg(F.col(label).cast("double")).alias("_p"), (F.max(recency) + 1).alias("_cap"))
    both = rows.crossJoin(F.broadcast(fitted))
    return both.withColumns({rate: F.coalesce(rate, "_p"), recency: F.coalesce(F.least(recency, "_cap"), "_cap")}).drop("_p", "_cap")


def logistic(train: DataFrame, features: list[str], label: str, c: float = 1.0, weight: str | None = None):
    """L2-regularised logistic regression as the penalty 1/(2C) |w|^2 defines it; the intercept is free."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    total = train.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    model = LogisticRegression(featuresCol="_x", labelCol=label, elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * float(total)), maxIter=500, tol=1e-10)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model]).fit(train)


class Mlp:
    """Two hidden ReLU layers and a logistic output, trained by Adam on weighted cross-entropy with early stopping."""

    def __init__(self, inputs: int, hidden: int = 16, seed: int = 0, rate: float = 1e-2, decay: float = 1e-4):
        rng = np.random.default_rng(seed)
        sizes = (inputs, hidden, hidden, 1)
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.rate, self.decay, self.rng = rate, decay, rng

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k < len(self.w) - 1 else z)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.layers(x)[-1][:, 0], -30, 30)))

    def loss(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        p = np.clip(self.probability(x), 1e-12, 1 - 1e-12)
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        a = self.layers(x)
        d = ((1 / (1 + np.exp(-np.clip(a[-1][:, 0], -30, 30))) - y) * weight / weight.sum())[:, None]
        out: list[np.ndarray] = []
        for k in range(len(self.w) - 1, -1, -1):
            out = [a[k].T @ d + self.decay * self.w[k], d.sum(0), *out]
            if k:
                d = (d @ self.w[k].T) * (a[k] > 0)
        return out

    def fit(self, x, y, weight, xv, yv, wv, epochs: int = 100, patience: int = 10, batch: int = 1024) -> "Mlp":
        flat = [p for pair in zip(self.w, self.b) for p in pair]
        first, second = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
        best, kept, bad, t = np.inf, [p.copy() for p in flat], 0, 0
        for _ in range(epochs):
            order = self.rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                rows, t = order[lo : lo + batch], t + 1
                for p, g, m, v in zip(flat, self.gradients(x[rows], y[rows], weight[rows]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            now = self.loss(xv, yv, wv)
            if now < best - 1e-6:
                best, kept, bad = now, [p.copy() for p in flat], 0
            else:
                bad += 1
                if bad >= patience:
                    break
        for p, k in zip(flat, kept):
            p[...] = k
        return self


def _by_row(w: list[np.ndarray], b: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mlp.probability, with the same digits for a row whatever rows are beside it (products of matrices round by their shape)."""
    for k, (own, base) in enumerate(zip(w, b)):
        x = sum((x[:, i : i + 1] * own[i] for i in range(len(own))), np.zeros((len(x), len(base)))) + base
        x = np.maximum(x, 0) if k < len(w) - 1 else x
    return 1 / (1 + np.exp(-np.clip(x[:, 0], -30, 30)))


def train_jobs(rows: DataFrame, features: list[str], label: str, part: str, *keys: str, seed: int = 0, hidden: int = 16) -> DataFrame:
    """A job for each key: fit on part 'train', stop by 'validation', and give p1 for 'test' rows.

    A task holds the training and validation rows of a job, in the order of ``row``; test rows stream by the fitted models, wherever they lie.
    """
    rows = cut(rows.select(*keys, "row", label, *features, part))
    number = [F.lit(None).cast("int")]
    for k, r in enumerate(rows.select(*keys).distinct().collect()):  # a few
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.lit(r[c]))
        number.append(F.when(same, k))
    dealt = rows.withColumn("_job", F.coalesce(*number))

    def fitted(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        x, y = frame[features].to_numpy(float), frame[label].to_numpy(float)
        a, v = (frame[part].to_numpy() == p for p in ("train", "validation"))
        weight = np.where(y == 1, 0.5 / max((y[a] == 1).mean(), 1e-9), 0.5 / max((y[a] == 0).mean(), 1e-9)) if a.any() else np.ones(len(y))
        mean, sd = x[a].mean(0), x[a].std(0)
        sd = np.where(sd > 0, sd, 1)
        z = (x - mean) / sd
        v = v if v.any() else a
        model = Mlp(len(features), hidden, seed).fit(z[a], y[a], weight[a], z[v], y[v], weight[v])
        return mean, sd, model.w, model.b

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_job": frame["_job"].iloc[:1], "_model": [pickle.dumps(fitted(frame.sort_values("row", kind="stable")))]})

    seen = dealt.where(F.col(part).isin("train", "validation")).select("_job", "row", label, *features, part)
    made = {r[0]: pickle.loads(r[1]) for r in seen.groupBy("_job").applyInPandas(one, "_job int, _model binary").collect()}  # some kilobytes a job

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, job, p = f[features].to_numpy(float), f["_job"].to_numpy(), np.empty(len(f))
            for j in np.unique(job).tolist():
                if j not in made:
                    made[j] = fitted(pd.DataFrame(columns=[*features, label, part], dtype=object))
                mean, sd, w, b = made[j]
                p[job == j] = _by_row(w, b, (x[job == j] - mean) / sd)
            yield f[[*keys, "row", label]].assign(p1=p)

    tested = dealt.where(F.col(part) == "test").select(*keys, "row", label, *features, "_job")
    out = cut(tested.mapInPandas(predict, rows.select(*keys, "row", label).schema.add("p1", "double")))
    discard(rows)
    return out


def resumed(rows: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, *keys: str) -> int:
    """Run the jobs (keys) of rows that have no results below path yet, and add theirs as one table; how many jobs that were.

    A table is there as a whole or not at all (its success marker), so that a run that was cut off is done again.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s.getPath().toString() for s in fs.listStatus(where)] if fs.exists(where) else []
    whole = [p for p in there if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
    for p in set(there) - set(whole):
        fs.delete(jvm.org.apache.hadoop.fs.Path(p), True)
    todo = rows
    if whole:
        todo = rows.join(spark.read.parquet(*whole).select(*keys).distinct(), list(keys), "left_anti")
    jobs = todo.select(*keys).distinct().count()
    if jobs:
        run(todo).write.parquet(f"{path}/part={len(whole)}-{uuid.uuid4().hex}")
    return jobs


def gru(sequences: np.ndarray, lengths: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Last states of a gated recurrent unit over padded sequences; padding changes nothing, an empty one is zeros."""
    h = np.zeros((sequences.shape[0], weights["uz"].shape[0]))
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    for t in range(sequences.shape[1]):
        x, live = sequences[:, t], (lengths > t)[:, None]
        z, r = sig(x @ weights["wz"] + h @ weights["uz"] + weights["bz"]), sig(x @ weights["wr"] + h @ weights["ur"] + weights["br"])
        new = np.tanh(x @ weights["wh"] + (r * h) @ weights["uh"] + weights["bh"])
        h = np.where(live, (1 - z) * h + z * new, h)
    return h


def attention(x: np.ndarray, neighbours: np.ndarray, log_weight: np.ndarray, mask: np.ndarray, w: np.ndarray, a_self: np.ndarray, a_other: np.ndarray) -> np.ndarray:
    """Additive attention over padded neighbour lists with the log of edge weights as prior; heads are averaged."""
    h = np.einsum("nf,hfd->nhd", x, w)
    e = np.einsum("nhd,hd->nh", h, a_self)[:, None, :] + np.einsum("nhd,hd->nh", h, a_other)[neighbours]
    e = np.where(e > 0, e, 0.2 * e) + log_weight[:, :, None]
    e = np.where(mask[:, :, None], e, -np.inf)
    s = np.exp(e - e.max(1, keepdims=True))
    s /= s.sum(1, keepdims=True)
    return np.einsum("nkh,nkhd->nhd", s, h[neighbours]).mean(1)
