"""Small recurrent and graph models, trained by gradients that are recorded as values are computed.

Rows of all jobs (a key, or a model) stay a table: in each epoch, tasks add up losses and gradients of the rows that they have, a few at a time,
and the driver takes one step for each job. What a row of a graph model sees (its neighbours' features in the period before) is fixed, so it is
joined to the row once; rows then don't depend on each other. Only the neighbours of one node are in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, discard

#: Rows, and numbers of their inputs, that are gone through at once.
CHUNK, NUMBERS = 2000, 50_000
HIDDEN, EPOCHS, PATIENCE, RATE, DECAY = 8, 60, 8, 0.03, 1e-4


class Value:
    """An array that knows how its gradient goes back to what it was made from."""

    def __init__(self, data, made_from: tuple["Value", ...] = (), back: Callable[[np.ndarray], tuple] | None = None):
        self.data, self.made_from, self.back, self.grad = np.asarray(data, float), made_from, back, None

    def __add__(self, other: "Value") -> "Value":
        return Value(self.data + other.data, (self, other), lambda g: (_fit(g, self.data.shape), _fit(g, other.data.shape)))

    def __mul__(self, other: "Value") -> "Value":
        return Value(self.data * other.data, (self, other), lambda g: (_fit(g * other.data, self.data.shape), _fit(g * self.data, other.data.shape)))

    def __matmul__(self, other: "Value") -> "Value":
        return Value(self.data @ other.data, (self, other), lambda g: (g @ other.data.T, self.data.T @ g))

    def apply(self, f: Callable[[np.ndarray], np.ndarray], slope: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> "Value":
        out = f(self.data)
        return Value(out, (self,), lambda g: (g * slope(self.data, out),))

    def sigmoid(self) -> "Value":
        return self.apply(lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30))), lambda _, y: y * (1 - y))

    def tanh(self) -> "Value":
        return self.apply(np.tanh, lambda _, y: 1 - y * y)

    def leaky(self, slope: float = 0.0) -> "Value":
        return self.apply(lambda x: np.where(x > 0, x, slope * x), lambda x, _: np.where(x > 0, 1.0, slope))

    def exp(self) -> "Value":
        return self.apply(np.exp, lambda _, y: y)

    def one_less(self) -> "Value":
        return self.apply(lambda x: 1 - x, lambda x, _: -np.ones_like(x))

    def inverse(self) -> "Value":
        return self.apply(lambda x: 1 / x, lambda _, y: -y * y)

    def rows(self, which: np.ndarray) -> "Value":
        def back(g: np.ndarray) -> tuple[np.ndarray]:
            out = np.zeros_like(self.data)
            np.add.at(out, which, g)
            return (out,)

        return Value(self.data[which], (self,), back)

    def summed(self, into: np.ndarray, n: int) -> "Value":
        """Rows added up by number."""
        out = np.zeros((n, *self.data.shape[1:]))
        np.add.at(out, into, self.data)
        return Value(out, (self,), lambda g: (g[into],))

    def beside(self, other: "Value") -> "Value":
        k = self.data.shape[1]
        return Value(np.concatenate([self.data, other.data], 1), (self, other), lambda g: (g[:, :k], g[:, k:]))

    def backward(self, g: np.ndarray) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack += [(v, True), *((p, False) for p in v.made_from)]
        for v in order:
            v.grad = None
        self.grad = g
        for v in reversed(order):
            if v.back is not None and v.grad is not None:
                for p, own in zip(v.made_from, v.back(v.grad)):
                    p.grad = own if p.grad is None else p.grad + own


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient of what was spread over more rows or columns, added up."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(k, keepdims=True)
    return g


Weights = dict[str, Value]


def weights(rng: np.random.Generator, **shapes: tuple[int, int]) -> Weights:
    return {k: Value(np.zeros(s) if k.startswith("b") else rng.normal(0, 1 / np.sqrt(s[0]), s)) for k, s in shapes.items()}


def gru_weights(rng: np.random.Generator, inputs: int, hidden: int = HIDDEN) -> Weights:
    return weights(rng, **{f"w{g}": (inputs, hidden) for g in "zrh"}, **{f"u{g}": (hidden, hidden) for g in "zrh"}, **{f"b{g}": (1, hidden) for g in "zrh"})


def gru(w: Weights, steps: list[tuple[Value, np.ndarray]], n: int) -> Value:
    """Last states of a gated recurrent unit over steps of (inputs, whether each row is live); other rows stay as they are."""
    h = Value(np.zeros((n, w["uz"].data.shape[0])))
    for x, live in steps:
        z = (x @ w["wz"] + h @ w["uz"] + w["bz"]).sigmoid()
        r = (x @ w["wr"] + h @ w["ur"] + w["br"]).sigmoid()
        new = (x @ w["wh"] + (r * h) @ w["uh"] + w["bh"]).tanh()
        gate = z * Value(live[:, None].astype(float))
        h = gate.one_less() * h + gate * new
    return h


def attended(w: Weights, x: Value, src: np.ndarray, dst: np.ndarray, log_weight: np.ndarray, heads: int = 2) -> Value:
    """Additive attention over in-edges (loops included by the caller) with the log of weights as prior; heads are averaged."""
    out = None
    for k in range(heads):
        h = x @ w[f"a{k}"]
        score = ((h @ w[f"s{k}"]).rows(dst) + (h @ w[f"t{k}"]).rows(src)).leaky(0.2) + Value(log_weight[:, None])
        top = np.full((len(x.data), 1), -np.inf)
        np.maximum.at(top, dst, score.data)
        e = (score + Value(-top[dst])).exp()
        share = e * e.summed(dst, len(x.data)).inverse().rows(dst)
        got = (h.rows(src) * share).summed(dst, len(x.data)) * Value(1 / heads)
        out = got if out is None else out + got
    return out


PARTS = {"train": 0, "validation": 1, "test": 2}


Inputs = tuple[np.ndarray, np.ndarray]
#: Logits of rows from weights and two lists of numbers for each row, as (lengths, values in a row).
Forward = Callable[[Weights, Inputs, Inputs], Value]


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, Inputs, Inputs]]:
    """(job, part, label, own, others) of rows of one job, a few at a time."""
    job = b.column("_job").to_numpy()
    sizes = pa.compute.list_value_length(b.column("_own")).to_numpy() + pa.compute.list_value_length(b.column("_others")).to_numpy()
    for j in np.unique(job):
        mine = np.flatnonzero(job == j)
        place = np.maximum(np.arange(mine.size) // CHUNK, np.cumsum(sizes[mine]) // NUMBERS)
        for at in np.split(mine, np.flatnonzero(np.diff(place)) + 1):
            part = b.take(pa.array(at))
            lists = [(pa.compute.list_value_length(part.column(c)).to_numpy(), part.column(c).flatten().to_numpy()) for c in ("_own", "_others")]
            yield int(j), part.column("_part").to_numpy(), part.column("_y").to_numpy(), *lists


def _sums(rows: DataFrame, weights: dict[int, dict[str, np.ndarray]], forwards: list[Forward], balance: list[tuple[float, float]]) -> dict[int, np.ndarray]:
    """For each job: the loss of its check rows (part 1), then the gradients of its training rows (part 0), added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for j, part, y, own, others in _chunks(b):
                w = {k: Value(v) for k, v in weights[j].items()}
                with np.errstate(divide="ignore", invalid="ignore"):  # of nodes that nobody asks about
                    out = forwards[j](w, own, others)
                    p = 1 / (1 + np.exp(-np.clip(out.data[:, 0], -30, 30)))
                    weight = np.where(y == 1, *balance[j])
                    loss = -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
                    got = [np.array([loss[part == 0].sum(), loss[part == 1].sum()])]
                    if (part == 0).any():
                        out.backward(((p - y) * weight * (part == 0))[:, None])
                    got += [(v.grad if v.grad is not None else np.zeros(v.data.shape)).ravel() for v in w.values()]
                total[j] = total.get(j, 0) + np.concatenate(got)
        if total:
            here = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([here] * len(total), pa.int32()), pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["at", "job", "sums"])

    some = rows.where(F.col("_job").isin(list(weights)) & (F.col("_part") < 2)).select("_job", "_part", "_y", "_own", "_others")
    out: dict[int, np.ndarray] = {}
    for r in sorted(some.mapInArrow(run, "at int, job int, sums array<double>").collect(), key=lambda r: (r["job"], r["at"])):  # a row of weights' size for each task and job
        out[r["job"]] = out.get(r["job"], 0) + np.array(r["sums"])
    return out


def fit_rows(rows: DataFrame, start: list[Weights], forwards: list[Forward], ids: list[str], epochs: int = EPOCHS) -> DataFrame:
    """(ids, p1) of the rows of part 2, for rows (ids, _job, _part: 0, 1 or 2, _y, _own, _others: arrays of double) and each job's first weights.

    Weighted cross-entropy on part 0 by Adam, stopped by that of part 1 (or of part 0, where there is none).
    """
    rows = cut(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2))
    counts = {r["_job"]: r for r in rows.groupBy("_job").agg(*(F.count_if(F.col("_part") == k).alias(f"n{k}") for k in (0, 1)), F.count_if((F.col("_part") == 0) & (F.col("_y") == 1)).alias("ones")).collect()}
    n = [(counts[j]["n0"], counts[j]["n1"], counts[j]["ones"]) if j in counts else (0, 0, 0) for j in range(len(start))]
    share = [ones / train if train else 0.5 for train, _, ones in n]
    balance = [(0.5 / max(x, 1e-9), 0.5 / max(1 - x, 1e-9)) for x in share]
    now = [{k: v.data.copy() for k, v in w.items()} for w in start]
    first, second = ([{k: np.zeros_like(v) for k, v in w.items()} for w in now] for _ in range(2))
    best, bad, kept = [np.inf] * len(now), [0] * len(now), [{k: v.copy() for k, v in w.items()} for w in now]
    going = sorted(counts)
    for t in range(1, epochs + 1):
        sums = _sums(rows, {j: now[j] for j in going}, forwards, balance)
        for j in list(going):
            got = sums.get(j, np.zeros(2 + sum(v.size for v in now[j].values())))
            loss = got[1] / n[j][1] if n[j][1] else got[0] / max(n[j][0], 1)
            if loss < best[j] - 1e-6:
                best[j], bad[j], kept[j] = loss, 0, {k: v.copy() for k, v in now[j].items()}
            else:
                bad[j] += 1
                if bad[j] > PATIENCE:
                    going.remove(j)
                    continue
            at = 2
            for k, v in now[j].items():
                g = got[at : at + v.size].reshape(v.shape) / max(n[j][0], 1) + DECAY * v
                at += v.size
                first[j][k] += 0.1 * (g - first[j][k])
                second[j][k] += 0.001 * (g * g - second[j][k])
                now[j][k] = v - RATE * (first[j][k] / (1 - 0.9**t)) / (np.sqrt(second[j][k] / (1 - 0.999**t)) + 1e-8)
        if not going:
            break

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            job = b.column("_job").to_numpy()
            p = np.empty(b.num_rows)
            done = {int(j): [] for j in np.unique(job)}
            for j, _, _, own, others in _chunks(b):
                with np.errstate(divide="ignore", invalid="ignore"):
                    done[j].append(1 / (1 + np.exp(-np.clip(forwards[j]({k: Value(v) for k, v in kept[j].items()}, own, others).data[:, 0], -30, 30))))
            for j, some in done.items():
                p[job == j] = np.concatenate(some)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ids), pa.array(p)], [*ids, "p1"])

    out = cut(rows.where("_part = 2").mapInArrow(predict, rows.select(*ids).schema.add("p1", "double")))
    discard(rows)
    return out


def _sequence_logits(w: Weights, own: Inputs, _: Inputs) -> Value:
    lengths, values = own
    x = np.zeros((lengths.size, max(1, int(lengths.max(initial=1)))))
    x[np.arange(x.shape[1]) < lengths[:, None]] = values
    steps = [(Value(np.stack([x[:, t], np.ones(len(x))], 1)), lengths > t) for t in range(x.shape[1])]
    return gru(w, steps, len(x)) @ w["o"] + w["bo"]


def train_sequences(rows: DataFrame, sequence: str, label: str, part: str, *keys: str, seed: int = 0) -> DataFrame:
    """A recurrent network for each key over sequences of numbers; p1 of 'test' rows."""
    jobs = rows.select(*keys).distinct().collect()  # a few
    same = [F.lit(True)]
    for r in jobs:
        one = F.lit(True)
        for k in keys:
            one = one & F.col(k).eqNullSafe(F.lit(r[k]))
        same.append(one)
    job = F.coalesce(*(F.when(c, k) for k, c in enumerate(same[1:])), F.lit(None).cast("int"))
    dealt = rows.select(*keys, "row", label, job.alias("_job"), _part(F.col(part)).alias("_part"), F.col(label).cast("double").alias("_y"), F.col(sequence).cast("array<double>").alias("_own"), F.array().cast("array<double>").alias("_others"))
    start = []
    for _ in jobs:
        rng = np.random.default_rng(seed)
        start.append(gru_weights(rng, 2) | weights(rng, o=(HIDDEN, 1), bo=(1, 1)))
    return fit_rows(dealt.where("_part is not null"), start, [_sequence_logits] * len(start), [*keys, "row", label])


def _part(c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, v) for k, v in PARTS.items()))


#: Graph models by name: the reversed one takes messages from targets, the aligned one takes none.
MODELS = ("gcn", "sage", "gat", "gat_reversed", "gcn_gru", "aligned_gru")


def _propagation(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of D^-1/2 ((A + A^T) / 2 + I) D^-1/2."""
    i, j = np.concatenate([src, dst, np.arange(n)]), np.concatenate([dst, src, np.arange(n)])
    v = np.concatenate([w / 2, w / 2, np.ones(n)])
    d = np.bincount(i, weights=v, minlength=n)
    return j, i, v / np.sqrt(d[i] * d[j])


def model_outputs(model: str, w: Weights, features: list[np.ndarray], graphs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> list[Value]:
    """Logits of all nodes for each period, from the features and edges (src, dst, w) of that period's past."""
    out, states = [], []
    for x, (src, dst, weight) in zip(features, graphs):
        x = Value(x)
        if model in ("gcn", "gcn_gru"):
            j, i, v = _propagation(src, dst, weight, n)
            h = ((x.rows(j) * Value(v[:, None])).summed(i, n) @ w["g"] + w["bg"]).leaky()
        elif model == "sage":
            total = np.bincount(dst, weights=weight, minlength=n)
            mean = (x.rows(src) * Value((weight / np.maximum(total[dst], 1e-12))[:, None])).summed(dst, n)
            h = (x.beside(mean) @ w["g"] + w["bg"]).leaky()
        elif model.startswith("gat"):
            a, b = (dst, src) if model == "gat_reversed" else (src, dst)
            h = attended(w, x, np.concatenate([a, np.arange(n)]), np.concatenate([b, np.arange(n)]), np.log1p(np.concatenate([weight, np.ones(n)]))).leaky()
        else:
            h = (x @ w["g"] + w["bg"]).leaky()
        if model.endswith("gru"):
            states.append((h, np.ones(n, bool)))
            h = gru(w, states[-4:], n)
        out.append(h @ w["o"] + w["bo"])
    return out


def model_weights(model: str, rng: np.random.Generator, inputs: int) -> Weights:
    w = weights(rng, o=(HIDDEN, 1), bo=(1, 1))
    if model.startswith("gat"):
        for k in range(2):
            w |= weights(rng, **{f"a{k}": (inputs, HIDDEN), f"s{k}": (HIDDEN, 1), f"t{k}": (HIDDEN, 1)})
    else:
        w |= weights(rng, g=(inputs * (2 if model == "sage" else 1), HIDDEN), bg=(1, HIDDEN))
    return w | (gru_weights(rng, HIDDEN) if model.endswith("gru") else {})


def _row_logits(model: str, d: int) -> Forward:
    """Of rows whose inputs are what model_outputs computes for their nodes: propagated or mean features, states of up to four periods, or own
    features and others' with the log of weights."""

    def hidden(w: Weights, x: np.ndarray) -> Value:
        return (Value(x) @ w["g"] + w["bg"]).leaky()

    def of(w: Weights, own: Inputs, others: Inputs) -> Value:
        lengths, values = own
        n = lengths.size
        if model.startswith("gat"):
            near = others[1].reshape(-1, d + 1)
            to = np.repeat(np.arange(n), others[0] // (d + 1))
            x = Value(np.concatenate([values.reshape(n, d), near[:, :d]]))
            src, dst = np.concatenate([n + np.arange(len(near)), np.arange(n)]), np.concatenate([to, np.arange(n)])
            h = attended(w, x, src, dst, np.concatenate([near[:, d], np.full(n, np.log1p(1.0))])).leaky().rows(np.arange(n))
        elif model.endswith("gru"):
            periods = lengths // d
            first = np.cumsum(periods) - periods
            x, steps = values.reshape(-1, d), []
            for t in range(int(periods.max(initial=1))):
                live = periods > t
                now = np.zeros((n, d))
                now[live] = x[first[live] + t]
                steps.append((hidden(w, now), live))
            h = gru(w, steps, n)
        else:
            h = hidden(w, values.reshape(n, -1))
        return h @ w["o"] + w["bo"]

    return of


def train_graph_models(rows: DataFrame, edges: DataFrame, period: str, node: str, features: list[str], label: str, models: tuple[str, ...] = MODELS, seed: int = 0) -> DataFrame:
    """(model, period, node, y, p1) of the last period, for models that see only earlier periods' features and edges.

    rows has (period, node, features, label), edges (period, src, dst, w). A row's features are those of the period before,
    zeros where there are none; the last period is the test, the one before it stops the training.
    """
    periods = [r[0] for r in rows.select(period).distinct().orderBy(period).collect()]  # a few
    number = F.coalesce(*(F.when(F.col(period) == F.lit(p), k) for k, p in enumerate(periods)), F.lit(None).cast("int"))
    d, last = len(features), len(periods) - 1
    xs, zs = [f"x{k}" for k in range(d)], [f"z{k}" for k in range(d)]
    own = rows.select(number.alias("t"), F.col(node).cast("long").alias("node"), *(F.col(c).cast("double").alias(x) for c, x in zip(features, xs)), F.col(label).cast("double").alias("_y")).where("t is not null")
    fitted = own.where(F.col("t") < last - 1) if len(periods) > 2 else own
    fitted = fitted.agg(*(f(x).alias(f"{n}_{x}") for x in xs for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scale = lambda x: (F.col(x) - F.lit(fitted[f"m_{x}"])) / F.lit(fitted[f"s_{x}"] or 1.0)
    own = cut(own.select("t", "node", "_y", *(F.coalesce(scale(x), F.lit(0.0)).alias(x) for x in xs)))
    links = cut(edges.select(number.alias("t"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).where(F.col("t") < last))
    x = own.select("t", "node", *xs)
    at = lambda c, table=x: table.withColumnRenamed("node", c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    numbers = lambda *cs: F.array(*(zero(F.col(c)) for c in cs))
    none = F.array().cast("array<double>")
    asked = own.where("t > 0").select((F.col("t") - 1).alias("t"), F.col("t").alias("now"), "node", "_y")

    def propagated() -> DataFrame:
        """(t, node, z) by D^-1/2 ((A + A^T) / 2 + I) D^-1/2."""
        half = links.select("t", F.col("dst").alias("node"), F.col("src").alias("other"), (F.col("w") / 2).alias("v"))
        half = half.unionByName(links.select("t", F.col("src").alias("node"), F.col("dst").alias("other"), (F.col("w") / 2).alias("v")))
        degree = half.groupBy("t", "node").agg((F.sum("v") + 1).alias("d"))
        own_share = x.join(degree, ["t", "node"], "left").select("t", "node", *(F.col(a) / F.sqrt(F.coalesce("d", F.lit(1.0))) for a in xs)).toDF("t", "node", *zs)
        told = half.join(at("other", own_share), ["t", "other"]).select("t", "node", *(F.col("v") * F.col(z) for z in zs)).toDF("t", "node", *zs)
        total = told.unionByName(own_share).groupBy("t", "node").agg(*(F.sum(z).alias(z) for z in zs))
        return total.join(degree, ["t", "node"], "left").select("t", "node", *((F.col(z) / F.sqrt(F.coalesce("d", F.lit(1.0)))).alias(z) for z in zs))

    def means() -> DataFrame:
        sums = links.join(at("src"), ["t", "src"], "left").groupBy("t", F.col("dst").alias("node"))
        return sums.agg(*((F.sum(F.col("w") * zero(F.col(a))) / F.greatest(F.sum("w"), F.lit(1e-12))).alias(z) for a, z in zip(xs, zs)))

    def inputs(model: str) -> DataFrame:
        if model == "gcn":
            return asked.join(propagated(), ["t", "node"], "left").select("now", "node", "_y", numbers(*zs).alias("_own"), none.alias("_others"))
        if model == "sage":
            return asked.join(x, ["t", "node"], "left").join(means(), ["t", "node"], "left").select("now", "node", "_y", numbers(*xs, *zs).alias("_own"), none.alias("_others"))
        if model.startswith("gat"):
            a, b = ("dst", "src") if model == "gat_reversed" else ("src", "dst")
            near = links.join(at(a), ["t", a], "left").groupBy("t", F.col(b).alias("node")).agg(F.flatten(F.collect_list(F.array(*(zero(F.col(c)) for c in xs), F.log1p("w")))).alias("near"))
            return asked.join(x, ["t", "node"], "left").join(near, ["t", "node"], "left").select("now", "node", "_y", numbers(*xs).alias("_own"), F.coalesce("near", none).alias("_others"))
        states, names = (propagated(), zs) if model == "gcn_gru" else (x, xs)
        each = asked.select("now", "node", "_y", F.explode(F.sequence(F.greatest(F.lit(0), F.col("t") - 3), F.col("t"))).alias("t"))
        each = each.join(states, ["t", "node"], "left").groupBy("now", "node", "_y").agg(F.array_sort(F.collect_list(F.struct("t", numbers(*names).alias("v"))))["v"].alias("v"))
        return each.select("now", "node", "_y", F.flatten("v").alias("_own"), none.alias("_others"))

    every = None
    for k, model in enumerate(models):
        got = inputs(model).select(F.lit(model).alias("model"), F.lit(k).alias("_job"), "now", "node", "_y", F.col("_own"), F.col("_others"))
        every = got if every is None else every.unionByName(got)
    part = F.when(F.col("now") == last, 2).when(F.col("now") == last - 1, 1).otherwise(0)
    start = [model_weights(m, np.random.default_rng(seed), d) for m in models]
    p = fit_rows(every.withColumn("_part", part), start, [_row_logits(m, d) for m in models], ["model", "node", "_y"])
    discard(own, links)
    return p.select("model", F.lit(periods[-1] if periods else None).cast(dict(rows.dtypes)[period]).alias("period"), "node", F.col("_y").cast("int").alias("y"), "p1")
