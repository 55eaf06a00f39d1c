"""Scores of texts by a hidden Markov language model.

Texts become chunks: token numbers in a dictionary of the chunk's own words, found by Arrow. Each word of a chunk with its
number of training tokens is a row; rows of a word meet once (one for each chunk that has it), which gives its count, and
go back to their chunks, so counts of all words are used and nothing that grows with the vocabulary is broadcast.

The model emits every word that is seen ``LEAST`` times by itself, the most frequent ``EMITTED`` at most (a bound on the
parameters that are broadcast), and so the end of a text; all other words through one class, inside which a word has its smoothed
share of the corpus, unseen words included; so every text has an exact probability. Latent states are trained by
Baum-Welch: every round goes over all training rows, expected counts come from each partition, are added up by a
group-by and make the next parameters. A scaled forward recursion, over groups of texts, computes each whole text's
likelihood.

States start from statistics of all training rows: which of the ``PROBES`` most frequent words stand in the same texts
splits these words into as many parts as there are states (by the leading eigenvectors of their correlations).

Null and empty texts are the end alone. Without training rows N and V are 0 and the model is uniform. Rows are kept one
for one, repeated ones too; a null doc_id counts as training. A text of any length is scored whole. Columns other than doc_id and
text don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import crc_mod, small_batches, table, tidied
from weftline.session import cut, discard, trim

STATES, ROUNDS = 6, 4
#: Words with an emission of their own: seen so often at least, and so many at most.
LEAST, EMITTED = 10, 32_768
PROBES = 128
#: How much likelier a state's own probes are at the start, and the chance to stay in a state.
LEANING, STAY = 8.0, 0.9
#: Pseudo-counts: of the overall distribution in each state's emissions, and of each transition.
SMOOTH, MOVES = 50.0, 1.0
#: Bytes of text in a chunk, and tokens of a group of texts that recursions go through together.
CHUNK, GROUP = 8 << 20, 400_000
#: Steps after which recursions are scaled.
SCALED = 8
HELD_OUT = (7, 2)
END = b""


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, numbers of all tokens among them, tokens of each text); words stand between ASCII white space, A-Z is
    lower-cased, and each text closes with the end, which has number 0."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(""))))
    coded = pc.list_flatten(split).dictionary_encode()
    codes, sizes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    nothing = pc.index(coded.dictionary, "").as_py()  # what an empty text is split into
    row = np.repeat(np.arange(sizes.size), sizes)
    if nothing >= 0:
        real = codes != nothing
        codes, row = codes[real], row[real]
        sizes = np.bincount(row, minlength=sizes.size)
    out = np.zeros(codes.size + sizes.size, np.int64)
    out[np.arange(codes.size) + row] = codes + 1
    return pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.cast(pa.binary())]), out, sizes + 1


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    #: emissions by symbol and state; the last symbol is the class of other words
    emit: np.ndarray
    #: what emissions are compared with, by symbol: recursions go over their quotients, which stay near 1
    overall: np.ndarray

    def _quotients(self) -> np.ndarray:
        return self.emit / self.overall[:, None]

    def _alphas(self, symbols: np.ndarray, live: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Forward variables, logs of the scales by text, and the scales by step."""
        at = [0, *np.cumsum(live).tolist()]
        alpha, logs, scales = np.empty_like(emitted), np.zeros(live[0]), {}
        for t, n in enumerate(live.tolist()):
            a = (alpha[at[t - 1] : at[t - 1] + n] @ self.move if t else self.start) * emitted[at[t] : at[t + 1]]
            if t % SCALED == 0:
                scales[t] = c = a.sum(1)
                a /= c[:, None]
                logs[:n] += np.log(c)
            alpha[at[t] : at[t + 1]] = a
        return alpha, logs, scales

    def forward(self, symbols: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Natural log-likelihoods of a group of texts."""
        alpha, logs, _ = self._alphas(symbols, live, self._quotients()[symbols])
        begin = np.cumsum(live) - live
        for t, n in enumerate(live.tolist()):
            m = int(live[t + 1]) if t + 1 < live.size else 0
            if m < n:  # these end here
                logs[m:n] += np.log(alpha[begin[t] + m : begin[t] + n].sum(1))
        which = np.arange(symbols.size) - np.repeat(begin, live)
        return logs + np.bincount(which, weights=np.log(self.overall)[symbols], minlength=live[0])

    def expected(self, symbols: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected (start, move, emit) counts of a group of texts, by scaled forward and backward recursions."""
        emitted = self._quotients()[symbols]
        alpha, _, scales = self._alphas(symbols, live, emitted)
        at, moved, beta = [0, *np.cumsum(live).tolist()], np.zeros_like(self.move), None
        back = np.ascontiguousarray(self.move.T)
        for t in range(live.size - 1, -1, -1):
            own = alpha[at[t] : at[t + 1]]
            m = int(live[t + 1]) if t + 1 < live.size else 0
            now = np.empty_like(own)
            now[m:] = 1 / own[m:].sum(1)[:, None]  # of texts that end here
            if m:
                beta *= emitted[at[t + 1] : at[t + 2]]
                if t + 1 in scales:
                    beta /= scales[t + 1][:, None]
                moved += own[:m].T @ beta
                np.matmul(beta, back, out=now[:m])
            own *= now  # the chance of each state
            beta = now
        emit = np.stack([np.bincount(symbols, weights=alpha[:, s], minlength=self.emit.shape[0]) for s in range(self.start.size)], 1)
        return alpha[: at[1]].sum(0), moved * self.move, emit


def grouped(seqs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of at most ``GROUP`` tokens (or one text) and falling length: (their places; their symbols, step after
    step; how many are live at each step)."""
    sizes = np.array([s.size for s in seqs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    total = np.cumsum(sizes[order])
    lo = 0
    while lo < order.size:
        base = total[lo] - sizes[order[lo]]
        hi = max(lo + 1, int(np.searchsorted(total, base + GROUP, "right")))
        own = order[lo:hi]
        n = sizes[own]
        live = np.searchsorted(-n, -np.arange(n[0]), "left")
        begin = np.cumsum(live) - live
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        symbols = np.empty(step.size, np.int64)
        symbols[begin[step] + np.repeat(np.arange(n.size), n)] = np.concatenate([seqs[i] for i in own])
        yield own, symbols, live
        lo = hi


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds from docs (doc_id, text, held_out): a chunk with its tokens and its words' training counts (int32 as
    bytes), and each word of a chunk with n of them in training."""
    small_batches(docs.sparkSession)
    kinds = {"chunk": pa.int64(), "place": pa.int64(), "word": pa.binary(), "n": pa.int64(), "tokens": pa.binary(), "own": pa.binary(), "sizes": pa.list_(pa.int64()), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_())}
    schema = pa.schema(list(kinds.items()))

    def batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(size, t) for k, t in kinds.items()], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def passed() -> Iterator[pa.RecordBatch]:
            ids, texts, out = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
            words, tokens, sizes = numbered(texts)
            n = np.bincount(tokens[np.repeat(~out.to_numpy(zero_copy_only=False), sizes)], minlength=len(words))
            whole = {"tokens": tokens.astype(np.int32).tobytes(), "own": n.astype(np.int32).tobytes(), "sizes": sizes, "doc_id": ids.to_pylist(), "held_out": out.to_pylist()}
            yield batch(1, chunk=pa.array([number]), **{k: pa.array([v], kinds[k]) for k, v in whole.items()})
            for lo in range(0, len(words), 20_000):
                w = words.slice(lo, 20_000)
                yield batch(len(w), chunk=pa.array(np.full(len(w), number)), place=pa.array(np.arange(lo, lo + len(w))), word=w, n=pa.array(n[lo : lo + len(w)]))

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(1).nbytes
            if size > CHUNK:
                yield from passed()
                held, size, number = [], 0, number + 1
        if held:
            yield from passed()

    rows = docs.select("doc_id", "text", "held_out").mapInArrow(tidied(run), "chunk bigint, place bigint, word binary, n bigint, tokens binary, own binary, sizes array<bigint>, doc_id array<bigint>, held_out array<boolean>")
    return cut(rows)


def counted(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(chunk, place, n, c, first, word) of each word of a chunk: c of them in training, first in one row of each word; the word only if
    it is seen so often, or is the end."""
    w = Window.partitionBy("word")
    rows = rows.where("word is not null").select("chunk", "place", "word", "n")
    rows = rows.withColumns({"c": F.sum("n").over(w), "first": F.min("chunk").over(w) == F.col("chunk")})
    return cut(rows.withColumn("word", F.when((F.col("c") >= least) | (F.length("word") == 0), F.col("word"))))


def most_frequent(counts: DataFrame, most: int = EMITTED) -> list[tuple[bytes, int]]:
    """Of (word, c): so many, by falling count, ties to the lesser word; the end is one of them, first, if it is there."""
    end = counts.where(F.length("word") == 0)
    top = counts.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(most - 1)
    got = end.unionByName(top).toArrow()
    return sorted(zip(got["word"].to_pylist(), got["c"].to_pylist()), key=lambda x: (x[0] != END, -x[1], x[0]))


def prepared(rows: DataFrame, words: DataFrame, symbols: dict[bytes, int]) -> DataFrame:
    """Groups of texts, some for training and others held out: train, symbols, live, and what is known of each text.

    A chunk meets a list of those of its words that are seen elsewhere too, or often.
    """
    emitted, shared = len(symbols), rows.sparkSession.sparkContext.broadcast(symbols)
    back = words.where("c <> n or word is not null").groupBy("chunk").agg(F.collect_list(F.struct("place", "c", "word")).alias("found"))  # no more than a chunk's words
    both = rows.where("tokens is not null").select("chunk", "tokens", "own", "sizes", "doc_id", "held_out").join(back, "chunk", "left")
    lists = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "other": pa.float64()}

    def groups(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens, sizes = np.frombuffer(first.column("tokens")[0].as_py(), np.int32), first.column("sizes").flatten().to_numpy()
        c = np.frombuffer(first.column("own")[0].as_py(), np.int32).astype(np.int64)
        symbol, found, get = np.full(c.size, emitted), first.column("found").flatten(), shared.value.get
        if len(found):
            place = found.field("place").to_numpy()
            c[place] = found.field("c").to_numpy()
            symbol[place] = [get(w, emitted) for w in found.field("word").to_pylist()]
        logs, row = np.log10(c + 1.0), np.repeat(np.arange(sizes.size), sizes)
        add = lambda x: np.bincount(row, weights=x[tokens], minlength=sizes.size)
        known = {"doc_id": first.column("doc_id").flatten(), "held_out": first.column("held_out").flatten(), "n_tokens": pa.array(sizes), "n_known": pa.array(add(c > 0).astype(np.int64)), "base": pa.array(add(logs)), "other": pa.array(add(np.where(symbol == emitted, logs, 0)))}
        begin, out, of = np.cumsum(sizes) - sizes, known["held_out"].to_numpy(zero_copy_only=False), symbol[tokens].astype(np.int32)
        for train in (True, False):
            some = np.flatnonzero(out != train)
            for places, flat, live in grouped([of[begin[i] : begin[i] + sizes[i]] for i in some]):
                at = pa.array(some[places])
                columns = [pa.array([train]), pa.array([flat.astype(np.int32).tobytes()], pa.binary()), pa.array([live.astype(np.int32).tobytes()], pa.binary())]
                columns += [pa.array([known[x].take(at).to_pylist()], pa.list_(t)) for x, t in lists.items()]
                yield pa.RecordBatch.from_arrays(columns, ["train", "symbols", "live", *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from groups(b.slice(k, 1))

    small_batches(rows.sparkSession, 1)
    return cut(both.mapInArrow(tidied(run), "train boolean, symbols binary, live binary, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, other array<double>"))


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32).astype(np.int64)


def together(groups: DataFrame, probes: int) -> tuple[np.ndarray, float]:
    """In how many training texts each two of the symbols 1 to probes stand, and the number of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((probes, probes)), 0
        for b in batches:
            for flat, live in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat, live = _ints(flat), _ints(live)
                row = np.arange(flat.size) - np.repeat(np.cumsum(live) - live, live)
                some = (flat >= 1) & (flat <= probes)
                has = np.zeros((live[0], probes), np.float32)
                has[row[some], flat[some] - 1] = 1
                total += has.T @ has
                n += int(live[0])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, -1)), pa.array(np.append(total.ravel()[cell], float(n)))], ["cell", "n"])

    got = groups.where("train").select("symbols", "live").mapInArrow(tidied(run), "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(probes * probes)
    out[cell[cell >= 0]] = n[cell >= 0]
    return out.reshape(probes, probes), float(n[cell < 0].sum())


def starting(shared: np.ndarray, texts: float, overall: np.ndarray) -> Hmm:
    """Sticky states that lean to one part of the probes each."""
    rng, probes = np.random.default_rng(4), shared.shape[0]
    p = np.diag(shared) / max(texts, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = (shared / max(texts, 1) - np.outer(p, p)) / np.outer(spread, spread)
    _, vectors = np.linalg.eigh(correlation) if probes else (0, np.zeros((0, 1)))
    y = vectors[:, -(STATES - 1) :]
    y = y / np.maximum(np.linalg.norm(y, axis=1), 1e-12)[:, None]
    part = np.zeros(probes, int)
    if probes:
        centre = [0]
        for _ in range(STATES - 1):  # farthest first
            centre.append(int(np.argmin((y @ y[centre].T).max(1))))
        c = y[centre]
        for _ in range(10):
            part = np.argmax(y @ c.T, 1)
            c = np.stack([y[part == s].sum(0) if (part == s).any() else c[s] for s in range(STATES)])
            c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    leaning = rng.uniform(0.9, 1.1, (overall.size, STATES))
    leaning[1 : probes + 1][part[:, None] != np.arange(STATES)] /= LEANING
    emit = overall[:, None] * leaning
    move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
    np.fill_diagonal(move, STAY)
    return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(0), overall)


def improved(model: Hmm, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
    """The next parameters from expected counts."""
    start, move, emit = start + MOVES, move + MOVES, emit + SMOOTH * model.overall[:, None]
    return Hmm(start / start.sum(), move / move.sum(1)[:, None], emit / emit.sum(0), model.overall)


def train(groups: DataFrame, overall: np.ndarray) -> Hmm:
    """Baum-Welch over all training groups."""
    spark, symbols = groups.sparkSession, overall.size
    small_batches(spark, 1)
    model = starting(*together(groups, min(PROBES, max(symbols - 2, 0))), overall)
    schema = "symbol bigint, " + ", ".join(f"s{s} double" for s in range(STATES))
    for _ in range(ROUNDS):
        parameters = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], parameters=parameters) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((symbols, STATES))]
            for b in batches:
                for flat, live in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for own, more in zip(total, parameters.value.expected(_ints(flat), _ints(live))):
                        own += more
            every = np.concatenate([total[2], total[1], total[0][None, :]])
            used = np.flatnonzero(every.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(every[used, s]) for s in range(STATES))], ["symbol", *(f"s{s}" for s in range(STATES))])

        got = groups.where("train").select("symbols", "live").mapInArrow(tidied(expect), schema).groupBy("symbol").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES))).toArrow()
        every = np.zeros((symbols + STATES + 1, STATES))
        every[got["symbol"].to_numpy()] = np.stack([got[f"s{s}"].to_numpy() for s in range(STATES)], 1)
        model = improved(model, every[-1], every[symbols:-1], every[:symbols])
        parameters.unpersist()
    return model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text)."""
    spark = docs.sparkSession
    m, out = HELD_OUT
    rows = chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod("doc_id", m) == out).alias("held_out")))
    words = counted(rows)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("first") & (F.col("c") > 0))).first()
    top = most_frequent(words.where("first and word is not null and c > 0").select("word", "c"))
    c = np.array([x for _, x in top], np.int64)
    rest = float(n + v + 1 - (c + 1).sum())  # of words without an emission, unseen ones included
    overall = np.append(c + 1, rest) / (n + v + 1)
    groups, emitted = prepared(rows, words, {w: i for i, (w, _) in enumerate(top)}), len(top)
    discard(rows, words)
    del top
    trim()  # the driver has done with the words
    shared = spark.sparkContext.broadcast(train(groups, overall))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                flat, live = _ints(b.column(0)[k].as_py()), _ints(b.column(1)[k].as_py())
                logs = shared.value.forward(flat, live) / np.log(10)
                row = np.arange(flat.size) - np.repeat(np.cumsum(live) - live, live)
                others = np.bincount(row, weights=flat == emitted, minlength=live[0])
                known = [b.column(x).slice(k, 1).flatten() for x in range(2, 8)]
                total = logs + known[5].to_numpy() - others * np.log10(rest)
                yield pa.RecordBatch.from_arrays([*known[:5], pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    small_batches(spark, 1)
    got = groups.drop("train").mapInArrow(tidied(run), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    zero = F.lit(float(np.log10(n + v + 1)))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * zero).alias("base_score"), "score")


def op4_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
