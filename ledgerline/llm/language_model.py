"""Operator 7: language-model scores by a log-bilinear model over word classes.

1. Counts: every token of the training texts is counted (per task in Python, then summed by
   Spark). Only a bounded part leaves Spark: the commonest words, at most ``LOCAL``, found
   through a histogram of counts.
2. Classes: the ``HEAD`` commonest words are classes of their own; the others fall into
   ``TAIL`` classes by a hash of their last letters. Within a class a word has probability
   (count + 0.5) / (sum over its known words + 0.5 for one unseen word).
3. Log-bilinear model: the score of class k after classes c1, c2 is (A1[c1] + A2[c2]) . Q[k]
   + b[k]. Noise-contrastive estimation in numpy: from a start on a bounded sample
   (at most ``WARM_DOCS`` rows, by a hash of row number and text), every task passes once over all its training texts, and
   Spark averages the tasks' parameters, weighted by their tokens.
4. Scores: a batched matrix product gives the normaliser of each context of two classes, so
   log P(token) = log P(class | context) + log P(token | class) sums to one over the vocabulary
   and one unseen word for each tail class. Counts of words outside the ``LOCAL`` ones come by
   an equi-join on the word; common words never enter it, so no key is hot.

Defined results: a null or empty text is one end token; with no training texts every count is
0; a null doc_id counts as training; rows that repeat are scored alike, each; an empty table
gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_batches, text_words

END = b""  # no word is empty
LOCAL = 1 << 18
HEAD, TAIL, DIM = 512, 64, 16
WARM_DOCS, WARM_EPOCHS = 1000, 4
BATCH, NOISE, RATE = 1024, 32, 0.07
FLUSH = 400_000  # distinct words that a counting task holds
PIECE = 4 << 20  # characters of text taken at a time
_NORMALISERS: dict[str, np.ndarray] = {}  # of the model that this worker used last


def tail_class(word: bytes) -> int:
    return HEAD + zlib.crc32(word[-3:]) % TAIL


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of the one column; a text ends with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "n"])
            n.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(text_words(t))
                n[END] += 1
                if len(n) > FLUSH:
                    yield flush()
        yield flush()

    row_batches(texts.sparkSession)
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The commonest words with their counts, and what classes need of all others."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    tail_mass: np.ndarray  # of each tail class: sum of count + 0.5 over its known words, + 0.5
    index: dict = field(default_factory=dict)

    def open(self) -> Vocabulary:
        if not self.index:
            self.index = {w: i for i, w in enumerate(self.words)}
            self.classes = np.array([i if i < HEAD else tail_class(w) for i, w in enumerate(self.words)], dtype=np.int32)
            self.log_counts = np.log10(self.counts + 0.5)
            self.end = int(self.classes[self.index[END]]) if END in self.index else tail_class(END)
        return self

    def class_ids(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place among the local words or -1, class) of each token."""
        at = np.array(list(map(self.index.get, tokens, repeat(-1))), dtype=np.int32)
        k = self.classes[at] if len(self.words) else np.zeros(len(at), dtype=np.int32)
        for i in np.flatnonzero(at < 0):
            k[i] = tail_class(tokens[i])
        return at, k

    def class_shares(self) -> np.ndarray:
        head = np.full(HEAD, 0.5)
        head[:min(HEAD, len(self.words))] += self.counts[:HEAD]
        mass = np.concatenate([head, self.tail_mass])
        return mass / mass.sum()


def vocabulary(counts: DataFrame, local: int = LOCAL) -> Vocabulary:
    steps = counts.groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    # a row for each 64th of a power of two that counts reach: some thousand at most
    hist = sorted((r.step, r.words, r.n) for r in steps.collect())
    total, distinct = sum(h[2] for h in hist), sum(h[1] for h in hist)
    least, room = None, local
    for step, words, _ in reversed(hist):
        if words > room:
            break
        least, room = step, room - words
    rows = [] if least is None else counts.where(F.floor(F.log2("n") * 64) >= least).toPandas().itertuples(index=False)
    top = sorted(((-r.n, bytes(r.word)) for r in rows))
    words, n = [w for _, w in top], np.array([-c for c, _ in top], dtype=np.int64)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.array([tail_class(w) - HEAD for w in b.column(0).to_pylist()], dtype=np.int64)
            mass = np.bincount(k, weights=b.column(1).to_numpy() + 0.5, minlength=TAIL)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL)), pa.array(mass)], ["k", "mass"])

    mass = np.full(TAIL, 0.5)
    for r in counts.mapInArrow(classes, "k long, mass double").groupBy("k").agg(F.sum("mass")).collect():
        mass[r[0]] += r[1]
    for w, c in zip(words[:HEAD], n[:HEAD]):  # head words are no tail words
        mass[tail_class(w) - HEAD] -= c + 0.5
    return Vocabulary(words, n, total, distinct, np.maximum(mass, 0.5))


def streams(texts: list, v: Vocabulary) -> Iterator[tuple]:
    """(first text, lengths in tokens, tokens, places, classes, c1, c2) for pieces of some texts."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars < PIECE):
            chars += len(texts[hi] or "")
            hi += 1
        tokens: list[bytes] = []
        lengths = []
        for t in texts[lo:hi]:
            w = text_words(t)
            tokens += w
            tokens.append(END)
            lengths.append(len(w) + 1)
        at, k = v.class_ids(tokens)
        c1 = np.concatenate([[v.end], k[:-1]]).astype(np.int32)
        c2 = np.concatenate([[v.end], c1[:-1]]).astype(np.int32)
        c2[np.cumsum([0, *lengths[:-1]])] = v.end
        yield lo, np.array(lengths), tokens, at, k, c1, c2
        lo = hi


class LogBilinear:
    """Parameters as one vector: A1, A2, Q (classes x DIM each) and b (classes)."""

    def __init__(self, params: np.ndarray, shares: np.ndarray, name: str):
        n = len(shares)
        self.params, self.shares, self.name = params, shares, name
        self.a1, self.a2, self.q = params[:3 * n * DIM].reshape(3, n, DIM)
        self.b = params[3 * n * DIM:]
        self.speed = np.full((4, n), 1e-3, dtype=np.float32)  # Adagrad's squared gradients, by row

    @classmethod
    def start(cls, shares: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(11)
        n = len(shares)
        params = np.concatenate([rng.normal(0, 0.1, 3 * n * DIM), np.log(shares)]).astype(np.float32)
        return cls(params, shares, uuid.uuid4().hex)

    def copy(self) -> LogBilinear:
        other = LogBilinear(self.params.copy(), self.shares, self.name)
        other.speed = self.speed.copy()
        return other

    def learn(self, k: np.ndarray, c1: np.ndarray, c2: np.ndarray, rng: np.random.Generator) -> None:
        """Noise-contrastive steps over one stream; a step's tokens share their noise words."""
        log_noise = np.log(NOISE * self.shares).astype(np.float32)
        cdf = np.cumsum(self.shares)
        for lo in range(0, len(k), BATCH):
            kk, x1, x2 = k[lo:lo + BATCH], c1[lo:lo + BATCH], c2[lo:lo + BATCH]
            noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), len(cdf) - 1)
            p = self.a1[x1] + self.a2[x2]
            q = self.q[kk]
            true = np.einsum("ij,ij->i", p, q) + self.b[kk] - log_noise[kk]
            false = p @ self.q[noise].T + (self.b - log_noise)[noise]
            g_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
            g_false = 1 / (1 + np.exp(np.clip(-false, -30, 30)))
            g_p = g_true[:, None] * q + g_false @ self.q[noise]
            rows = np.concatenate([kk, noise])
            self._step(2, self.q, rows, np.concatenate([g_true[:, None] * p, g_false.T @ p]))
            self._step(3, self.b[:, None], rows, np.concatenate([g_true, g_false.sum(axis=0)])[:, None])
            self._step(0, self.a1, x1, g_p)
            self._step(1, self.a2, x2, g_p)

    def _step(self, which: int, table: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        uniq, first = np.unique(rows[order], return_index=True)
        g = np.add.reduceat(grad[order], first)
        self.speed[which, uniq] += (g * g).mean(axis=1)
        table[uniq] -= RATE * g / np.sqrt(self.speed[which, uniq])[:, None]

    def normalisers(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """log of the sum over all classes, for each context; one matrix product for contexts not met before."""
        n = len(self.shares)
        if self.name not in _NORMALISERS:
            _NORMALISERS.clear()
            _NORMALISERS[self.name] = np.full(n * n, np.nan, dtype=np.float32)
        known, key = _NORMALISERS[self.name], c1.astype(np.int64) * n + c2
        new = np.unique(key[np.isnan(known[key])])
        for lo in range(0, len(new), 4096):
            c = new[lo:lo + 4096]
            s = (self.a1[c // n] + self.a2[c % n]) @ self.q.T + self.b
            top = s.max(axis=1)
            known[c] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return known[key]

    def log10(self, k: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        s = np.einsum("ij,ij->i", self.a1[c1] + self.a2[c2], self.q[k]) + self.b[k]
        return (s - self.normalisers(c1, c2)).astype(np.float64) / np.log(10)


def warm_sample(texts: DataFrame, n_texts: int) -> DataFrame:
    """At most ``WARM_DOCS`` rows of the one column; rows of equal or null texts are drawn one by one."""
    text = texts.columns[0]
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.col(text)), F.lit(1 << 30)).alias("lot")
    few = texts.select(text, lot).where(F.col("lot") < int((1 << 30) * min(1.0, 2 * WARM_DOCS / n_texts)))
    return few.orderBy("lot").limit(WARM_DOCS).select(text)


def fit(texts: DataFrame, n_texts: int, v: Vocabulary) -> LogBilinear:
    """``texts``: one text column, the ``n_texts`` training rows."""
    model = LogBilinear.start(v.open().class_shares())
    if not n_texts:
        return model
    few = warm_sample(texts, n_texts).collect()
    rng = np.random.default_rng(5)
    for _ in range(WARM_EPOCHS):
        for _, _, _, _, k, c1, c2 in streams(sorted(r[0] or "" for r in few), v):
            model.learn(k, c1, c2, rng)
    shared = texts.sparkSession.sparkContext.broadcast((v, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vv, mine = shared.value[0].open(), shared.value[1].copy()
        gen, seen = np.random.default_rng(5), 0
        for b in batches:
            for _, _, _, _, k, c1, c2 in streams(b.column(0).to_pylist(), vv):
                mine.learn(k, c1, c2, gen)
                seen += len(k)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([mine.params]), pa.array([seen])], ["params", "seen"])

    row_batches(texts.sparkSession)
    each = texts.mapInArrow(run, "params array<float>, seen long").select("seen", F.posexplode("params").alias("at", "x"))
    mean = each.groupBy("at").agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).cast("float").alias("x"))
    got = mean.toPandas()  # a number for each parameter, however many tasks there were
    params = model.params.copy()
    params[got["at"].to_numpy()] = got["x"].to_numpy()
    return LogBilinear(params, model.shares, uuid.uuid4().hex)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", local: int = LOCAL) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``train``: condition of the rows to learn from, never null.
    """
    spark = docs.sparkSession
    training = docs.where(train).select(F.col(text_col).alias("t"))
    counts = materialize(count_words(training), "lm-counts")
    v = vocabulary(counts, local)
    end = counts.where(F.length("word") == 0).first()
    model = fit(training, end.n if end else 0, v)
    shared = spark.sparkContext.broadcast((v, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vv, m = shared.value[0].open(), shared.value[1]
        log_mass = np.concatenate([np.zeros(HEAD), np.log10(vv.tail_mass)])
        for b in batches:
            for lo, lengths, tokens, at, k, c1, c2 in streams(b.column(2).to_pylist(), vv):
                cuts = np.cumsum([0, *lengths[:-1]])
                near = at >= 0
                logc = np.where(near, vv.log_counts[at], 0.0) if len(vv.words) else np.zeros(len(at))
                sums = [np.add.reduceat(x, cuts) for x in (
                    near.astype(np.int64), logc, np.where(k < HEAD, 0.0, logc), m.log10(k, c1, c2) - log_mass[k])]
                far = np.flatnonzero(~near)
                offsets = np.searchsorted(far, [*cuts, len(at)]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), pa.array([tokens[i] for i in far], pa.binary()))
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(lengths), *map(pa.array, sums), words],
                    ["id", "trained", "n_tokens", "near", "logc", "logc_tail", "logp", "far"])

    row_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), train.alias("trained"), F.col(text_col)).mapInArrow(
        run, f"id {dict(docs.dtypes)[id_col]}, trained boolean, n_tokens long, near long, logc double, logc_tail double, logp double, far array<binary>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")  # written once: the key stays
    far = rows.select("row", F.explode("far").alias("word")).join(counts.withColumnRenamed("n", "c"), "word", "left")
    far = far.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("far_logc"), F.count("c").alias("far_known"))
    rows = rows.drop("far").join(far, "row", "left")
    zero = F.lit(0.0)
    far_logc, log_all = F.coalesce("far_logc", zero), float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    return rows.select(
        F.col("id").alias(id_col), "trained", "n_tokens", (F.col("near") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("logc") + far_logc - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("logp") + F.col("logc_tail") + far_logc).alias("score"))
