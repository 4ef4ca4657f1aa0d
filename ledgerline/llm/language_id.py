"""Operator 9: language ID by averaged hashed subword embeddings and a linear softmax.

A text's features are its byte n-grams (``GRAMS``) over lower-cased letters, hashed into
``BUCKETS``; their embeddings are averaged and a linear softmax gives the languages. The
model is trained by stochastic gradient descent in numpy on the driver, on at most
``DOCS_PER_LANG`` labelled rows of each language (chosen by hash, whole texts, cut
into lines so that short texts are learned too). Everything else covers all documents.

As the classes are linear in the averaged embeddings, prediction uses the product of both
matrices: one weight for each bucket and class, summed over all n-grams of the whole text.

Calibrated rejection: a temperature fitted on documents kept from training makes the
softmax a probability; a document is rejected if its probability, or the share of its
features that training has seen (low in other scripts and in noise), is under the threshold
that ``REJECT_SHARE`` of the rightly told validation lines fall under. The features seen are
kept in a bitmap of a wider hash, at least ``SPARE`` bits for each, so that it never fills up.

Defined results: a null text or one without a letter gives ``und``, score 0, rejected; with
no labelled rows to learn from, so does every text; rows that repeat are told alike; an
empty table gives no rows; null labels are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_batches

UNKNOWN = "und"
GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 16
DOCS_PER_LANG = 500
EPOCHS, BATCH, RATE = 3, 64, 2.0
REJECT_SHARE = 0.001
SPARE, MAX_SEEN_BITS = 16, 28  # an unseen feature passes for a seen one at most once in SPARE times
_BLANKS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def normalised(text: str) -> bytes:
    """Lower-cased letters, every run of other ASCII characters one blank, a blank at both ends."""
    return b" ".join([b"", *text.lower().encode("utf-8").translate(_BLANKS).split(), b""])


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """32-bit hash of the n-gram at every position of ``data`` (bytes as uint32); the first 15 bits are its bucket."""
    m = max(len(data) - n + 1, 0)
    h = np.full(m, 2166136261 + n, dtype=np.uint32)
    for k in range(n):
        h *= np.uint32(16777619)
        h += data[k:k + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(2654435769)
    return h


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    return gram_hashes(data, n) >> np.uint32(32 - 15)


assert BUCKETS == 1 << 15


def seen_bitmap(texts: list[bytes]) -> tuple[int, np.ndarray]:
    """(bits, bitmap bytes) of the n-grams of ``texts``."""
    grams = np.zeros(0, dtype=np.uint32)
    for lo in range(0, len(texts), 1000):
        data = [np.frombuffer(t, dtype=np.uint8).astype(np.uint32) for t in texts[lo:lo + 1000]]
        grams = np.unique(np.concatenate([grams, *(gram_hashes(d, n) for d in data for n in GRAMS)]))
    bits = min(MAX_SEEN_BITS, max(16, int(np.ceil(np.log2(max(len(grams), 1) * SPARE)))))
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    at = grams >> np.uint32(32 - bits)
    np.bitwise_or.at(bitmap, at >> np.uint32(3), np.uint8(1) << (at & np.uint32(7)).astype(np.uint8))
    return bits, bitmap


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (classes, BUCKETS): embeddings times softmax weights
    bias: np.ndarray
    seen_bits: int
    seen: np.ndarray  # bitmap: 1 where training had a feature
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: float = 0.0

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """((texts, classes), share of features seen); each text's n-grams are summed apart from its neighbours'."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs) + 1))
        total = np.zeros(len(texts))
        for n in GRAMS:
            stops = ends - n + 1
            rows = np.flatnonzero(stops > starts)
            if not len(rows):
                continue
            g = gram_hashes(data, n)
            h, at = g >> np.uint32(32 - 15), g >> np.uint32(32 - self.seen_bits)
            known = (self.seen[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & np.uint8(1)).astype(np.float64)
            cuts = np.stack([starts[rows], np.minimum(stops[rows], len(h))], axis=1).ravel()
            cuts = cuts[:-1] if cuts[-1] == len(h) else cuts
            total[rows] += stops[rows] - starts[rows]
            for c, w in enumerate(self.weights):
                out[rows, c] += np.add.reduceat(w[h], cuts)[::2]
            out[rows, -1] += np.add.reduceat(known, cuts)[::2]
        out /= np.maximum(total, 1)[:, None]
        return out[:, :-1] + self.bias, out[:, -1]

    def tell(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, its probability, rejected) of each text."""
        z, seen = self.logits(texts)
        p = softmax(z / self.temperature)
        return p.argmax(axis=1), p.max(axis=1), (p.max(axis=1) < self.threshold) | (seen < self.familiar)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    bags = []
    for t in texts:
        data = np.frombuffer(t, dtype=np.uint8).astype(np.uint32)
        h, n = np.unique(np.concatenate([buckets(data, g) for g in GRAMS]), return_counts=True)
        bags.append((h, (n / max(n.sum(), 1)).astype(np.float32)))
    return bags


def fit(examples: list[tuple[bytes, int]], langs: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent on (text, class) lines; order and start are fixed by ``seed``."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    bags, y = _bags([t for t, _ in examples]), np.array([c for _, c in examples])
    # every language weighs alike, however many of its lines there are
    weight = (len(y) / len(langs) / np.maximum(np.bincount(y, minlength=len(langs)), 1))[y].astype(np.float32)
    steps = EPOCHS * -(-len(y) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            rows = order[lo:lo + BATCH]
            idx = np.concatenate([bags[r][0] for r in rows])
            w = np.concatenate([bags[r][1] for r in rows])
            cuts = np.cumsum([0, *[len(bags[r][0]) for r in rows[:-1]]])
            mean = np.add.reduceat(emb[idx] * w[:, None], cuts)
            g = softmax(mean @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= weight[rows][:, None]
            rate = RATE * (1 - step / steps)
            step += 1
            back = np.repeat(g @ out.T, np.diff([*cuts, len(idx)]), axis=0) * w[:, None]
            order_idx = np.argsort(idx, kind="stable")
            uniq, first = np.unique(idx[order_idx], return_index=True)
            emb[uniq] -= rate * np.add.reduceat(back[order_idx], first)
            out -= rate / len(rows) * (mean.T @ g)
            bias -= rate / len(rows) * g.sum(axis=0)
    return Model(langs, np.ascontiguousarray((emb @ out).T), bias.astype(np.float64), *seen_bitmap([t for t, _ in examples]))


def calibrate(model: Model, examples: list[tuple[bytes, int]]) -> Model:
    """Temperature of least cross-entropy, then the rejection thresholds."""
    if not examples:
        return model
    (z, seen), y = model.logits([t for t, _ in examples]), np.array([c for _, c in examples])

    def loss(t: float) -> float:
        return -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()

    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == y
    if right.any():
        model.threshold = float(np.quantile(p.max(axis=1)[right], REJECT_SHARE))
        model.familiar = float(np.quantile(seen[right], REJECT_SHARE))
    return model


def sample(rows: DataFrame, counts: dict[str, int], docs_per_lang: int, id_col: str, lang_col: str) -> DataFrame:
    """At most ``docs_per_lang`` of ``rows`` for each language; rows of equal or null ids are drawn one by one."""
    kept = rows.columns
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.col(id_col), F.lit("train")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k in counts for x in (k, int((1 << 30) * min(1.0, 2 * docs_per_lang / counts[k])))])
    few = rows.withColumn("_lot", lot).where(F.col("_lot") < share[F.col(lang_col)])
    few = few.withColumn("_rank", F.row_number().over(Window.partitionBy(lang_col).orderBy("_lot")))
    return few.where(F.col("_rank") <= docs_per_lang).select(*[F.col(f"`{c}`") for c in kept])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_lang: int = DOCS_PER_LANG) -> Model | None:
    """``labelled``: the rows to learn from. A hash of row number and id picks at most ``docs_per_lang`` of each language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(id_col, text_col, lang_col)
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    picked = sample(rows, counts, docs_per_lang, id_col, lang_col).select(
        F.col(text_col).alias("t"), F.col(lang_col).alias("l"), (F.pmod(F.xxhash64(F.col(id_col), F.lit("valid")), F.lit(5)) == 0).alias("v"))
    fits, valid = [], []
    for r in sorted(picked.collect(), key=lambda r: (r.l, r.t)):
        for line in r.t.split("\n"):
            t = normalised(line)
            if len(t) > 2:
                (valid if r.v else fits).append((t, langs.index(r.l)))
    return calibrate(fit(fits or valid, langs), valid or fits)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (their own columns of these names are replaced)."""
    row_batches(docs.sparkSession)
    has_letter: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*names, has_letter.alias("_letter"), F.col(text_col).alias("_text"))
    kept = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, no = [UNKNOWN] * len(b), np.zeros(len(b)), np.ones(len(b), bool)
            at = [i for i, ok in enumerate(b.column(len(names)).to_pylist()) if ok and model]
            if at:
                texts = b.column(len(names) + 1).take(pa.array(at)).to_pylist()
                for i, c, s, r in zip(at, *model.tell([normalised(t) for t in texts])):
                    lang[i], score[i], no[i] = model.langs[c], min(float(s), 1.0), r
            cols = [*b.columns[:len(names)], pa.array(lang, pa.string()), pa.array(score), pa.array(no)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score", "rejected"])

    out = kept.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, out)
