"""Operator 10: benchmark decontamination by spaced seeds.

Fixed masks over consecutive words ignore some positions, so that a seed hash survives a
substituted word there. The seeds of all benchmark items are joined with the seeds of all
documents; the hits of a pair name diagonals (document position minus item position), along which
the words are compared one by one: the pair counts if some ``WINDOW`` aligned words agree in
at least ``AGREE`` of them. Of an item shorter than ``WINDOW`` (``SHORTEST`` words at least) all words
must agree.

A Bloom filter of the benchmark's seeds, at most ``2^MAX_BLOOM_BITS`` bits whatever the
benchmark's size, goes to all tasks; a larger benchmark makes it denser, never wrong. Only
seeds that pass it, and the words around them, leave the documents' scan. The join on seeds
is salted, as one passage may lie in a third of all documents.

Words: case-folded, ASCII punctuation taken as white space.

Defined results: null or empty texts and items take no part, nor do items of fewer words than
``SHORTEST`` (too short to be evidence; ``not_checkable`` names them); rows that repeat an id are one document; a null doc_id
is reported as null; empty tables give no rows. A region and an item meet once, however often their seeds
repeat: memory is linear in both, the comparisons at worst in their product.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_batches, row_key, whole_row

# fixed masks: 1 takes the word, 0 ignores it; all, every fifth, every fourth, every third word ignored, and two
# for substitutions close together: of the 78 pairs of substituted words in a window none is without a seed
MASKS = ("1111111", "11110111", "111011101", "1101101101", "1111001111", "11110101111")
WINDOW = 13
AGREE = 0.8
SHORTEST = len(MASKS[0])  # words of the shortest item that has a seed: the first mask takes every word
MIN_BLOOM_BITS, MAX_BLOOM_BITS, PROBES = 16, 26, 3
SALTS = 8
HITS_PER_DIAGONAL = 16
_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_MULTIPLIERS = np.random.default_rng(42).integers(1, 2**63, (len(MASKS), 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    words = text.casefold().encode("utf-8").translate(_PUNCTUATION).split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def seeds(words: np.ndarray) -> Iterator[np.ndarray]:
    """Of each mask, the seed hash at every position."""
    for mask, mult in zip(MASKS, _MULTIPLIERS):
        n = len(words) - len(mask) + 1
        h = np.zeros(max(n, 0), dtype=np.uint64)
        if n > 0:
            for k, p in enumerate(i for i, c in enumerate(mask) if c == "1"):
                h += words[p:p + n] * mult[k]
        yield h


def sorted_seeds(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of an item's seeds by hash; of a short item only the first mask's, which fits where no word is changed."""
    s = list(seeds(item))[:len(MASKS) if len(item) >= WINDOW else 1]
    at, h = np.concatenate([np.arange(len(x)) for x in s]), np.concatenate(s)
    order = np.argsort(h, kind="stable")
    return at[order], h[order]


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    out = []
    for _ in range(PROBES):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return out


def index_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item_words, seed hashes) of the items that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = word_hashes(text)
                if len(w) >= SHORTEST:
                    out.append((i, w.view(np.int64), sorted_seeds(w)[1].view(np.int64)))
            cols = [pa.array(c) for c in zip(*out)] if out else [[]] * 3
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["item_id", "item_words", "seed"])

    row_batches(items.sparkSession)
    return items.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "item_id long, item_words array<long>, seed array<long>")


def not_checkable(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n_words) of the items that are too short to be looked for, null and empty ones included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(word_hashes(text)) for text in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["item_id", "n_words"])
            yield out.filter(pa.array([k < SHORTEST for k in n], pa.bool_()))

    row_batches(items.sparkSession)
    return items.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "item_id long, n_words long")


def bloom(item_seeds: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap bytes): made by Spark, one row for each 64 bits that has any."""
    n = item_seeds.count()
    bits = min(MAX_BLOOM_BITS, max(MIN_BLOOM_BITS, math.ceil(math.log2(max(n, 1) * 256))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(probes(b.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["w", "m"])

    words = item_seeds.select("seed").mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    bitmap[words["w"].to_numpy()] = words["m"].to_numpy()
    return bits, bitmap.view(np.uint8)


def regions(docs: DataFrame, bits: int, bitmap: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body, region, start, words, at, seed): the stretches of documents around seeds that may hit."""
    wing = WINDOW + max(map(len, MASKS))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def of(text: str | None) -> Iterator[tuple]:
        w = word_hashes(text)
        found = []
        for h in seeds(w):
            hit = np.ones(len(h), bool)
            for at in probes(h, bits):
                hit[hit] = (shared.value[at[hit] >> 3] >> (at[hit] & 7).astype(np.uint8)) & 1
            at = np.flatnonzero(hit)
            found.append((at, h[at]))
        at, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
        new = np.flatnonzero(np.diff(at) > 2 * wing) + 1
        for a, s in zip(np.split(at, new), np.split(h, new)):
            lo, hi = max(0, a[0] - wing), min(len(w), a[-1] + wing)
            yield int(lo), w[lo:hi].view(np.int64), a - lo, s.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            out = [(i, body, int.from_bytes(os.urandom(8), "little", signed=True), *r)
                   for i, body, t in zip(*(b.column(k).to_pylist() for k in range(3))) for r in of(t)]
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "body", "region", "start", "words", "at", "seed"])

    row_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col)).mapInArrow(
        run, "doc_id long, body long, region long, start long, words array<long>, at array<long>, seed array<long>")


def overlap(words: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first, end, agreeing words) in the item of the stretch that its good windows cover."""
    lo, hi = max(0, -diagonal), min(len(item), len(words) - diagonal)
    window = min(WINDOW, len(item))
    need = math.ceil(AGREE * WINDOW) if window == WINDOW else window
    if hi - lo < window:
        return None
    same = words[lo + diagonal:hi + diagonal] == item[lo:hi]
    run = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(run[window:] - run[:-window] >= need)
    if not len(good):
        return None
    first, end = int(good[0]), int(good[-1]) + window
    return lo + first, lo + end, int(run[end] - run[first])


def diagonals(at: np.ndarray, h: np.ndarray, item_at: np.ndarray, item_h: np.ndarray, n_words: int, n_item: int) -> np.ndarray:
    """The distinct diagonals of a region's and an item's equal seeds.

    Where both repeat themselves so much that these are far more hits than diagonals, every diagonal: no
    overlap lies on one without a seed, so those beyond are looked at in vain, never reported.
    """
    first = np.searchsorted(item_h, h, side="left")
    times = np.searchsorted(item_h, h, side="right") - first
    hits = int(times.sum())
    if hits > HITS_PER_DIAGONAL * (n_words + n_item):
        return np.arange(-n_item + 1, n_words)
    nth = np.arange(hits) - np.repeat(np.cumsum(times) - times, times)
    return np.unique(np.repeat(at, times) - item_at[np.repeat(first, times) + nth])


def best_overlap(words: np.ndarray, item: np.ndarray, found: np.ndarray) -> tuple[int, int, int, int] | None:
    """(agreeing words, aligned words, start in words, start in item) on the best diagonal: most of the first two, then the earliest.

    Diagonals that could hold more come first; the search ends at the first one that cannot improve on the best.
    """
    lo = np.maximum(0, -found)
    room = np.minimum(len(item), len(words) - found) - lo
    order = np.lexsort((lo, lo + found, -room))
    best = None
    for g, least, most in zip(found[order].tolist(), lo[order].tolist(), room[order].tolist()):
        if best and (most, most, -(least + g), -least) <= best:
            break
        got = overlap(words, item, g)
        if got:
            first, end, same = got
            here = (same, end - first, -(first + g), -first)
            best = max(best, here) if best else here
    return (best[0], best[1], -best[2], -best[3]) if best else None


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, body, item_id, n_same, n_aligned, doc_start, item_start): a row for each document and item that overlap.

    Positions count words; ``body`` is the text's XXH64. The best diagonal of a pair is kept.
    """
    index = materialize(index_items(items, item_col, item_text_col), "bench-index")
    item_seeds = index.select("item_id", F.explode(F.array_distinct("seed")).alias("seed"))
    bits, bitmap = bloom(item_seeds)
    found = materialize(regions(docs, bits, bitmap, id_col, text_col), "bench-regions")
    theirs = found.select("region", F.explode(F.array_distinct("seed")).alias("seed")).withColumn("salt", F.pmod(F.xxhash64("region"), F.lit(SALTS)))
    ours = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = theirs.join(ours.withColumn("salt", F.col("salt").cast("long")), ["seed", "salt"])
    pairs = hits.select("region", "item_id").distinct()
    pairs = pairs.join(found.select("region", "doc_id", "body", "start", "words", "at", "seed"), "region").join(
        index.select(F.col("item_id").alias("i"), "item_words"), F.col("item_id").eqNullSafe(F.col("i")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # an item and its seeds: pairs of one item adjoin
        for b in batches:
            out = []
            for d, body, i, s, w, at, h, iw in zip(*(b.column(k).to_pylist() if k < 4 else b.column(k) for k in range(8))):
                w, at, h, iw = (x.values.to_numpy() for x in (w, at, h, iw))
                if last[0] is None or not np.array_equal(last[0], iw):
                    last = (iw, sorted_seeds(iw.view(np.uint64)))
                got = best_overlap(w, iw, diagonals(at, h.view(np.uint64), *last[1], len(w), len(iw)))
                if got:
                    same, aligned, doc_start, item_start = got
                    out.append((d, body, i, same, aligned, s + doc_start, item_start))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    names = ["doc_id", "body", "item_id", "n_same", "n_aligned", "doc_start", "item_start"]
    kept = pairs.select("doc_id", "body", "item_id", "start", "words", "at", "seed", "item_words").mapInArrow(
        verify, ", ".join(f"{n} long" for n in names))
    best = F.max(F.struct("n_same", "n_aligned", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i")))
    kept = kept.groupBy("doc_id", "body", "item_id").agg(best.alias("b"))
    return kept.select("doc_id", "body", "item_id", "b.n_same", "b.n_aligned", (-F.col("b.d")).alias("doc_start"),
                       (-F.col("b.i")).alias("item_start"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap any item."""
    gone = contaminated(docs, items, id_col, text_col).select(row_key(F.col("doc_id"), F.col("body"))).distinct()
    rows = docs.select(row_key(F.col(id_col).cast("long"), F.xxhash64(text_col)), whole_row(docs))
    return rows.join(gone, "_key", "left_anti").select("_doc.*")
