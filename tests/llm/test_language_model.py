import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language_model as lm
from ledgerline.llm import queries


def base_scores(rows):
    """doc -> (held out, tokens, known, N, score) by the formula."""
    toks = {d: (t or "").encode().lower().split() + [b""] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in toks}
    c = Counter(x for d, w in toks.items() if not held[d] for x in w)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(w), sum(c[x] > 0 for x in w), n,
                sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in w)) for d, w in toks.items()}


@pytest.mark.parametrize("local", [lm.LOCAL, 700])
def test_base_and_model(spark, local):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r.doc_id: r for r in lm.score(docs, train, local=local).collect()}
    want = base_scores([(r.doc_id, r.text) for r in docs.collect()])
    assert got.keys() == want.keys()
    for d, (held, n, known, total, base) in want.items():
        r = got[d]
        assert (not r.trained, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    held = [r for r in got.values() if not r.trained]
    better = sum(r.score > r.base_score for r in held)
    assert better > 0.9 * len(held), (better, len(held))


def test_probabilities_sum_to_one():
    """Over a small vocabulary, all words and one unseen word for each tail class."""
    rng = np.random.default_rng(0)
    words = sorted({bytes(rng.integers(97, 110, 4).astype(np.uint8)) for _ in range(900)}) + [b""]
    counts = np.sort(rng.integers(1, 500, len(words)))[::-1]
    mass = np.full(lm.TAIL, 0.5)
    for w, c in zip(words[lm.HEAD:], counts[lm.HEAD:]):
        mass[lm.tail_class(w) - lm.HEAD] += c + 0.5
    v = lm.Vocabulary(words, counts, int(counts.sum()), len(words), mass).open()
    m = lm.LogBilinear.start(v.class_shares())
    k = rng.integers(0, lm.HEAD + lm.TAIL, 20000).astype(np.int32)
    m.learn(k, np.roll(k, 1), np.roll(k, 2), rng)
    for c1, c2 in ((0, 1), (3, 530)):
        cls = v.classes
        logp = m.log10(cls, np.full(len(cls), c1, np.int32), np.full(len(cls), c2, np.int32))
        within = np.where(cls < lm.HEAD, 1.0, (counts + 0.5) / np.concatenate([np.ones(lm.HEAD), mass])[cls])
        tail = np.arange(lm.HEAD, lm.HEAD + lm.TAIL, dtype=np.int32)
        unseen = 10 ** m.log10(tail, np.full(len(tail), c1, np.int32), np.full(len(tail), c2, np.int32)) * 0.5 / mass
        assert abs((10 ** logp * within).sum() + unseen.sum() - 1) < 1e-4


def test_edge_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "the AND", 1.0), (4, "the and the", 1.0), (4, "the and the", 1.0), (5, "zq " * 200000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm.score(docs, F.lit(True)).collect()
    assert len(got) == len(rows) and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 4, 4, 200001]
    got = lm.score(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in got)
    assert abs(got[0].base_score - got[0].n_tokens * math.log10(0.5 / 0.5)) < 1e-9
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    assert queries.op7_language_model(spark, "/root/testdata/sf0.001").count() == 200


def test_warm_sample_is_bounded_and_mixed(spark, monkeypatch):
    monkeypatch.setattr(lm, "WARM_DOCS", 300)
    text = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("copy")).otherwise(F.concat(F.lit("own "), F.col("id")))
    rows = [r.t for r in lm.warm_sample(spark.range(9000).select(text.cast("string").alias("t")), 9000).collect()]
    assert len(rows) == 300
    assert all(50 < n < 150 for n in (rows.count(None), rows.count("copy"), sum("own" in (t or "") for t in rows)))
    few = spark.range(7).select(F.lit("x").alias("t"))
    assert lm.warm_sample(few, 7).count() == 7
