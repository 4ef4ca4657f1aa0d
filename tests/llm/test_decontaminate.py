import random
from itertools import combinations

import numpy as np

from ledgerline.llm import decontaminate as dc


def brute(docs, items):
    """(doc, item) pairs with a good window on any diagonal that has enough equal words for one."""
    out = set()
    words = {i: dc.word_hashes(t) for i, t in items}
    for d, t in docs:
        w = dc.word_hashes(t)
        for i, iw in words.items():
            at, item_at = np.nonzero(w[:, None] == iw[None, :])
            diagonals, n = np.unique(at - item_at, return_counts=True)
            if any(dc.overlap(w, iw, int(g)) for g in diagonals[n >= dc.WINDOW * dc.AGREE]):
                out.add((d, i))
    return out


def test_equals_all_diagonals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and got


def test_substituted_words_are_tolerated(spark):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").limit(20).collect()
    rnd = random.Random(1)
    rows = []
    for k, r in enumerate(items):
        w = r.text.split()
        for p in range(3, len(w), 7):
            w[p] = f"other{p}"
        noise = [f"n{rnd.random()}" for _ in range(50)]
        rows.append((k, " ".join(noise + [x.upper() + "," for x in w] + noise)))
        rows.append((1000 + k, " ".join(noise + r.text.split()[:8] + noise)))  # eight words aren't evidence
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    assert {(k, r.item_id) for k, r in enumerate(items)} <= got
    assert all(d < 1000 for d, _ in got)


def test_every_pair_of_substitutions_in_a_window_is_found(spark):
    words = [f"w{i}" for i in range(dc.WINDOW)]
    rows = []
    for k, pair in enumerate(combinations(range(dc.WINDOW), 2)):
        noise = [f"n{k}x{i}" for i in range(20)]
        rows.append((k, " ".join(noise + [f"other{p}" if p in pair else w for p, w in enumerate(words)] + noise)))
    # two substitutions more outside the good window
    rows.append((1000, " ".join(["a", *[f"other{p}" if p in (5, 7) else w for p, w in enumerate(words)], "b", "b"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *words, "y", "z"]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()}
    assert got == {(d, i) for d, _ in rows for i in (1, 2)}


def test_short_items_count_if_all_their_words_agree(spark):
    noise = " ".join(f"n{i}" for i in range(30))
    rows, items = [], [(100, "one two three four five six"), (101, None), (102, "")]
    for n in range(7, 13):
        w = [f"s{n}x{i}" for i in range(n)]
        items.append((n, " ".join(w)))
        rows += [(n, f"{noise} {' '.join(w)} {noise}"), (1000 + n, f"{noise} {' '.join(w[:-1])} other {noise}"), (2000 + n, " ".join(w))]
    rows.append((100, f"{noise} one two three four five six {noise}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_same, r.n_aligned, r.doc_start) for r in dc.contaminated(docs, bench).collect())
    assert got == sorted([(n + d, n, n, n, 0 if d else 30) for n in range(7, 13) for d in (0, 2000)])
    assert sorted((r.item_id, r.n_words) for r in dc.not_checkable(bench).collect()) == [(100, 6), (101, 0), (102, 0)]


def test_edge_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, passage, 1), (3, passage, 1), (None, "x " + passage, 2),
                                  (4, "a b c", 3), (5, "q " * 90000 + passage, 4)], "doc_id long, text string, seed long")
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "a b c"), (None, passage)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_same, r.doc_start) for r in dc.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(d, i, 30, s) for d, s in ((3, 0), (None, 1), (5, 90000)) for i in (1, None)], key=str)
    assert dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.contaminated(docs, items.limit(0)).count() == 0


def test_texts_that_repeat_themselves(spark):
    """Hits grow with the product of the repeats, rows between the steps don't; the best diagonal is that of a search over all."""
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choices("aab", k=n))
    docs = [(i, text(rnd.randint(0, 300))) for i in range(30)] + [(100, "a b " * 60000), (101, "noise " + "a " * 40000)]
    items = [(i, text(rnd.randint(7, 80))) for i in range(10)] + [(50, "a b " * 60000), (51, "b a " * 3000), (52, "a " * 40000)]
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): (r.n_same, r.n_aligned, r.doc_start, r.item_start) for r in found.collect()}
    want = {}
    for d, t in docs[:30]:
        w = dc.word_hashes(t).view(np.int64)
        for i, it in items[:10]:
            iw = dc.word_hashes(it).view(np.int64)
            got = [(g, dc.overlap(w, iw, g)) for g in range(-len(iw) + 1, len(w))]
            best = max(((s, e - f, -(f + g), -f) for g, o in got if o for f, e, s in [o]), default=None)
            if best:
                want[d, i] = (best[0], best[1], -best[2], -best[3])
    assert want and {k: v for k, v in rows.items() if k[0] < 100 and k[1] < 50} == want
    assert rows[100, 50] == (120000, 120000, 0, 0) and rows[100, 51] == (6000, 6000, 1, 0) and rows[101, 52] == (40000, 40000, 1, 0)
