import random

import numpy as np

from ledgerline.llm import periodic_runs as pr
from ledgerline.llm.queries import op12_periodic_runs, planted_runs


def brute_force(x):
    """Every run, from the definition: equal words q apart, as long as they go on, for each q."""
    x, found = np.unique(np.array(x), return_inverse=True)[1] if len(x) else np.zeros(0, int), []
    for q in range(1, len(x) // pr.MIN_EXPONENT + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        for i, j in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            length = j - i + q
            if length >= max(pr.MIN_LENGTH, pr.MIN_EXPONENT * q):
                run = x[i:i + length]
                if not any(q % d == 0 and (run[d:] == run[:-d]).all() for d in range(1, q)):
                    found.append((i, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(count, longest, seed):
    rnd = random.Random(seed)
    for _ in range(count):
        n, k = rnd.randint(0, longest), rnd.choice([1, 2, 3, 6, 20])
        x = [rnd.randint(1, k) for _ in range(n)]
        if n > 10 and rnd.random() < 0.6:
            a = rnd.randrange(n)
            q = 1 + (n - a) // rnd.randint(3, 10)
            x = [x[i if i < a else a + (i - a) % q] for i in range(n)]
        yield x


def test_runs_match_brute_force():
    some = 0
    for x in sequences(1500, 70, 1):
        want = brute_force(x)
        some += len(want)
        assert pr.runs_of(x) == want
    assert some > 500


def test_stretches_hold_every_run():
    texts = [[str(s).encode() for s in x] for x in sequences(400, 300, 2)]
    assert pr.runs_of_texts(texts) == [brute_force(t) for t in texts]


def test_suffix_tree_tells_common_prefixes_and_ranks():
    for x in sequences(100, 40, 3):
        if not x:
            continue
        tree, ended = pr.SuffixTree(x), [*x, 0]
        suffixes = [ended[i:] for i in range(len(ended))]
        assert np.argsort(tree.ranks(False)).tolist() == sorted(range(len(ended)), key=lambda i: suffixes[i])
        assert np.argsort(tree.ranks(True)).tolist() == sorted(range(len(ended)), key=lambda i: [-s for s in suffixes[i][:-1]] + [-99])
        i, j = np.array([(a, b) for a in range(len(ended)) for b in range(len(ended)) if a != b]).T
        want = [next(k for k in range(len(ended)) if suffixes[a][k] != suffixes[b][k]) for a, b in zip(i, j)]
        assert tree.common(i, j).tolist() == want


def test_a_very_long_periodic_text():
    words = [b"w%d" % i for i in range(3000)] * 40
    assert pr.runs_of_texts([[b"start", *words, b"end"]]) == [[(1, 120_000, 3000)]]


def test_nulls_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, " a b\n a b a\tb a b c ", 7), (2, " a b\n a b a\tb a b c ", 7)],
                                 "doc_id long, text string, runs int")
    rows = sorted((r.asDict(recursive=True) for r in pr.periodic_runs(docs).collect()), key=lambda r: (r["doc_id"] or 0, r["collapsed"]))
    run = {"start": 0, "length": 8, "period": 2}
    empty = {"n_runs": 0, "top": None, "runs": [], "collapsed": ""}
    assert rows == [{"doc_id": None, **empty}, {"doc_id": 1, **empty}] + [{"doc_id": 2, "n_runs": 1, "top": run, "runs": [run], "collapsed": "a b c"}] * 2
    assert pr.periodic_runs(docs.limit(0)).collect() == []


def test_query_matches_brute_force_over_a_whole_table(spark):
    import hashlib
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    planted = {r["doc_id"]: r["text"] for r in planted_runs(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in ((r["doc_id"], r["text"]) for r in docs):
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        assert (planted[doc_id] or "").encode().split() == words
        runs, r = brute_force(words), got[doc_id]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        if runs:
            s, k, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, k, q, 1000 * k // q)
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
