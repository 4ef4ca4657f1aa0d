import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute_components(fps, reach=3):
    """id -> smallest id reachable, over all pairs."""
    ids = list(range(len(fps)))
    x = np.array([f for _, f in fps], dtype=np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= reach):
            a, b = i, int(j)
            while ids[a] != a:
                a = ids[a]
            while ids[b] != b:
                b = ids[b]
            ids[max(a, b)] = min(a, b)
    roots = []
    for i in range(len(x)):
        while ids[i] != i:
            i = ids[i]
        roots.append(i)
    least = {}
    for (d, _), r in zip(fps, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return {(d, f): least.get(r) for (d, f), r in zip(fps, roots)}


def unsigned(v):
    return v & (2**64 - 1)


def test_fingerprints_and_components_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.near_duplicates(docs, 3, 3).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    fps = [(d, brute_fingerprint(t)) for d, t in texts.items()]
    want = brute_components(fps)
    assert {(r.doc_id, unsigned(r.fp)): r.component_id for r in got} == want
    assert len({c for c in want.values()}) < len(texts)


def test_edge_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (9, " \t\n", 3), (7, "one Two", 4), (8, "ONE two", 4), (2, "solo", 5), (2, "solo", 5),
            (None, "solo", 6), (11, "w " * 70000, 7), (12, "ÀÉ x y z", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")  # an extra column of a clashing name
    got = [(r.doc_id, unsigned(r.fp), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    by = {(d, f): c for d, f, c in got}
    assert by[(5, 0)] == by[(3, 0)] == by[(9, 0)] == 3
    f = brute_fingerprint("one two")
    assert by[(7, f)] == by[(8, f)] == 7
    assert by[(None, brute_fingerprint("solo"))] == 2
    assert (11, brute_fingerprint("w " * 70000)) in by
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n_shards", [1, 7, 24])
def test_shards_lose_no_link(n_shards):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    near = np.concatenate([base, base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)),
                           np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))])
    pts = np.unique(near)
    tree = simhash.shard_tree(pts[::2], n_shards, 3)
    linked, homes = set(), 0
    where = {int(p): i for i, p in enumerate(pts)}
    for _, p, home in simhash.deal(tree, pts, np.ones(len(pts), bool), 3):
        homes += int(home.sum())
        root = simhash.link_shard(p, home, 3)
        linked |= {(where[int(a)], where[int(p[r])]) for a, r in zip(p, root)}
    assert homes == len(pts)
    g = simhash.Groups(len(pts))
    a, b = np.array(sorted(linked)).T
    g.link(a, b)
    w = simhash.Groups(len(pts))
    i, j = np.nonzero(np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 3)
    w.link(i, j)
    every = np.arange(len(pts))
    assert (g.roots(every) == w.roots(every)).all()
    assert len(np.unique(w.roots(every))) < len(pts)


def test_visitors_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_NODES", 40)
    monkeypatch.setattr(simhash, "VISITORS", 30)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    rows = [(i, f) for i, f in enumerate(np.concatenate([base, near, base[:50]]).view(np.int64).tolist())]
    fps = spark.createDataFrame(rows, "id long, fp long")
    nodes = np.unique(np.array([f for _, f in rows], dtype=np.int64).view(np.uint64))
    parts = simhash.visitor_parts(simhash.shard_tree(nodes, 20, 3), nodes, len(nodes), 3)
    assert len(parts) > 10 and max(parts.values()) > 5
    got = simhash.components(fps, 3).collect()
    assert {(r.id, unsigned(r.fp)): r.component_id for r in got} == brute_components([(i, unsigned(f)) for i, f in rows])


def test_dense_group_is_cut_small():
    """Near copies of one text: members spread over leaves though all lie close together."""
    rng = np.random.default_rng(2)
    pts = np.uint64(0)
    for _ in range(3):
        pts = pts ^ (np.uint64(1) << rng.integers(0, 64, 20000, dtype=np.uint64))
    pts = np.unique(pts)
    root = simhash.link_shard(pts, np.ones(len(pts), bool), 3)
    assert (root == 0).all()
