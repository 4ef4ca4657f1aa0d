import math
import random

from pyspark.sql import functions as F

from ledgerline.llm import knn


def brute(rows, is_query, k, scale=256):
    v = [(i, [math.floor(scale * x) for x in e]) for i, e in rows
         if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for q in sorted({i for i, _ in v if is_query(i)}):
        x = min((e for i, e in v if i == q))
        best = sorted((-sum(a * b for a, b in zip(x, e)), i) for i, e in v if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def run(spark, rows, every, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(df, F.col("vec_id") % every == 0, k=k, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 100)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    rnd = random.Random(1)
    centre = [[rnd.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(c) + rnd.gauss(0, 0.1) for c in centre[i % 5]]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 6) for i in range(400)]  # a hot vector, with ties
    import struct
    rows = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in e]) for i, e in rows]
    assert run(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0, 5)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [-1.0]), (7, [1.0, 2.0, 3.0]),
            (None, [9.0, 9.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (10, [0.5, 0.5])]
    got = run(spark, rows, 5)
    want = set()
    flat = [r for r in rows if r[0] not in (None, 1, 2, 3, 4)]
    for q in (0, 5, 10):
        x = dict(flat)[q]
        best = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(x, e)), i) for i, e in flat if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert run(spark, rows[:1], 5) == set()
    assert run(spark, [], 5) == set()


def test_copies_of_queries_are_bounded_and_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 20)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    monkeypatch.setattr(knn, "PARTS", 3)  # many shards in a part, regions across two parts
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randrange(-9, 10)) for _ in range(8)]) for i in range(600)] + [(1000 + i, [2.0] * 8) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = knn.top_k(df, F.col("vec_id") % 3 == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 3 == 0, 5)
