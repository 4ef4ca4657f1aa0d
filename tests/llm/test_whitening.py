import numpy as np
import pytest

from ledgerline.llm import whitening
from ledgerline.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string"


def plain(vectors, components=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    away = n * x - s
    centred = away / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return (away.astype(object) ** 2).sum(1), centred @ axes[:, :components] / np.sqrt(values[:components]), values / values.sum()


def test_query_matches_numpy(spark):
    sf = "/root/testdata/sf0.01"
    table = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    deviation, white, explained = plain([v for _, v in table])
    rows = op13_whitening(spark, sf).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"]) for r in rows] == [(i, c) for i, _ in table for c in range(1, 33)]
    got = np.array([r["whitened"] for r in rows]).reshape(-1, 32)
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-9
    assert [r["deviation"] for r in rows[::32]] == list(deviation)
    assert np.allclose([r["explained"] for r in rows[:32]], explained[:32], rtol=1e-9)
    assert {r["n"] for r in rows} == {len(table)}
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_blocks_and_splits_add_up(spark, monkeypatch):
    for name, value in (("ROWS", 16), ("COLS", 8), ("SPLIT_BLOCKS", 2)):
        monkeypatch.setattr(whitening, name, value)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    out = sorted(whitening.whiten(rows, components=6).collect(), key=lambda r: r["vec_id"])
    _, white, _ = plain(vectors, 6)
    got = np.array([r["whitened"] for r in out])
    assert got.shape == (300, 6) and np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), float(i % 5), 1.0], "x") for i in range(40)]
    bad = [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [nan, 1.0, 2.0], "x"), (103, [inf, 1.0, 2.0], "x"), (104, [], "x"),
           (105, [1.0, 2.0], "x"), (None, [0.0, 0.0, 1.0], None), (0, [0.0, 0.0, 1.0], "x")]
    out = whitening.whiten(spark.createDataFrame(rows + bad, SCHEMA)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out) == sorted([(False, i) for i in range(40)] + [(False, 0), (True, 0)])
    assert {r["n"] for r in out} == {42} and {len(r["whitened"]) for r in out} == {2}  # the third entry never varies
    assert len({tuple(r["whitened"]) for r in out if not r["vec_id"]}) == 1  # rows alike are whitened alike
    assert all(r["identity_error"] < 1e-9 for r in out)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], "x")], [(1, [1.0, 2.0], "x")] * 3, [(1, None, None)]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
