from pyspark.sql import functions as F

from ledgerline.operators import dataset as D
from ledgerline.operators import evaluate as E


def test_edit_distance_both_empty(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abd")], "p string, a string")
    got = [r[0] for r in df.select(E.normed_edit_distance(F.col("p"), F.col("a"))).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1 / 3) < 1e-12


def test_epoch_stats_are_means_of_batch_means(spark):
    rows = [(0, 0, 1.0), (0, 0, 1.0), (0, 1, 0.0)]
    df = spark.createDataFrame(rows, "epoch int, batch int, score double")
    st = E.epoch_stats(df).first()
    assert st["mean_score"] == 0.5 and st["min_score"] == 0.0 and st["max_score"] == 1.0


def test_early_stop(spark):
    vals = [5.0, 4.0, 4.5, 4.2, 4.1, 3.0]
    df = spark.createDataFrame(list(enumerate(vals)), "epoch int, v double")
    es = {r["epoch"]: r for r in E.early_stop(df, "v", 3).collect()}
    assert es[4]["since_best"] == 3 and es[4]["stop"] and not es[5]["stop"]


def test_patience_counts_checks(spark):
    vals = [(1, 5.0), (3, 4.0), (5, 4.5), (7, 4.6), (9, 4.7)]
    df = spark.createDataFrame(vals, "epoch int, v double")
    es = {r["epoch"]: r for r in E.early_stop(df, "v", 3).collect()}
    assert [e for e, r in es.items() if r["stop"]] == [9] and es[7]["since_best"] == 2


def test_accuracy_in_the_row(spark):
    from pyspark.sql import types as T
    sch = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    rows = [("k1", ("1", "2"), ("1", None)), ("k2", (None, None), (None, None)), ("k3", (None, None), ("x", None))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("key", T.StringType()), T.StructField("t", sch), T.StructField("p", sch)]))
    acc = E.row_accuracy(df, "t", "p", sch)
    assert {r["key"]: r["accuracy"] for r in acc.collect()} == {"k1": 0.5, "k2": 1.0, "k3": 0.0}
    assert "Exchange" not in acc._jdf.queryExecution().executedPlan().toString()


def test_row_at(spark):
    df = spark.range(0, 1000, numPartitions=5).withColumn("k", F.xxhash64("id"))
    want = sorted((r["k"], r["id"]) for r in df.collect())
    for at in (0, 7, 999):
        r = D.row_at(df, [F.col("k")], at).collect()
        assert [(x["k"], x["id"], x["row_idx"]) for x in r] == [(*want[at], at)]
    assert D.row_at(df, [F.col("k")], 1000).count() == 0


def test_sample_every_small_dataset(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "i int")
    assert E.sample_every(df, [F.col("i")], 0.2).count() == 3


def test_global_index_matches_brute_force(spark):
    df = spark.range(0, 5000, numPartitions=7).withColumn("k", F.xxhash64("id"))
    idx = D.global_index(df, [F.col("k")]).select("k", "row_idx").collect()
    got = sorted((r["row_idx"], r["k"]) for r in idx)
    want = sorted(r["k"] for r in df.collect())
    assert [k for _, k in got] == want and [i for i, _ in got] == list(range(5000))


def test_field_accuracy(spark):
    t = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2")], "key string, path string, value string")
    p = spark.createDataFrame([("d", "a", "1"), ("d", "c", "9")], "key string, path string, value string")
    acc = E.field_accuracy(E.field_diff(t, p, ["key"]), ["key"]).first()
    assert acc["accuracy"] == 0.0  # one missing + one extra over two truth fields


def test_inline_diff_equals_join_diff(spark):
    from pyspark.sql import types as T
    sch = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
                        T.StructField("d", T.StructType([T.StructField("x", T.IntegerType())]))])
    rows = [("k1", ("1", "2", (3,)), ("1", None, (4,))), ("k2", ("5", None, None), ("5", "6", None))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("key", T.StringType()),
                                                   T.StructField("t", sch), T.StructField("p", sch)]))
    inline = E.field_diff_inline(df, ["key"], "t", "p", sch).select("key", "path", "kind")
    joined = E.field_diff(E.flatten_fields(df, ["key"], "t", sch), E.flatten_fields(df, ["key"], "p", sch), ["key"]) \
        .select("key", "path", "kind")
    assert sorted(inline.collect()) == sorted(joined.collect())
    assert {(r["key"], r["path"], r["kind"]) for r in inline.collect()} == {
        ("k1", "a", "match"), ("k1", "b", "missing"), ("k1", "d.x", "changed"), ("k2", "a", "match"), ("k2", "b", "extra")}


def test_edit_distance_near_and_far(spark):
    """Equal, a few edits apart, beyond the near diagonals, empty, null and non-ASCII texts."""
    base = "<s_an>12345</s_an>" * 12
    far = "x" * 150 + base[:100]
    rows = [(base, base), (base, base[:50] + "7" + base[51:]), (base, base[40:] + "zz"), (base, far), ("", base), ("", ""),
            (None, base), ("é€a", "e€b"), (base, "")]
    got = [tuple(r) for r in spark.createDataFrame(rows, "p string, a string").select(
        E.edit_distance(F.col("p"), F.col("a")), F.levenshtein("p", "a")).collect()]
    assert all(mine == plain for mine, plain in got)
    assert got[0][0] == 0 and got[1][0] == 1 and got[3][0] > E.NEAR_EDITS and got[6][0] is None


def test_edit_distance_by_growing_bands(spark):
    base = "<s_an>12345</s_an>" * 12
    rows = [(base, "x" * n + base) for n in (1, E.FEW_EDITS, E.FEW_EDITS + 1, E.NEAR_EDITS, E.NEAR_EDITS + 1, 60)]
    df = spark.createDataFrame(rows, "p string, a string").select(E.edit_distance(F.col("p"), F.col("a")))
    assert [r[0] for r in df.collect()] == [len(a) - len(p) for p, a in rows]
    assert E.FEW_EDITS < E.NEAR_EDITS
