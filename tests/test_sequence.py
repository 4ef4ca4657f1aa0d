from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import sequence as S


def test_linearise_sorted_lists_and_text_sequence(spark):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("B", T.StringType()),
                           T.StructField("items", T.ArrayType(T.StringType())),
                           T.StructField("n", T.StructType([T.StructField("text_sequence", T.StringType())]))])
    df = spark.createDataFrame([("x", "y", ["1", "2"], ("raw",))], schema)
    out = df.select(S.linearise(F.struct(*[F.col(c) for c in schema.fieldNames()]), schema).alias("s")).first()["s"]
    # code-point order: 'B' < 'a' < 'items' < 'n'
    assert out == "<s_B>y</s_B><s_a>x</s_a><s_items>1<sep/>2</s_items><s_n>raw</s_n>"
    unsorted = df.select(S.linearise(F.struct(*[F.col(c) for c in schema.fieldNames()]), schema, False).alias("s")).first()["s"]
    assert unsorted.startswith("<s_a>x</s_a><s_B>y</s_B>")


def test_null_fields_are_left_out(spark):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(None, "v")], schema)
    assert df.select(S.linearise(F.struct("a", "b"), schema).alias("s")).first()["s"] == "<s_b>v</s_b>"


def test_cleanup_first_tag_across_line_break(spark):
    raw = "\n<doc_intel> <s_an> 12</s_an></s><pad>"
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(S.clean_prediction(F.col("raw"))).first()[0] == "<s_an>12</s_an>"
    raw2 = "ab\n<x\ny><doc_intel>zz"
    df2 = spark.createDataFrame([(raw2,)], "raw string")
    # '<x\ny>' spans a line break, so the first tag on one line is <doc_intel>
    assert df2.select(S.clean_prediction(F.col("raw"))).first()[0] == "ab\n<x\ny>zz"


def test_round_trip(spark):
    from ledgerline.functions.schema import GT_SCHEMA
    row = {f.name: None for f in GT_SCHEMA.fields}
    row.update({"an": "0123", "pn": "1", "t": "Bill", "v": "MB Hydro", "nb": "-10.50", "bd": (5, 6, 2024)})
    df = spark.createDataFrame([tuple(row[f.name] for f in GT_SCHEMA.fields)], GT_SCHEMA)
    gt = F.struct(*[F.col(f) for f in GT_SCHEMA.fieldNames()])
    seq = df.select(gt.alias("gt"), S.linearise(gt, GT_SCHEMA).alias("seq"))
    back = seq.select("gt", S.parse_sequence(F.col("seq")).alias("back"))
    r = back.first()
    assert r["gt"] == r["back"]


def labels_of(spark, text, **kw):
    return S.label_ids(spark.createDataFrame([(text,)], "s string"), "s", **kw).first()


def test_labels_fixed_length(spark):
    r = labels_of(spark, "<s_pn>1</s_pn></s>", max_length=10)
    voc = S.label_vocabulary()
    assert r["labels"] == [voc.index("<s_pn>"), 1000 + ord("1"), voc.index("</s_pn>"), voc.index("</s>")] + [S.IGNORE_ID] * 6
    assert r["n_tokens_full"] == 4 and not r["truncated"]
    assert len(S.vocabulary()) == 59 and len(set(voc)) == 63


def test_every_kind_of_token_has_its_own_id(spark):
    voc = S.label_vocabulary()
    r = labels_of(spark, "<doc_intel>a<sep/><<s_zzz><click/>Bell MTS</s><pad>", max_length=20)["labels"]
    unk = voc.index("<unk>")
    assert r[:10] == [voc.index("<doc_intel>"), 1000 + ord("a"), voc.index("<sep/>"), 1000 + ord("<"), unk, unk,
                      voc.index("Bell MTS"), voc.index("</s>"), voc.index("<pad>"), S.IGNORE_ID]


def test_truncation_is_told(spark):
    r = labels_of(spark, "abcdef</s>", max_length=4)
    assert len(r["labels"]) == 4 and r["n_tokens_full"] == 7 and r["truncated"]


def test_text_sequence_with_absent_siblings_and_null_items(spark):
    schema = T.StructType([T.StructField("text_sequence", T.StringType()), T.StructField("z", T.StringType()),
                           T.StructField("l", T.ArrayType(T.StringType())), T.StructField("b", T.BooleanType())])
    df = spark.createDataFrame([("raw", None, None, None), ("raw", "z", None, True), (None, None, ["1", None], None)], schema)
    got = [r[0] for r in df.select(S.linearise(F.struct(*schema.fieldNames()), schema)).collect()]
    assert got == ["raw", "<s_b>True</s_b><s_text_sequence>raw</s_text_sequence><s_z>z</s_z>", "<s_l>1<sep/>None</s_l>"]


def test_cleanup_tag_may_hold_a_carriage_return(spark):
    df = spark.createDataFrame([("<x\ry>one <s_a>1</s_a>",)], "raw string")
    assert df.select(S.clean_prediction(F.col("raw"))).first()[0] == "one <s_a>1</s_a>"


def test_arrays_come_back_as_arrays(spark):
    schema = T.StructType([T.StructField("l", T.ArrayType(T.StringType())), T.StructField("n", T.IntegerType())])
    df = spark.createDataFrame([(["1", "2"], 3), (["x"], None), (["1", None], 4)], schema).select(F.struct("l", "n").alias("gt"))
    both = df.withColumn("seq", S.linearise(F.col("gt"), schema)).withColumn("back", S.parse_sequence(F.col("seq"), schema))
    assert all(r["gt"] == r["back"] for r in both.collect())


def test_json_without_schema(spark):
    import json
    docs = [{"b": [1, None, {"x": "y"}], "a": {"text_sequence": "t"}, "k": "click"}, [["p", "q"], "r"], {"a": {"b": {"c": "d"}}}, "plain"]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{broken",), (None,)], "js string")
    df = df.select(S.linearise_json(F.col("js"), categorical=["click"]).alias("s")).withColumn("back", S.parse_json(F.col("s"), ["click"]))
    got = [(r["s"], r["back"] and json.loads(r["back"])) for r in df.collect()]
    assert got == [
        ("<s_a>t</s_a><s_b>1<sep/>None<sep/><s_x>y</s_x></s_b><s_k><click/></s_k>", {"a": "t", "b": ["1", "None", {"x": "y"}], "k": "click"}),
        ("p<sep/>q<sep/>r", ["p", "q", "r"]), ("<s_a><s_b><s_c>d</s_c></s_b></s_a>", {"a": {"b": {"c": "d"}}}),
        ("plain", {"text_sequence": "plain"}), (None, None), (None, None)]


def test_unknown_and_unclosed_tags_are_kept(spark):
    import json
    df = spark.createDataFrame([("<s_new>1</s_new><s_open>2<s_in>3</s_in></s_none>",)], "s string")
    assert json.loads(df.select(S.parse_json(F.col("s"))).first()[0]) == {"new": "1", "in": "3"}


def test_decode(spark):
    df = S.label_ids(spark.createDataFrame([("<s_pn>1é</s_pn></s>",)], "s string"), "s", max_length=8)
    assert df.select(S.decode_ids(F.col("labels"))).first()[0] == "<s_pn>1é</s_pn></s>"


def test_text_of_labels(spark):
    """Padding is repeated, anything else printed as it stands."""
    rows = [[5, 7, -100, -100], [-100, -100], [], [3], [-100, 4, -100], [1, -100, 2], None]
    df = spark.createDataFrame([(r,) for r in rows], "labels array<int>")
    got = [r[0] for r in df.select(S.labels_text(F.col("labels"))).collect()]
    assert got == [None if r is None else ",".join(map(str, r)) for r in rows]


def test_tag_side_spaces_go_as_by_the_printed_pattern(spark):
    import random
    rng = random.Random(4)
    rows = [("<x>" + "".join(rng.choices(["> ", " ", " </s_", "</s_a>", ">", "a", "  "], k=12)),) for _ in range(500)]
    df = spark.createDataFrame(rows, "raw string").select(S.clean_prediction(F.col("raw")).alias("got"), F.regexp_replace(
        F.regexp_replace(F.regexp_replace("raw", r"^([\s\S]*?)<[^\n]*?>", "$1"), r"(?U)^\s+|\s+$", ""), r"(?:(?<=>) | (?=</s_))", "").alias("want"))
    assert all(r.got == r.want for r in df.collect())
    assert "(?<=>)" not in df.select("got")._jdf.queryExecution().optimizedPlan().toString()
