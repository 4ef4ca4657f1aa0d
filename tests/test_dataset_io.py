import json
import os

from pyspark.sql import functions as F

from ledgerline.operators import diff as C
from ledgerline.plans import build as B
from ledgerline.sources import pages as P

from .conftest import SF_SMALL


def test_split_is_deterministic_and_by_file(spark):
    b1 = B.build(spark, SF_SMALL, ["bank"], by="file").metadata.select("file", "split")
    per_file = b1.groupBy("file").agg(F.count_distinct("split").alias("n"))
    assert per_file.filter("n > 1").count() == 0
    b2 = B.build(spark, SF_SMALL, ["bank"], by="file").metadata.select("file", "split")
    assert b1.exceptAll(b2).count() == 0


def test_metadata_sink_overwrite_and_read_back(spark, tmp_out):
    b = B.build(spark, SF_SMALL, ["credit"])
    out = os.path.join(tmp_out, "meta")
    P.write_metadata(b.metadata, out)
    P.write_metadata(b.metadata, out)  # second run replaces the first
    assert {"split=train", "split=validation"} <= set(os.listdir(out))
    back = P.read_metadata(spark, out, "validation")
    assert back.count() == b.metadata.filter("split = 'validation'").count()
    assert back.filter(~F.col("gt_ok")).count() == 0
    g = json.loads(back.first()["ground_truth"])
    assert isinstance(g["gt_parse"], dict)


def test_wholetext_nested_folders_and_suffix(spark, tmp_out):
    root = os.path.join(tmp_out, "bank")
    os.makedirs(os.path.join(root, "2021", "jan"))
    page0 = ("Your account number: 01234-0000899\nFrom December 8, 2020 to January 8, 2021\n1 of 2\n"
             "Your opening balance on December 8, 2020 $1.00\nTotal deposits into your account + 1.00\n"
             "Total withdrawals from your account - 0.00\nYour closing balance on January 8, 2021 = $2.00\n")
    page1 = "From December 8, 2020 to January 8, 2021\n2 of 2\n"
    with open(os.path.join(root, "2021", "jan", "a.txt"), "w") as f:
        f.write(page0 + "\f" + page1)
    with open(os.path.join(root, "skip.csv"), "w") as f:
        f.write("not a statement")
    pages = P.read_text_pages(spark, root, "bank")
    assert pages.count() == 2
    b = B.build_from_pages(pages, ["bank"])
    assert b.verdicts.first()["ok"]
    man = b.manifest.collect()
    assert sorted(r["page_number"] for r in man) == [1, 2]
    listing = P.list_files(spark, root)
    assert P.missing_outputs(b.manifest, listing).count() == 2  # no images rendered here
    dest = sorted(r["dest"] for r in b.manifest.collect())[0]
    os.makedirs(os.path.dirname(os.path.join(tmp_out, dest)))
    with open(os.path.join(tmp_out, dest), "w") as f:
        f.write("image")
    assert P.missing_outputs(b.manifest, P.list_files(spark, tmp_out)).count() == 1  # a listed URI is found
    odd = P.ineligible_files(spark, root, "*.txt").collect()
    assert [(os.path.basename(r["path"]), r["reason"]) for r in odd] == [("skip.csv", "suffix")]


def test_diffs(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, value string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "path string, value string")
    kinds = {r["path"]: r["kind"] for r in C.flat_diff(a, b, ["path"]).collect()}
    assert kinds == {"y": "changed", "z": "added"}
    assert C.identical(C.flat_diff(a, a, ["path"]))
    s = spark.createDataFrame([("t",), ("t",), ("u",)], "token string")
    s2 = spark.createDataFrame([("t",), ("v",)], "token string")
    got = sorted((r["token"], r["side"]) for r in C.multiset_diff(s, s2).collect())
    assert got == [("t", "a"), ("u", "a"), ("v", "b")]


def test_guards(spark, tmp_out):
    import pytest
    empty = spark.createDataFrame([], "split string, file_name string, ground_truth string")
    with pytest.raises(ValueError, match="empty"):
        P.write_metadata(empty, os.path.join(tmp_out, "m"))
    with pytest.raises(ValueError, match="vendor"):
        P.read_text_pages(spark, tmp_out, "")


def test_build_from_folders_uses_registry_glob(spark, tmp_out):
    root = os.path.join(tmp_out, "telecom", "2023")
    os.makedirs(root)
    p0 = "Customer 123456789 residential\nInvoice Date June 10, 2023\nAmount Due $10.00\n"
    p1 = "Page 2 Of 2\nOutstanding Balance $1.00\nTOTAL INTERNET $7.00\nGST 5% $1.00\nMB PST 7% $1.00\n"
    with open(os.path.join(root, "bill.txt"), "w") as f:
        f.write(p0 + "\f" + p1)
    with open(os.path.join(root, "bill.pdf"), "w") as f:
        f.write("binary")
    b = B.build_from_folders(spark, {"telecom": os.path.join(tmp_out, "telecom")})
    assert b.verdicts.count() == 1 and b.verdicts.first()["ok"]
    assert b.metadata.count() == 2


def test_partial_rewrite_keeps_other_split(spark, tmp_out):
    b = B.build(spark, SF_SMALL, ["credit"])
    out = os.path.join(tmp_out, "meta2")
    P.write_metadata(b.metadata, out)
    n_train = P.read_metadata(spark, out, "train").count()
    P.write_metadata(b.metadata.filter("split = 'validation'"), out, only_written_splits=True)
    assert P.read_metadata(spark, out, "train").count() == n_train
    P.write_metadata(b.metadata.filter("split = 'validation'"), out)
    assert P.read_metadata(spark, out, "train").count() == 0


def test_bad_targets_are_false_and_quarantined(spark, tmp_out):
    out = os.path.join(tmp_out, "m")
    rows = [("train", "a", '{"gt_parse":{"pn":1}}'), ("train", "b", '{"gt_parse":"{x"}'), ("train", "c", "{broken"), ("train", "d", None),
            ("train", "e", '{"gt_parse":[1]}'), ("train", "f", "[]")]
    P.write_metadata(spark.createDataFrame(rows, "split string, file_name string, ground_truth string"), out)
    back = P.read_metadata(spark, out)
    assert {r["file_name"]: r["gt_ok"] for r in back.collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False}
    assert {r["file_name"]: r["reason"] for r in P.quarantined_targets(back).collect()} == {
        "b": "no_gt_parse_object", "c": "not_json", "d": "absent", "e": "no_gt_parse_object", "f": "no_gt_parse_object"}


def test_settings_diff_lists_nulls_and_presence(spark):
    mk = lambda text: spark.createDataFrame([(1, text)], "k int, settings string")
    diff = lambda x, y: sorted((r["path"], r["kind"], r["a_value"], r["b_value"]) for r in C.settings_diff(mk(x), mk(y), ["k"]).collect())
    assert diff('{"a": {"b": null}, "l": [1, 2, 2]}', '{"l": [2, 1, 2], "a": {"b": null}}') == []
    assert diff('{"l": [1, 2, 2], "e": {}}', '{"l": [2, 1], "n": null}') == [
        ("e", "removed", "{}", None), ("l[]", "removed", "2", None), ("n", "added", None, "null")]
    none = spark.createDataFrame([("x", None)], "path string, value string")
    assert C.identical(C.flat_diff(none, none, ["path"]))


def test_state_diff_sees_the_shape(spark):
    mk = lambda sh: spark.createDataFrame([("w", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], sh)], "key string, values array<double>, shape array<int>")
    assert [r["kind"] for r in C.state_diff(mk([2, 3]), mk([3, 2]), shape="shape").collect()] == ["shape"]
    assert C.state_diff(mk([2, 3]), mk([2, 3]), shape="shape").isEmpty()


def test_token_diff_refuses_empty_lists(spark):
    import pytest
    empty = spark.createDataFrame([], "token string")
    with pytest.raises(ValueError, match="empty"):
        C.multiset_diff(empty, spark.createDataFrame([("a",)], "token string"))


def test_no_shared_folder_is_an_error_on_a_cluster():
    import pytest
    from ledgerline.session import ensure_checkpoint_dir

    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_prepared_table_is_read_again_and_forgotten(spark):
    from ledgerline.session import forget_tables, memo_table
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    first, second = memo_table(spark, ("t9", "x"), build), memo_table(spark, ("t9", "x"), build)
    assert len(calls) == 1 and second.count() == 3 and first.inputFiles() == second.inputFiles()
    assert "t9" in second._jdf.queryExecution().executedPlan().toString()
    forget_tables(spark)
    assert memo_table(spark, ("t9", "x"), build).count() == 3 and len(calls) == 2
