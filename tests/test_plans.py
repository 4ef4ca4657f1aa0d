"""Plan properties the design relies on (checked on the physical plan)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerline.operators import rules as R
from ledgerline.operators import vendors as V
from ledgerline.session import materialize
from ledgerline.sources import fixtures as fx

from .conftest import SF_SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_is_narrow(spark):
    pages = materialize(fx.doc_pages(spark, SF_SMALL), "pages")
    plan = plan_of(V.extract_records(pages))
    assert "Exchange" not in plan


def test_verdicts_are_partial_hash_aggregates(spark):
    recs = materialize(V.extract_records(fx.doc_pages(spark, SF_SMALL)), "recs")
    plan = plan_of(R.file_verdicts(recs))
    assert "partial_count" in plan and "HashAggregate" in plan and "SortAggregate" not in plan
    # the verdict scan reads only flags and keys, never record payload
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "page_idx" not in scan and " an#" not in scan


def test_flagship_has_no_sort_aggregate(spark):
    plan = plan_of(E.queries()["bank_reconcile"](spark, SF_SMALL))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_scans_are_pruned(spark):
    plan = plan_of(E.queries()["x_money"](spark, SF_SMALL))
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "l_shipdate" not in scan and "l_returnflag" not in scan


def test_each_pattern_searches_a_page_once(spark):
    """Searches of the page text, by vendor: one for each pattern that the vendor has."""
    import re
    pages = materialize(fx.doc_pages(spark, SF_SMALL), "pages")
    most = {"bank": 7, "savings": 7, "credit": 11, "utility": 7, "telecom": 8}
    for vendor, n in most.items():
        plan = plan_of(V.extract_records(pages, [vendor]))
        assert len(re.findall(r"regexp_extract\(text#", plan)) <= n, vendor


def test_document_table_is_pruned_by_vendor(spark, tmp_out):
    from ledgerline.sources import pages as P
    P.write_documents(fx.doc_files(spark, SF_SMALL, ["bank", "credit"]), tmp_out + "/docs")
    plan = plan_of(V.extract_records(P.read_documents(spark, tmp_out + "/docs"), ["bank"]))
    scans = [line for line in plan.splitlines() if "FileScan json" in line]
    assert scans and any("PartitionFilters: [isnotnull(vendor" in s and "= bank)" in s for s in scans)


def test_state_diff_shuffles_no_arrays(spark):
    from ledgerline.operators import diff as C
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").selectExpr("vec_id as key", "embedding as values")
    plan = plan_of(C.state_diff(emb, emb))
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and "a_values" not in plan


def test_prepared_tables_are_written_by_methods_that_are_compiled(spark):
    from ledgerline import session

    key = "spark.sql.codegen.hugeMethodLimit"
    before, seen, real = spark.conf.get(key), [], session._write_table
    session._write_table = lambda df, name: seen.append(spark.conf.get(key)) or real(df, name)
    try:
        assert session.memo_table(spark, ("method-size-test",), lambda: spark.range(3)).count() == 3
    finally:
        session._write_table = real
    assert seen == [str(session.JIT_BYTES)] and spark.conf.get(key) == before


def test_prepared_tables_leave_no_shuffle_files(spark):
    import time

    from ledgerline import session

    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").splitlines() if "/shuffle_" in f}

    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    before = files()
    table = session.memo_table(spark, ("shuffle-files-test",), lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before and table.count() == 7
    assert spark.conf.get("spark.sql.parquet.compression.codec") == codec


def test_accepted_pages_are_shuffled_once(spark):
    recs = materialize(V.extract_records(fx.doc_pages(spark, SF_SMALL)), "recs")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = plan_of(R.split_accepted(recs, R.file_verdicts(recs))[0])
    finally:
        spark.conf.set(key, before)
    assert plan.count("SortMergeJoin") == 1


def test_rows_that_are_their_key_are_not_joined_to_their_positions(spark):
    from ledgerline.operators import dataset as D
    rows = [(e, f"f{i % 90}", i // 90) for e in (0, 1) for i in range(270)] + [(0, "f1", 0), (1, None, 5), (None, "f2", None)]
    df = spark.createDataFrame(rows, "epoch int, file string, page_idx int").repartition(3)
    order = [F.col("epoch"), D.shuffle_key(D.page_key(), F.col("epoch")), F.col("file"), F.col("page_idx")]
    idx = D.global_index(df, order)
    plan = plan_of(idx)
    assert "SortMergeJoin" not in plan and "md5" not in plan and "Exchange hashpartitioning(file" not in plan
    names = [f"_o{i}" for i in range(4)]
    want = [tuple(r) for r in df.withColumns(dict(zip(names, order))).orderBy(*names).select("epoch", "file", "page_idx").collect()]
    # rows that repeat come with each of their positions
    want = sorted((i, *r) for i, r in enumerate(want) for _ in range(rows.count(r)))
    assert len(want) == len(rows) + 2
    assert sorted((r.row_idx, r.epoch, r.file, r.page_idx) for r in idx.collect()) == want
