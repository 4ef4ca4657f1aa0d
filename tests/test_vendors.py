import pytest
from pyspark.sql import functions as F

from ledgerline.operators import rules as R
from ledgerline.operators import vendors as V
from ledgerline.sources import fixtures as fx

from .conftest import SF_SMALL, pages_df

BANK_P0 = ("Your account number: 01234-0000899\nFrom December 8, 2020 to January 8, 2021\n1 of 2\n"
           "Your opening balance on December 8, 2020 $1,234.50\nTotal deposits into your account + 2,000.00\n"
           "Total withdrawals from your account - 234.50\nYour closing balance on January 8, 2021 = $3,000.00\n")
BANK_P1 = "Your account number: 01234-0000899\nFrom December 8, 2020 to January 8, 2021\n2 of 2\n"


def test_bank_statement_ok(spark):
    recs = V.extract_records(pages_df(spark, [("bank", "a.pdf", 0, BANK_P0), ("bank", "a.pdf", 1, BANK_P1)]), ["bank"])
    v = R.file_verdicts(recs).first()
    assert v["ok"] and v["reasons"] == ""
    r0 = recs.filter("page_idx = 0").first()
    assert str(r0["ob"]) == "1234.50" and str(r0["cb"]) == "3000.00" and r0["an"] == "01234-0000899"


def test_bank_skip_page_rejects_file(spark):
    p1 = BANK_P1.replace("2 of 2\n", "")
    recs = V.extract_records(pages_df(spark, [("bank", "a.pdf", 0, BANK_P0), ("bank", "a.pdf", 1, p1)]), ["bank"])
    v = R.file_verdicts(recs).first()
    assert v["reasons"] == "page_count" and not v["ok"]


def test_missing_amount_is_a_reason_not_null(spark):
    p0 = BANK_P0.replace("Total deposits into your account + 2,000.00\n", "")
    recs = V.extract_records(pages_df(spark, [("bank", "a.pdf", 0, p0), ("bank", "a.pdf", 1, BANK_P1)]), ["bank"])
    assert R.file_verdicts(recs).first()["reasons"] == "missing_field"


def test_telecom_cross_page_and_zero_balance(spark):
    p0 = "Customer 123456789 residential\nInvoice Date June 10, 2023\nAmount Due $0.00\n"
    p1 = ("Page 2 Of 2\nOutstanding Balance $10.00 Credit\nTOTAL INTERNET $5.00\nGST 5% $2.00\n"
          "MB PST 7% $3.00\n")
    recs = V.extract_records(pages_df(spark, [("telecom", "t.pdf", 0, p0), ("telecom", "t.pdf", 1, p1)]), ["telecom"])
    # a new balance of exactly zero is accepted (it is present, not missing)
    assert R.file_verdicts(recs).first()["reasons"] == ""
    bad = p1.replace("Page 2 Of 2", "Page 3 Of 3")
    recs = V.extract_records(pages_df(spark, [("telecom", "t.pdf", 0, p0), ("telecom", "t.pdf", 1, bad)]), ["telecom"])
    assert R.file_verdicts(recs).first()["reasons"] == "page_domain"


def test_documents_never_match(spark):
    from ledgerline.sources.tables import table
    docs = table(spark, SF_SMALL, "documents").select(F.lit("bank").alias("vendor"), F.col("doc_id").cast("string").alias("file"),
                                                      F.lit(0).alias("page_idx"), "text")
    recs = V.extract_records(docs, ["bank"])
    assert recs.filter("kept").count() == 0


def test_strict_mode_raises(spark):
    recs = V.extract_records(fx.doc_pages(spark, SF_SMALL, ["bank"]), ["bank"])
    with pytest.raises(Exception, match="rejected"):
        R.strict(R.file_verdicts(recs)).collect()


def test_planted_faults_reported(spark):
    recs = V.extract_records(fx.doc_pages(spark, SF_SMALL, ["telecom", "utility"]), ["telecom", "utility"])
    v = R.file_verdicts(recs).withColumn("k", F.regexp_extract("file", r"/(\d+)\.pdf", 1).cast("int"))
    miss = v.filter(F.col("reasons").contains("missing_account")).select("k").collect()
    assert miss and all(r["k"] % 23 == 5 for r in miss)
    assert v.filter((F.col("k") % 23 == 5) & ~F.col("reasons").contains("missing_account")).count() == 0


def test_user_extractor_with_pandas(spark):
    def extractor(pages):
        return [{"pn": i + 1, "t": "Bill", "v": "Test"} for i, _ in enumerate(pages)]

    pages = pages_df(spark, [("custom", "c.pdf", 0, "a"), ("custom", "c.pdf", 1, "b")])
    recs = V.extract_with_pandas(pages, extractor, "custom", "Bill", "Test")
    got = sorted((r["page_idx"], r["pn"]) for r in recs.collect())
    assert got == [(0, 1), (1, 2)]
    assert R.file_verdicts(recs).first()["ok"]


def test_hot_file_goes_through_partial_aggregation(spark):
    """One file holding a third of all pages: verdicts come from map-side
    partial aggregation (no collected group) and count every page."""
    n = 30000
    df = spark.range(n).select(
        F.lit("utility").alias("vendor"),
        F.when(F.col("id") % 3 == 0, F.lit("hot.pdf")).otherwise(F.concat(F.lit("f"), (F.col("id") % 1000).cast("string"))).alias("file"),
        F.col("id").cast("int").alias("page_idx"),
        F.lit("2 / 2\nConsumption history\n").alias("text"))
    recs = V.extract_records(df, ["utility"])
    v = R.file_verdicts(recs)
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan or "partial_" in plan
    hot = v.filter(F.col("file") == "hot.pdf").first()
    assert hot["n_pages"] == n // 3 and hot["n_records"] == n // 3


def test_hot_file_join_is_salted(spark):
    """A file above the split budget is spread over several join keys and
    the accepted rows equal the plain join's."""
    from ledgerline.session import materialize
    n = 9000
    df = spark.range(n).select(
        F.lit("utility").alias("vendor"),
        F.when(F.col("id") % 3 == 0, F.lit("hot.pdf")).otherwise(F.concat(F.lit("f"), (F.col("id") % 100).cast("string"))).alias("file"),
        F.col("id").cast("int").alias("page_idx"),
        F.lit("2 / 2\nConsumption history\n").alias("text"))
    recs = materialize(V.extract_records(df, ["utility"]), "hot")
    ver = R.file_verdicts(recs)
    salted, rejected = R.split_accepted(recs, ver, rows_per_split=500)
    plain = recs.filter("kept").join(ver.filter("ok").select("vendor", "file"), ["vendor", "file"], "left_semi")
    assert salted.count() + rejected.count() == n
    assert rejected.filter(F.col("file") == "hot.pdf").count() == n // 3  # page 0 lacks its amounts
    assert salted.select("vendor", "file", "page_idx").exceptAll(plain.select("vendor", "file", "page_idx")).count() == 0
    assert plain.select("vendor", "file", "page_idx").exceptAll(salted.select("vendor", "file", "page_idx")).count() == 0


def test_user_extractor_wrong_count_rejects_file(spark):
    pages = pages_df(spark, [("custom", "c.pdf", 0, "a"), ("custom", "c.pdf", 1, "b")])
    recs = V.extract_with_pandas(pages, lambda texts: [{"pn": 1}], "custom", "Bill", "Test")
    v = R.file_verdicts(recs).first()
    assert not v["ok"] and "page_count" in v["reasons"]


def test_credit_info_page_first_does_not_fail(spark):
    info = "IMPORTANT INFORMATION ABOUT YOUR ACCOUNT\n"
    p1 = ("STATEMENT FROM DEC 22, 2020 TO JAN 21, 2021\n1 OF 2\n4512 12** **** 0899\n"
          "Previous Statement Balance $10.00\nPayments & credits -$5.00\nPurchases & debits $2.00\n"
          "Cash advances $0.00\nInterest $1.00\nFees $0.00\nNEW BALANCE $8.00\n")
    recs = V.extract_records(pages_df(spark, [("credit", "c.pdf", 0, info), ("credit", "c.pdf", 1, p1)]), ["credit"])
    rows = {r["page_idx"]: r for r in recs.collect()}
    assert rows[0]["is_info"] and rows[0]["pn"] is None
    assert rows[1]["an"] == "4512120899" and str(rows[1]["nb"]) == "8.00"
    assert R.file_verdicts(recs).first()["ok"]


def test_page_reasons_and_reason_rows(spark):
    p0 = BANK_P0.replace("= $3,000.00", "= $3,000.01")
    recs = V.extract_records(pages_df(spark, [("bank", "a.pdf", 0, p0), ("bank", "a.pdf", 1, BANK_P1)]), ["bank"])
    per_page = {r["page_idx"]: r["page_reasons"] for r in R.page_reasons(recs).collect()}
    assert per_page == {0: "balance_mismatch", 1: ""}
    rows = R.reasons_table(R.file_verdicts(recs)).collect()
    assert [(r["file"], r["reason"]) for r in rows] == [("a.pdf", "balance_mismatch")]


def test_no_page_vanishes(spark):
    pages = pages_df(spark, [("bank", "a.pdf", 0, BANK_P0), ("acme", "b.pdf", 0, "x"), (None, "c.pdf", 0, "y")])
    recs = V.extract_records(pages)
    assert recs.count() == 3
    v = {r["file"]: r["reasons"] for r in R.file_verdicts(recs).collect()}
    assert v["b.pdf"] == v["c.pdf"] == "empty_file,page_count,unknown_vendor"


def test_pages_that_an_extractor_drops_are_counted(spark):
    V.register(V.Extractor("picky", "Bill", "Test", lambda df: df.filter("page_idx = 0 and file <> 'gone.pdf'").select(
        "vendor", "file", "page_idx", F.lit(1).alias("pn"), F.lit(True).alias("kept"))))
    try:
        pages = pages_df(spark, [("picky", "c.pdf", 0, "a"), ("picky", "c.pdf", 1, "b"), ("picky", "gone.pdf", 0, "c"), ("picky", "d.pdf", 0, "d")])
        v = {r["file"]: (r["n_pages"], r["n_records"], r["reasons"]) for r in R.file_verdicts(V.extract_records(pages, ["picky"])).collect()}
        assert v == {"c.pdf": (2, 1, "page_count"), "gone.pdf": (1, 0, "empty_file,page_count"), "d.pdf": (1, 1, "")}
    finally:
        del V.REGISTRY["picky"]


def test_user_extractor_info_page_has_a_name(spark):
    from ledgerline.plans import build as B
    pages = pages_df(spark, [("custom", "c.pdf", 0, "a"), ("custom", "c.pdf", 1, "b")])
    recs = V.extract_with_pandas(pages, lambda texts: [{"pn": 1}, {"pn": "info"}], "custom", "Bill", "Test")
    b = B.build_from_pages(None, records=recs)
    names = sorted(r["file_name"] for r in b.metadata.collect())
    assert names[0].startswith("images/custom_1_") and names[1].startswith("images/custom_info_")


def test_page_number_reason(spark):
    pages = pages_df(spark, [("utility", "u.pdf", 1, "no number here\nConsumption history\n"), ("utility", "w.pdf", 1, "0 / 2\nConsumption history\n")])
    v = {r["file"]: r["reasons"] for r in R.file_verdicts(V.extract_records(pages, ["utility"])).collect()}
    assert v == {"u.pdf": "page_number", "w.pdf": "page_number"}


def test_strict_fails_on_the_first_reject(spark):
    import pytest
    pages = pages_df(spark, [("acme", "b.pdf", 0, "x")])
    with pytest.raises(Exception, match="rejected b.pdf"):
        R.strict(R.file_verdicts(V.extract_records(pages))).collect()


def test_linear_patterns_match_as_the_printed_ones(spark):
    import random
    rnd = random.Random(4)
    parts = ["1", "23", "123456789", "1234567890", " of ", " OF ", " / ", "x", "\n", ",", "٣", "  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = [(V.DEP_PAGE, V.DEP_PAGE_LINEAR, 3), (V.CC_PAGE, V.CC_PAGE_LINEAR, 3), (V.UT_PAGE, V.UT_PAGE_LINEAR, 2), (V.TC_ACCOUNT, V.TC_ACCOUNT_LINEAR, 1)]
    for printed, linear, groups in pairs:
        found = F.regexp_extract("text", "(?U)" + linear, 0)
        df2 = df.withColumn("m", found)
        for g in range(1, groups + 1):
            again = F.regexp_extract("m", "(?U)" + (linear if printed is V.TC_ACCOUNT else printed), g)
            assert df2.filter(F.regexp_extract("text", "(?U)" + printed, g) != again).count() == 0


def test_a_page_of_a_megabyte_takes_a_moment(spark):
    import time
    pages = pages_df(spark, [(v, f"{v}{i}.pdf", 0, unit * (1_000_000 // len(unit)))
                             for v in V.REGISTRY for i, unit in enumerate(("word and word ", "7", "line without digits\n", "12 "))])
    began = time.time()
    good = R.file_verdicts(V.extract_records(pages)).filter("ok").collect()
    assert {r["vendor"] for r in good} == {"credit"}  # a page without a number is an information page there
    assert time.time() - began < 60


def test_filter_on_kept_searches_no_page_again(spark):
    pages = pages_df(spark, [("bank", "a.pdf", 0, BANK_P0), ("bank", "a.pdf", 1, BANK_P1), ("bank", "a.pdf", 2, "2 of 2\n"), ("bank", "a.pdf", 3, None)])
    kept = V.extract_records(pages, ["bank"]).filter("kept").groupBy("vendor").count()
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract" in line]
    assert [tuple(r) for r in kept.collect()] == [("bank", 2)]


def test_deposit_period_is_the_printed_pair(spark):
    import random

    from ledgerline.functions import rx as X
    rnd = random.Random(5)
    start = ["December", "dec", "Foo", "١٢", "De", "December 1,"]
    day = ["8", "08", "٣", "99999999999", "8x", ""]
    gap = [" ", "  ", "\n", " ", ""]
    def date():
        return rnd.choice(start) + rnd.choice(gap[:4]) + rnd.choice(day) + "," + rnd.choice(gap) + rnd.choice(["2020", "99999999999", "٢٠٢٠", "1"])
    texts = ["1 of 2\n" + rnd.choice(["", "From a to b ", "From "]) + "From " + date() + rnd.choice(gap) + "to" + rnd.choice(gap) + date()
             + rnd.choice(["", "1", " From May 1, 2021 to June 2, 2022"]) for _ in range(3000)]
    texts += [BANK_P0, "From May 1, 2021 to June 2, 2022", "From May 1, 2021 to June", None]
    pages = pages_df(spark, [("bank", f"{i}.pdf", 0, t) for i, t in enumerate(texts)])
    sd, ed = X.date_pair(F.col("text"), V.DEP_PERIOD, V.DEP_DATE)
    want = {r["file"]: (r["sd"], r["ed"]) for r in pages.select("file", sd.alias("sd"), ed.alias("ed")).collect()}
    got = {r["file"]: (r["sd"], r["ed"]) for r in V.extract_records(pages, ["bank"]).select("file", "sd", "ed").collect()}
    assert got == want and 100 < sum(s is not None for s, _ in want.values()) < len(want)
