from decimal import Decimal

from pyspark.sql import functions as F

from ledgerline.functions import rx as X
from ledgerline.operators import vendors as V


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first()["x"]


def test_month_names(spark):
    names = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
             "October", "November", "December"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    got = [r[0] for r in df.select(X.long_month_number("m")).collect()]
    assert got == list(range(1, 13))


def test_unknown_month_is_null(spark):
    assert one(spark, "Smarch", X.month_number(F.col("text"))) is None


def test_money_with_no_break_space(spark):
    text = "Total deposits into your account + 1,234.50"
    assert one(spark, text, X.money(F.col("text"), V.DEP_DEPOSITS)) == Decimal("1234.50")


def test_missing_label_gives_null(spark):
    assert one(spark, "nothing here", X.money(F.col("text"), V.DEP_DEPOSITS)) is None
    assert one(spark, "", X.money(F.col("text"), V.DEP_DEPOSITS)) is None


def test_half_up_rounding(spark):
    assert one(spark, "1,234.565", X.to_decimal(F.col("text"))) == Decimal("1234.57")
    assert one(spark, "1,234.564", X.to_decimal(F.col("text"))) == Decimal("1234.56")
    assert one(spark, ",", X.to_decimal(F.col("text"))) is None


def test_signed_money_markers(spark):
    assert one(spark, "Balance forward $10.00 CR", X.signed_money(F.col("text"), V.UT_PREVIOUS, "CR", 1, 2)) == Decimal("-10.00")
    assert one(spark, "Balance forward $10.00", X.signed_money(F.col("text"), V.UT_PREVIOUS, "CR", 1, 2)) == Decimal("10.00")
    assert one(spark, "Payments & credits -$5.25", X.signed_money(F.col("text"), V.CC_PAYMENTS, "-")) == Decimal("-5.25")
    # a credit of zero reads as zero (the reference prints -0.00)
    assert one(spark, "Payments & credits -$0.00", X.signed_money(F.col("text"), V.CC_PAYMENTS, "-")) == Decimal("0.00")


def test_dates(spark):
    d = one(spark, "From December 8, 2020 to January 8, 2021", F.struct(*X.date_pair(F.col("text"), V.DEP_PERIOD, V.DEP_DATE)))
    assert (d[0]["d"], d[0]["m"], d[0]["y"]) == (8, 12, 2020)
    assert (d[1]["d"], d[1]["m"], d[1]["y"]) == (8, 1, 2021)
    sd, ed = X.date_pair_shared_year(F.col("text"), V.CC_PERIOD_FULL, V.CC_PERIOD_SHORT, V.CC_DATE, V.CC_START)
    r = one(spark, "STATEMENT FROM DEC 22 TO JAN 21, 2021", F.struct(sd, ed))
    assert (r[0]["d"], r[0]["m"], r[0]["y"]) == (22, 12, 2021)  # start takes the end's year
    # a date with an impossible day keeps its parts; a typed date is NULL
    r = one(spark, "From February 30, 2020 to March 1, 2020", F.struct(*X.date_pair(F.col("text"), V.DEP_PERIOD, V.DEP_DATE)))
    assert r[0]["d"] == 30
    assert one(spark, "2020-2-30", F.try_to_date(F.col("text"), "yyyy-M-d")) is None


def test_account_and_page_number(spark):
    text = "4512 12** **** 0899\n3 of 4"
    assert one(spark, text, X.unmask(X.account_number(F.col("text"), V.CC_ACCOUNT))) == "4512120899"
    assert one(spark, text, X.page_number(F.col("text"), V.DEP_PAGE)) == 3


def test_close_history_default(spark):
    df = spark.createDataFrame([(1.0, 1.005), (1.0, 1.02)], "a double, b double")
    assert [r[0] for r in df.select(X.close_to("a", "b")).collect()] == [True, False]
    assert one(spark, "Consumption history", X.not_contains(F.col("text"), V.UT_HISTORY)) is False
    assert one(spark, "x", X.default_zero(F.lit(None).cast("decimal(18,2)"))) == Decimal("0.00")


def test_period_parts_read_as_the_two_forms(spark):
    """X10 in one search: both forms, unknown months, years out of range and no period."""
    texts = ["FROM DEC 9, 2019 TO JAN 8, 2020", "FROM JUL 9 TO AUG 8, 2021", "FROM XXX 9, 2019 TO JAN 8, 2020", "FROM JUL 9 TO YYY 8, 2021",
             "FROM JUL 9 TO AUG 8", "", None, "FROM JUL 9, 99999999999 TO AUG 8, 2021", "FROM JUL 9 TO\nAUG 8, 2021"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = X.date_pair_shared_year(F.col("text"), V.CC_PERIOD_FULL, V.CC_PERIOD_SHORT, V.CC_DATE, V.CC_START)
    both = old[0].isNotNull() & old[1].isNotNull()
    new = X.period_dates(X.period_parts(F.col("text"), V.CC_PERIOD_PARTS))
    rows = df.select(F.when(both, old[0]), F.when(both, old[1]), *new).collect()
    for text, (s0, e0, s1, e1) in zip(texts, rows):
        assert (s0, e0) == (s1, e1), text
    assert rows[0][2] == (9, 12, 2019) and rows[1][2] == (9, 7, 2021) and rows[2][2] is None


def test_settings_texts_are_flattened_in_arrow_batches(spark):
    from ledgerline.operators import diff as C
    rows = [(1, '{"b": [2, 1, 2], "a": {"x": null, "y": {}}}'), (2, None), (3, "{broken"), (4, "[]"), (5, '{"b": []}')]
    flat = C.flatten(spark.createDataFrame(rows, "k int, js string"), ["k"], "js")
    assert sorted(map(tuple, flat.collect()), key=str) == sorted([
        (1, "a.x", 0, "null"), (1, "a.y", 0, "{}"), (1, "b[]", 0, "1"), (1, "b[]", 0, "2"), (1, "b[]", 1, "2"), (2, "", 0, None),
        (3, "", 0, "{broken"), (4, "", 0, "[]"), (5, "b", 0, "[]")], key=str)
    assert C.flatten(spark.createDataFrame([], "k int, js string"), ["k"], "js").count() == 0
    assert not hasattr(C, "pd")
