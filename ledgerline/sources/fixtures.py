"""Statement pages rendered from the driver tables.

The input contract of the build starts at page text. No statement PDFs exist
in the test data, so each vendor's pages are rendered from base tables with
planted faults. Because the truth comes from the tables, an oracle can check
every extracted field without repeating any pattern.

Every renderer is an aggregation of one fact table by the account key `k`
(map-side partial aggregation, so a hot key is combined before the shuffle),
joined to its dimension table where one exists (sort-merge or, when AQE
measures it small, broadcast), followed by a narrow projection that builds
the page texts. Output: ``files(vendor, file, k, pages array<string>)``;
``to_pages`` explodes it into ``pages(vendor, file, page_idx, text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rx import fmt_amount, fmt_long_date, fmt_money, month_name
from ..functions.schema import MONEY
from .tables import table

# ---------------------------------------------------------------------------
# Planted fault rules on the account key k (modulus, residue).
FAULT_BALANCE = (17, 3)        # closing / new balance printed 0.01 too high
FAULT_NO_ACCOUNT = (23, 5)     # account line left out
FAULT_NO_PAGE_NUMBER = (29, 7) # "n of m" left out on page 2 (bank, savings)
FAULT_PAGE_DOMAIN = (31, 9)    # telecom page 2 says "Page 3 Of 3"
FAULT_MISSING_AMOUNT = (37, 11)  # one amount line left out
# ---------------------------------------------------------------------------

VENDORS = ["bank", "savings", "credit", "utility", "telecom"]


def fault(k: Column, rule: tuple[int, int]) -> Column:
    return (k % F.lit(rule[0])) == F.lit(rule[1])


def _dec(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _sum_if(cond: Column, value: Column) -> Column:
    # Each value is cast to exact cents before summing.
    return F.coalesce(F.sum(F.when(cond, _dec(value))), _zero()).cast(MONEY)


def _lines(*parts: Column) -> Column:
    """Join non-NULL lines with newlines; every line ends in '\\n'."""
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _unless(cond: Column, line: Column) -> Column:
    return F.when(~cond, line)


def _file(vendor: str, k: Column) -> Column:
    return F.concat(F.lit(vendor + "/"), k.cast("string"), F.lit(".pdf"))


def _bump(amount: Column, k: Column) -> Column:
    return (amount + F.when(fault(k, FAULT_BALANCE), F.lit(0.01).cast(MONEY)).otherwise(_zero())).cast(MONEY)


def _files(vendor: str, k: Column, pages: list[Column]) -> list[Column]:
    return [F.lit(vendor).alias("vendor"), _file(vendor, k).alias("file"), k.alias("k"),
            F.array(*pages).alias("pages")]


def _deposit_pages(vendor: str, df: DataFrame) -> DataFrame:
    """Chequing / savings layout over (k, nat, ob, dep, wd, d0, d1)."""
    k = F.col("k")
    acct = _line("Your account number: ", F.lpad(F.col("nat").cast("string"), 5, "0"), "-",
                 F.lpad(k.cast("string"), 7, "0"))
    period = _line("From ", fmt_long_date("d0"), " to ", fmt_long_date("d1"))
    closing = _bump(F.col("ob") + F.col("dep") - F.col("wd"), k)
    p0 = _lines(
        _unless(fault(k, FAULT_NO_ACCOUNT), acct), period, F.lit("1 of 2"),
        _line("Your opening balance on ", fmt_long_date("d0"), " ", fmt_money("ob")),
        _unless(fault(k, FAULT_MISSING_AMOUNT),
                _line("Total deposits into your account + ", fmt_amount("dep"))),
        _line("Total withdrawals from your account - ", fmt_amount("wd")),
        _line("Your closing balance on ", fmt_long_date("d1"), " = ", fmt_money(closing)),
    )
    p1 = _lines(
        _unless(fault(k, FAULT_NO_ACCOUNT), acct), period,
        _unless(fault(k, FAULT_NO_PAGE_NUMBER), F.lit("2 of 2")),
        F.lit("Details of your account activity"),
    )
    return df.select(*_files(vendor, k, [p0, p1]))


def bank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chequing statement per customer with an order.
    opening = c_acctbal; deposits = orders with status F; withdrawals = status O."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    agg = o.groupBy(F.col("o_custkey").alias("k")).agg(
        _sum_if(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("dep"),
        _sum_if(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("wd"),
        F.to_date(F.min("o_orderdate")).alias("d0"),
        F.to_date(F.max("o_orderdate")).alias("d1"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nat"), _dec("c_acctbal").alias("ob"))
    return _deposit_pages("bank", agg.join(c, "k"))


def savings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One savings statement per supplier with line items.
    opening = s_acctbal; deposits = extended price of status-F lines;
    withdrawals = all quantities."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linestatus", "l_extendedprice",
                                                  "l_quantity", "l_shipdate")
    agg = li.groupBy(F.col("l_suppkey").alias("k")).agg(
        _sum_if(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("dep"),
        _sum_if(F.lit(True), F.col("l_quantity")).alias("wd"),
        F.to_date(F.min("l_shipdate")).alias("d0"),
        F.to_date(F.max("l_shipdate")).alias("d1"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nat"), _dec("s_acctbal").alias("ob"))
    return _deposit_pages("savings", agg.join(s, "k"))


def _mon3_upper(d: Column) -> Column:
    return F.upper(F.substring(month_name(F.month(d)), 1, 3))


def credit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One credit-card statement per event user.
    previous = views; payments = -clicks; purchases = purchases;
    cash advances = signups; interest = errors; fees = 0."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts")
    et = F.col("event_type")
    df = ev.groupBy(F.col("user_id").alias("k")).agg(
        _sum_if(et == "view", F.col("value")).alias("pb"),
        (-_sum_if(et == "click", F.col("value"))).cast(MONEY).alias("tpc"),
        _sum_if(et == "purchase", F.col("value")).alias("tpd"),
        _sum_if(et == "signup", F.col("value")).alias("ca"),
        _sum_if(et == "error", F.col("value")).alias("ic"),
        F.date_sub(F.to_date(F.min("ts")), 10).alias("d0"),
        F.to_date(F.max("ts")).alias("d1"),
    )
    k = F.col("k")
    d0, d1 = F.col("d0"), F.col("d1")
    full = lambda d: _line(_mon3_upper(d), " ", F.dayofmonth(d).cast("string"), ", ", F.year(d).cast("string"))
    short = lambda d: _line(_mon3_upper(d), " ", F.dayofmonth(d).cast("string"))
    period = F.when(k % 2 == 0, _line("STATEMENT FROM ", full(d0), " TO ", full(d1))) \
        .otherwise(_line("STATEMENT FROM ", short(d0), " TO ", full(d1)))
    card = _line("4512 ", F.lpad((k % 100).cast("string"), 2, "0"), "** **** ",
                 F.lpad((k % 10000).cast("string"), 4, "0"))
    fees = _zero()
    nb = _bump(F.col("pb") + F.col("tpc") + F.col("tpd") + F.col("ca") + F.col("ic") + fees, k)
    p0 = _lines(
        period, F.lit("1 OF 2"), _unless(fault(k, FAULT_NO_ACCOUNT), card),
        _line("Previous Statement Balance ", fmt_money("pb")),
        _line("Payments & credits ", fmt_money("tpc")),
        _line("Purchases & debits ", fmt_money("tpd")),
        _unless(fault(k, FAULT_MISSING_AMOUNT), _line("Cash advances ", fmt_money("ca"))),
        _line("Interest ", fmt_money("ic")),
        _line("Fees ", fmt_money(fees)),
        _line("NEW BALANCE ", fmt_money(nb)),
    )
    p1 = _lines(F.lit("IMPORTANT INFORMATION ABOUT YOUR ACCOUNT"),
                F.lit("Please keep this statement for your records."))
    return df.select(*_files("credit", k, [p0, p1]))


def _suffix_money(x: Column, marker: str) -> Column:
    """'$10.00 CR' for negatives, '$10.00' otherwise."""
    return F.concat(F.lit("$"), fmt_amount(x), F.when(x < 0, F.lit(" " + marker)).otherwise(F.lit("")))


def utility_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One electricity bill per order's line items.
    previous = N prices (credit for odd k); electricity = A prices for A
    quantities; EPP = R quantities (credit when k % 3 = 0), line only if R rows."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice",
                                                  "l_quantity", "l_shipdate")
    rf = F.col("l_returnflag")
    df = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        _sum_if(rf == "N", F.col("l_extendedprice")).alias("pb_abs"),
        _sum_if(rf == "A", F.col("l_quantity")).alias("kwh"),
        _sum_if(rf == "A", F.col("l_extendedprice")).alias("nc"),
        F.count(F.when(rf == "R", 1)).alias("n_r"),
        _sum_if(rf == "R", F.col("l_quantity")).alias("epp_abs"),
        F.to_date(F.max("l_shipdate")).alias("bd"),
    )
    k = F.col("k")
    pb = F.when(k % 2 == 1, -F.col("pb_abs")).otherwise(F.col("pb_abs")).cast(MONEY)
    epp = F.when(k % 3 == 0, -F.col("epp_abs")).otherwise(F.col("epp_abs")).cast(MONEY)
    nb = _bump(pb + F.col("nc") + epp, k)
    bd = F.col("bd")
    acct = _line("Account ", F.lpad((k % 10000000).cast("string"), 7, "0"), " ",
                 F.lpad(((k * 7 + 3) % 10000000).cast("string"), 7, "0"))
    p0 = _lines(
        _unless(fault(k, FAULT_NO_ACCOUNT), acct),
        _line("date of transmission", F.substring(month_name(F.month(bd)), 1, 3), " ",
              F.dayofmonth(bd).cast("string"), " due ", F.year(bd).cast("string")),
        _line("Balance forward ", _suffix_money(pb, "CR")),
        _unless(fault(k, FAULT_MISSING_AMOUNT),
                _line("Electricity ", fmt_amount("kwh"), " kWh ", _suffix_money(F.col("nc"), "CR"))),
        F.when(F.col("n_r") > 0, _line("EPP Diff ", F.col("n_r").cast("string"), ".00 x ",
                                       _suffix_money(epp, "CR"))),
        _line("Amount due ", _suffix_money(nb, "CR")),
    )
    p1 = _lines(F.lit("2 / 2"), F.lit("Consumption history"), F.lit("Monthly use in kWh"))
    return df.select(*_files("utility", k, [p0, p1]))


def telecom_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One telecom bill per supplier's line items.
    previous = A quantities (credit for even k); internet = N prices;
    GST = N quantities; PST = R quantities."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice",
                                                  "l_quantity", "l_shipdate")
    rf = F.col("l_returnflag")
    df = li.groupBy(F.col("l_suppkey").alias("k")).agg(
        _sum_if(rf == "A", F.col("l_quantity")).alias("pb_abs"),
        _sum_if(rf == "N", F.col("l_extendedprice")).alias("i"),
        _sum_if(rf == "N", F.col("l_quantity")).alias("gst"),
        _sum_if(rf == "R", F.col("l_quantity")).alias("pst"),
        F.to_date(F.max("l_shipdate")).alias("bd"),
    )
    k = F.col("k")
    pb = F.when(k % 2 == 0, -F.col("pb_abs")).otherwise(F.col("pb_abs")).cast(MONEY)
    nb = _bump(pb + F.col("i") + F.col("gst") + F.col("pst"), k)
    bd = F.col("bd")
    p0 = _lines(
        _unless(fault(k, FAULT_NO_ACCOUNT), _line("Customer ", (k + 100000000).cast("string"), " residential")),
        _line("Invoice Date ", month_name(F.month(bd)), " ", F.lpad(F.dayofmonth(bd).cast("string"), 2, "0"),
              ", ", F.year(bd).cast("string")),
        _line("Amount Due ", _suffix_money(nb, "Credit")),
    )
    n2 = F.when(fault(k, FAULT_PAGE_DOMAIN), F.lit("3")).otherwise(F.lit("2"))
    p1 = _lines(
        _line("Page ", n2, " Of ", n2),
        _line("Outstanding Balance ", _suffix_money(pb, "Credit")),
        _unless(fault(k, FAULT_MISSING_AMOUNT), _line("TOTAL INTERNET ", _suffix_money(F.col("i"), "Credit"))),
        _line("GST 5% ", _suffix_money(F.col("gst"), "Credit")),
        _line("MB PST 7% ", _suffix_money(F.col("pst"), "Credit")),
    )
    return df.select(*_files("telecom", k, [p0, p1]))


RENDERERS = {
    "bank": bank_files,
    "savings": savings_files,
    "credit": credit_files,
    "utility": utility_files,
    "telecom": telecom_files,
}


def doc_files(spark: SparkSession, sf_dir: str, vendors: list[str] | None = None) -> DataFrame:
    """Union of the rendered files of the chosen vendors (all by default)."""
    out = None
    for v in vendors or VENDORS:
        df = RENDERERS[v](spark, sf_dir)
        out = df if out is None else out.unionByName(df)
    return out


def to_pages(files: DataFrame) -> DataFrame:
    """files -> pages(vendor, file, page_idx, text); narrow (no shuffle).

    The outer form keeps Catalyst from inferring a non-empty-array filter
    that it would push below the renderers' joins (re-rendering every page
    inside the join condition); arrays here are never empty, so rows match.
    """
    return files.select("vendor", "file", F.posexplode_outer("pages").alias("page_idx", "text")) \
        .withColumn("page_idx", F.col("page_idx").cast("int"))


def doc_pages(spark: SparkSession, sf_dir: str, vendors: list[str] | None = None) -> DataFrame:
    return to_pages(doc_files(spark, sf_dir, vendors))
