"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with oracle SQL.

Every query reads the driver tables (or pages Spark renders from them) in
full. Money leaves a query as DOUBLE (exact cents -> nearest double in both
engines); dates leave as three int columns. ``ORACLE`` holds the DuckDB SQL
of the same result, computed from base tables, never by re-extracting text.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rx as X
from ..functions.schema import DATE_FIELDS, LITERALS, MONEY_FIELDS
from ..operators import rules as R
from ..operators import vendors as V
from ..sources import fixtures as fx
from ..sources.tables import table
from . import oracle_truth as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def flat(cols: list[str]) -> list[Column]:
    """Flatten record fields for output: dates -> x_d/x_m/x_y, money -> double."""
    out = []
    for n in cols:
        if n in DATE_FIELDS:
            out += [c(n).getField(p).alias(f"{n}_{p}") for p in ("d", "m", "y")]
        elif n in MONEY_FIELDS:
            out.append(c(n).cast("double").alias(n))
        else:
            out.append(c(n))
    return out


def records(spark: SparkSession, sf: str, vendors: list[str] | None = None) -> DataFrame:
    from .build import records as _records
    return _records(spark, sf, vendors)


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# =========================================================== X: scalar functions
@query("x_money", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount
FROM lineitem""")
def x_money(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    text = F.concat(F.lit("Electricity "), X.fmt_amount("l_quantity"), F.lit(" kWh $"),
                    X.fmt_amount(c("l_extendedprice").cast("decimal(18,2)")))
    return li.select("l_orderkey", "l_linenumber",
                     X.money(text, V.UT_ELECTRICITY).cast("double").alias("amount"))


@query("x_signed_money", """
SELECT event_id,
  CAST(CASE WHEN event_id % 2 = 0 THEN -CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS DOUBLE) AS prefix_amount,
  CAST(CASE WHEN event_id % 3 = 0 THEN -CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS DOUBLE) AS suffix_amount
FROM events""")
def x_signed_money(spark, sf):
    ev = table(spark, sf, "events").select("event_id", c("value").cast("decimal(18,2)").alias("v"))
    k = c("event_id")
    line1 = F.concat(F.lit("Payments & credits "), F.when(k % 2 == 0, F.lit("-")).otherwise(F.lit("")),
                     F.lit("$"), X.fmt_amount("v"))
    line2 = F.concat(F.lit("Balance forward $"), X.fmt_amount("v"),
                     F.when(k % 3 == 0, F.lit(" CR")).otherwise(F.lit("")))
    text = F.concat_ws("\n", line1, line2)
    return ev.select("event_id",
                     X.signed_money(text, V.CC_PAYMENTS, "-").cast("double").alias("prefix_amount"),
                     X.signed_money(text, V.UT_PREVIOUS, "CR", 1, 2).cast("double").alias("suffix_amount"))


@query("x_decimal", """
SELECT l_orderkey, l_linenumber,
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) + CASE WHEN l_linenumber % 10 >= 5 THEN 1 ELSE 0 END AS DOUBLE) / 100 AS amount
FROM lineitem""")
def x_decimal(spark, sf):
    """X6 half-up: a third decimal digit (line number % 10) is appended."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    s = F.concat(X.fmt_amount(c("l_extendedprice").cast("decimal(18,2)")), (c("l_linenumber") % 10).cast("string"))
    return li.select("l_orderkey", "l_linenumber", X.to_decimal(s).cast("double").alias("amount"))


@query("x_month", """
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS m_long, CAST(month(o_orderdate) AS INTEGER) AS m_short
FROM orders""")
def x_month(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    name = X.month_name(F.month("o_orderdate"))
    return o.select("o_orderkey", X.long_month_number(name).alias("m_long"),
                    X.month_number(F.upper(F.substring(name, 1, 3))).alias("m_short"))


@query("x_date", """
SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(month(o_orderdate) AS INTEGER) AS m,
  CAST(year(o_orderdate) AS INTEGER) AS y
FROM orders""")
def x_date(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    text = F.concat(F.lit("Your opening balance on "), X.fmt_long_date("o_orderdate"), F.lit(" $1.00"))
    d = X.date3(text, V.DEP_DATE)
    return o.select("o_orderkey", d.getField("d").alias("d"), d.getField("m").alias("m"), d.getField("y").alias("y"))


@query("x_date_pair", """
SELECT o_orderkey,
  CAST(day(o_orderdate) AS INTEGER) AS sd_d, CAST(month(o_orderdate) AS INTEGER) AS sd_m, CAST(year(o_orderdate) AS INTEGER) AS sd_y,
  CAST(day(o_orderdate + INTERVAL 30 DAY) AS INTEGER) AS ed_d, CAST(month(o_orderdate + INTERVAL 30 DAY) AS INTEGER) AS ed_m,
  CAST(year(o_orderdate + INTERVAL 30 DAY) AS INTEGER) AS ed_y
FROM orders""")
def x_date_pair(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d0"))
    text = F.concat(F.lit("From "), X.fmt_long_date("d0"), F.lit(" to "), X.fmt_long_date(F.date_add("d0", 30)))
    sd, ed = X.date_pair(text, V.DEP_PERIOD, V.DEP_DATE)
    return o.select("o_orderkey", sd.alias("sd"), ed.alias("ed")).select("o_orderkey", *flat(["sd", "ed"]))


@query("x_date_shared_year", """
SELECT event_id,
  CAST(day(CAST(ts AS DATE) - INTERVAL 40 DAY) AS INTEGER) AS sd_d,
  CAST(month(CAST(ts AS DATE) - INTERVAL 40 DAY) AS INTEGER) AS sd_m,
  CAST(CASE WHEN event_id % 2 = 1 THEN year(ts) ELSE year(CAST(ts AS DATE) - INTERVAL 40 DAY) END AS INTEGER) AS sd_y,
  CAST(day(ts) AS INTEGER) AS ed_d, CAST(month(ts) AS INTEGER) AS ed_m, CAST(year(ts) AS INTEGER) AS ed_y
FROM events""")
def x_date_shared_year(spark, sf):
    """Odd ids print the start without a year; it takes the end's year."""
    ev = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("d1"))
    d0 = F.date_sub("d1", 40)
    mon = lambda d: F.upper(F.substring(X.month_name(F.month(d)), 1, 3))
    full = lambda d: F.concat(mon(d), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string"))
    short = lambda d: F.concat(mon(d), F.lit(" "), F.dayofmonth(d).cast("string"))
    text = F.concat(F.lit("STATEMENT FROM "),
                    F.when(c("event_id") % 2 == 1, short(d0)).otherwise(full(d0)),
                    F.lit(" TO "), full(c("d1")))
    sd, ed = X.date_pair_shared_year(text, V.CC_PERIOD_FULL, V.CC_PERIOD_SHORT, V.CC_DATE, V.CC_START)
    return ev.select("event_id", sd.alias("sd"), ed.alias("ed")).select("event_id", *flat(["sd", "ed"]))


@query("x_account", """
SELECT c_custkey,
  lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS bank_account,
  '4512' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS card_account
FROM customer""")
def x_account(spark, sf):
    cu = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    k = c("c_custkey")
    text = F.concat(
        F.lit("Your account number: "), F.lpad(c("c_nationkey").cast("string"), 5, "0"), F.lit("-"),
        F.lpad(k.cast("string"), 7, "0"), F.lit("\nSTATEMENT\n4512 "), F.lpad((k % 100).cast("string"), 2, "0"),
        F.lit("** **** "), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("\n"))
    return cu.select("c_custkey", X.account_number(text, V.DEP_ACCOUNT).alias("bank_account"),
                     X.unmask(X.account_number(text, V.CC_ACCOUNT)).alias("card_account"))


@query("x_page_number", """
SELECT conv_id, turn, CAST(turn + 1 AS INTEGER) AS pn FROM conversations""")
def x_page_number(spark, sf):
    cv = table(spark, sf, "conversations").select("conv_id", "turn")
    text = F.concat(F.lit("Page "), (c("turn") + 1).cast("string"), F.lit(" Of "), (c("turn") + 2).cast("string"))
    return cv.select("conv_id", "turn", X.page_number(text, V.TC_PAGE).alias("pn"))


@query("x_close", """
SELECT l_orderkey, l_linenumber, abs(l_quantity * 0.01 - l_discount) < 0.01 AS close
FROM lineitem""")
def x_close(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return li.select("l_orderkey", "l_linenumber",
                     X.close_to(c("l_quantity") * F.lit(0.01), c("l_discount")).alias("close"))


@query("x_history_page", T.with_truth(T.UTILITY) + """
SELECT file, p.page_idx, p.page_idx = 0 AS not_history
FROM utility_t, (SELECT 0 AS page_idx UNION ALL SELECT 1) p""")
def x_history_page(spark, sf):
    pages = fx.doc_pages(spark, sf, ["utility"])
    return pages.select("file", "page_idx", X.not_contains("text", V.UT_HISTORY).alias("not_history"))


@query("x_default_zero", T.with_truth(T.UTILITY) + """
SELECT file, CAST(epp AS DOUBLE) AS epp FROM utility_t""")
def x_default_zero(spark, sf):
    pages = fx.doc_pages(spark, sf, ["utility"]).filter(c("page_idx") == 0)
    return pages.select("file", X.default_zero(X.signed_money("text", V.UT_EPP, "CR", 1, 2))
                        .cast("double").alias("epp"))


# Patterns without a label: plain numbers that any text may hold; DuckDB searches them by itself.
_NUMBERS = {"DEP_PAGE_LINEAR": r"\d+\s+of\s+\d+", "CC_PAGE_LINEAR": r"\d+\s+OF\s+\d+", "UT_PAGE_LINEAR": r"\d+ / \d+",
            "CC_ACCOUNT": r"\d{4}\D\d{2}\D{8}\d{4}", "UT_ACCOUNT": r"\d{7}\D\d{7}", "TC_ACCOUNT_LINEAR": r"\D\d{9}\D"}
# Patterns with a label: no other text has one.
_ANCHORED = ["DEP_PERIOD", "DEP_ACCOUNT", "DEP_OPENING", "DEP_CLOSING", "DEP_DEPOSITS", "DEP_WITHDRAWALS",
             "CC_PERIOD_FULL", "CC_PERIOD_SHORT", "CC_PREVIOUS", "CC_PAYMENTS", "CC_PURCHASES", "CC_NEW",
             "CC_CASH", "CC_INTEREST", "CC_FEES", "UT_PREVIOUS", "UT_ELECTRICITY", "UT_EPP", "UT_DUE",
             "UT_BILL_DATE", "TC_INVOICE_DATE", "TC_DUE", "TC_PREVIOUS", "TC_INTERNET", "TC_GST", "TC_PST", "TC_PAGE"]


def _matches(text: str, patterns) -> Column:
    return sum((X.rx(text, getattr(V, p), 0).isNotNull().cast("int") for p in patterns), F.lit(0)).cast("int")


def _numbers_sql(text: str) -> str:
    return " + ".join(f"CAST(regexp_matches({text}, '{p}') AS INTEGER)" for p in _NUMBERS.values())


@query("x_negative_documents", f"""
SELECT doc_id, CAST(0 AS INTEGER) AS n_fields, CAST({_numbers_sql('text')} AS INTEGER) AS n_numbers FROM documents""")
def x_negative_documents(spark, sf):
    """Every pattern that is searched in page text, over every whole document text: no labelled one
    may match or fail, the plain numbers match where they stand."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", _matches("text", _ANCHORED).alias("n_fields"), _matches("text", _NUMBERS).alias("n_numbers"))


@query("x_negative_pages", f"""
SELECT page_id, CAST(0 AS INTEGER) AS n_fields, CAST({_numbers_sql('html')} AS INTEGER) AS n_numbers FROM pages""")
def x_negative_pages(spark, sf):
    """The same over every raw web page (whole HTML)."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", _matches("html", _ANCHORED).alias("n_fields"), _matches("html", _NUMBERS).alias("n_numbers"))


# =========================================================== P: page extractors
DEP_COLS = ["pn", "an", "sd", "ed", "ob", "cb", "td", "tw", "t", "v"]


def _deposit_oracle(vendor: str, base: str) -> str:
    return T.with_truth(base, T.deposit_truth(vendor)) + f"""
SELECT file, 0 AS page_idx, 1 AS pn, an, sd_d, sd_m, sd_y, ed_d, ed_m, ed_y,
  {_dbl('ob_x')} AS ob, {_dbl('cb_x')} AS cb, {_dbl('td_x')} AS td, {_dbl('tw_x')} AS tw,
  '{LITERALS['BANK_STATEMENT']}' AS t, '{LITERALS['RBC']}' AS v
FROM {vendor}_t
UNION ALL
SELECT file, 1, 2, an, sd_d, sd_m, sd_y, ed_d, ed_m, ed_y, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
  CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), '{LITERALS['BANK_STATEMENT']}', '{LITERALS['RBC']}'
FROM {vendor}_t WHERE NOT {T.F_PN}"""


@query("p_bank", _deposit_oracle("bank", T.BANK))
def p_bank(spark, sf):
    return records(spark, sf, ["bank"]).filter("kept").select("file", "page_idx", *flat(DEP_COLS))


@query("p_savings", _deposit_oracle("savings", T.SAVINGS))
def p_savings(spark, sf):
    return records(spark, sf, ["savings"]).filter("kept").select("file", "page_idx", *flat(DEP_COLS))


CC_COLS = ["pn", "is_info", "an", "sd", "ed", "pb", "tpc", "tpd", "nb", "ca", "ic", "f", "t", "v"]
_CC_T, _CC_V = LITERALS["CREDIT_CARD_STATEMENT"], LITERALS["RBC"]


@query("p_credit", T.with_truth(T.CREDIT) + f"""
SELECT file, 0 AS page_idx, 1 AS pn, FALSE AS is_info, an, sd_d, sd_m, sd_y, ed_d, ed_m, ed_y,
  {_dbl('pb')} AS pb, {_dbl('tpc')} AS tpc, {_dbl('tpd')} AS tpd, {_dbl('nb_x')} AS nb, {_dbl('ca_x')} AS ca,
  {_dbl('ic')} AS ic, {_dbl('f')} AS f, '{_CC_T}' AS t, '{_CC_V}' AS v
FROM credit_t
UNION ALL
SELECT file, 1, CAST(NULL AS INTEGER), TRUE, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{_CC_T}', '{_CC_V}'
FROM credit_t""")
def p_credit(spark, sf):
    return records(spark, sf, ["credit"]).select("file", "page_idx", *flat(CC_COLS))


UT_COLS = ["pn", "an", "bd", "pb", "nc", "eppd", "nb", "t", "v"]
_UT_T, _UT_V = LITERALS["BILL"], LITERALS["MB_HYDRO"]


@query("p_utility", T.with_truth(T.UTILITY) + f"""
SELECT file, 0 AS page_idx, 1 AS pn, an, bd_d, bd_m, bd_y, {_dbl('pb')} AS pb, {_dbl('nc_x')} AS nc,
  CASE WHEN epp > 0 THEN {_dbl('epp')} END AS eppd, {_dbl('nb_x')} AS nb, '{_UT_T}' AS t, '{_UT_V}' AS v
FROM utility_t
UNION ALL
SELECT file, 1, 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{_UT_T}', '{_UT_V}'
FROM utility_t""")
def p_utility(spark, sf):
    return records(spark, sf, ["utility"]).select("file", "page_idx", *flat(UT_COLS))


TC_COLS = ["pn", "an", "bd", "nb", "pb", "i", "gst", "pst", "t", "v"]
_TC_T, _TC_V = LITERALS["BILL"], LITERALS["BELL_MTS"]


@query("p_telecom", T.with_truth(T.TELECOM) + f"""
SELECT file, 0 AS page_idx, 1 AS pn, an, bd_d, bd_m, bd_y, {_dbl('nb_x')} AS nb,
  CAST(NULL AS DOUBLE) AS pb, CAST(NULL AS DOUBLE) AS i, CAST(NULL AS DOUBLE) AS gst, CAST(NULL AS DOUBLE) AS pst,
  '{_TC_T}' AS t, '{_TC_V}' AS v
FROM telecom_t
UNION ALL
SELECT file, 1, pn2, NULL, NULL, NULL, NULL, NULL,
  CASE WHEN pn2 = 2 THEN {_dbl('pb')} END, CASE WHEN pn2 = 2 THEN {_dbl('i_x')} END,
  CASE WHEN pn2 = 2 THEN {_dbl('gst')} END, CASE WHEN pn2 = 2 THEN {_dbl('pst')} END, '{_TC_T}', '{_TC_V}'
FROM telecom_t""")
def p_telecom(spark, sf):
    return records(spark, sf, ["telecom"]).select("file", "page_idx", *flat(TC_COLS))


@query("p_registry", T.ALL_TRUTH + """
SELECT 'bank' AS vendor, count(*) + count(*) FILTER (WHERE NOT (k % 29 = 7)) AS n_records FROM bank_t
UNION ALL SELECT 'savings', count(*) + count(*) FILTER (WHERE NOT (k % 29 = 7)) FROM savings_t
UNION ALL SELECT 'credit', 2 * count(*) FROM credit_t
UNION ALL SELECT 'utility', 2 * count(*) FROM utility_t
UNION ALL SELECT 'telecom', 2 * count(*) FROM telecom_t""")
def p_registry(spark, sf):
    """Every registered extractor over the union of all vendors' pages."""
    recs = records(spark, sf)
    return recs.filter("kept").groupBy("vendor").agg(F.count(F.lit(1)).alias("n_records"))


# =========================================================== V: rules
def _verdicts(spark, sf, vendors=None, extra=None):
    return R.file_verdicts(records(spark, sf, vendors), extra)


@query("bank_reconcile", T.with_truth(T.BANK, T.deposit_truth("bank")) + f"""
SELECT file, an AS account, {_dbl('ob_x')} AS opening, {_dbl('td_x')} AS deposits, {_dbl('tw_x')} AS withdrawals,
  {_dbl('cb_x')} AS closing,
  COALESCE(ob_x + td_x - tw_x = cb_x, FALSE) AS balanced,
  NOT (r_balance_mismatch OR r_missing_field OR r_page_count) AS ok
FROM bank_t""")
def bank_reconcile(spark, sf):
    """Flagship: chequing pages -> fields -> V1 -> one row per statement.

    File verdicts come from the hash aggregation over the page records
    (written once); the statement's page-0 fields join them one to one on
    (vendor, file), so neither side can be skewed."""
    from .build import build
    b = build(spark, sf, ["bank"])
    first = b.records.filter(c("page_idx") == 0).select(
        "vendor", "file", c("an").alias("account"),
        *[c(x).alias(n) for x, n in [("ob", "opening"), ("td", "deposits"), ("tw", "withdrawals"), ("cb", "closing")]])
    v = first.join(b.verdicts.select("vendor", "file", "ok"), ["vendor", "file"])
    bal = F.coalesce(c("opening") + c("deposits") - c("withdrawals") == c("closing"), F.lit(False))
    return v.select("file", "account", *[c(n).cast("double").alias(n) for n in
                                         ["opening", "deposits", "withdrawals", "closing"]],
                    bal.alias("balanced"), "ok")


def _vendor_verdict_oracle(vendor: str) -> str:
    return T.ALL_WITH_VERDICTS + f"""
SELECT file, reasons, reasons = '' AS ok FROM verdicts WHERE vendor = '{vendor}'"""


for _v, _name in [("bank", "v_bank"), ("savings", "v_savings"), ("credit", "v_credit"),
                  ("utility", "v_utility"), ("telecom", "v_telecom")]:
    def _mk(vendor):
        def fn(spark, sf):
            return _verdicts(spark, sf, [vendor]).select("file", "reasons", "ok")
        return fn
    query(_name, _vendor_verdict_oracle(_v))(_mk(_v))


@query("v_rejects_by_reason", T.ALL_WITH_VERDICTS + """
SELECT vendor, reason, count(*) AS n_files
FROM (SELECT vendor, unnest(string_split(reasons, ',')) AS reason FROM verdicts WHERE reasons <> '')
GROUP BY vendor, reason""")
def v_rejects_by_reason(spark, sf):
    return R.rejects_by_reason(_verdicts(spark, sf))


@query("v_required", T.ALL_WITH_VERDICTS + """
SELECT vendor, file FROM verdicts WHERE reasons LIKE '%missing_account%'""")
def v_required(spark, sf):
    """V5: files rejected for a required field (utility / telecom account)."""
    return _verdicts(spark, sf).filter(F.array_contains(F.split("reasons", ","), "missing_account")) \
        .select("vendor", "file")


@query("v_page_domain", T.ALL_WITH_VERDICTS + """
SELECT vendor, file FROM verdicts WHERE reasons LIKE '%page_domain%' OR reasons LIKE '%page_number%'""")
def v_page_domain(spark, sf):
    """V6/V7: page number missing, below 1 or outside the vendor's domain."""
    r = F.split("reasons", ",")
    return _verdicts(spark, sf).filter(F.array_contains(r, "page_domain") | F.array_contains(r, "page_number")) \
        .select("vendor", "file")


@query("v_page_count", T.ALL_TRUTH + """
SELECT 'bank' AS vendor, file, 2 AS n_pages, 1 AS n_records FROM bank_t WHERE k % 29 = 7
UNION ALL SELECT 'savings', file, 2, 1 FROM savings_t WHERE k % 29 = 7""")
def v_page_count(spark, sf):
    """V8: files whose record count differs from their page count."""
    return _verdicts(spark, sf).filter(c("n_records") != c("n_pages")) \
        .select("vendor", "file", c("n_pages").cast("int").alias("n_pages"),
                c("n_records").cast("int").alias("n_records"))


@query("v_nonempty", T.ALL_TRUTH + """
SELECT vendor, count(*) AS n_files, count(*) AS n_nonempty FROM (
  SELECT 'bank' AS vendor FROM bank_t UNION ALL SELECT 'savings' FROM savings_t
  UNION ALL SELECT 'credit' FROM credit_t UNION ALL SELECT 'utility' FROM utility_t
  UNION ALL SELECT 'telecom' FROM telecom_t) GROUP BY vendor""")
def v_nonempty(spark, sf):
    """V9: every file yields at least one record; counted per vendor."""
    v = _verdicts(spark, sf)
    return v.groupBy("vendor").agg(F.count(F.lit(1)).alias("n_files"),
                                   F.count_if(c("n_records") > 0).alias("n_nonempty"))
