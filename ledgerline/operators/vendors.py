"""Page extractors: pages(vendor, file, page_idx, text) -> page records.

Each vendor is a chain of projections over its own pages. The first stages
search the page text once for each pattern and keep the short stretch that
matched (a match of its own text has the same groups); all groups, amounts
and dates are then taken from those stretches. The optimizer keeps the stages
apart, as a stretch is used more than once. The page text is dropped in the
extraction output: nothing wide ever reaches a shuffle.

Output columns: vendor, file, page_idx, the record fields of
``schema.RECORD_FIELDS``, ``kept`` (page yields a record), page-local reason
flags ``e_<reason>``, and the cross-page carry ``xp_total`` / ``xp_parts`` /
``xp_has_parts`` (telecom's page-2 check needs page 1's new balance).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rx as X
from ..functions.schema import INFO_PAGE, LITERALS, MONEY, RECORD_FIELDS

# ---------------------------------------------------------------------------
# Reject reason codes (sorted; reasons are reported in this order).
REASONS = ["balance_mismatch", "empty_file", "missing_account", "missing_bill_date",
           "missing_dates", "missing_field", "missing_new_balance", "page_count",
           "page_domain", "page_number", "unknown_vendor"]
PAGE_REASONS = [r for r in REASONS if r not in ("page_count", "empty_file")]

# Statement patterns, as the documents print them.
# Chequing and savings statements.
DEP_PAGE = r"(\d+)(\s+of\s+)(\d+)"
DEP_PERIOD = r"From\s+(\w+\s+\d+,\s+\d+)\s+to\s+(\w+\s+\d+,\s+\d+)"
DEP_DATE = r"(\w+)\s+(\d+),\s+(\d+)"
DEP_PERIOD_PARTS = r"From\s+(\w+)\s+(\d+),\s+(\d+)\s+to\s+(\w+)\s+(\d+),\s+(\d+)"  # the same period, part by part
DEP_ACCOUNT = r"Your\s+account\s+number:\s+(\d{5}-\d{7})"
DEP_OPENING = r"Your\s+opening\s+balance\D+\d{1,2}\D+\d{4}\D+([\d,]+\.\d{2})"
DEP_CLOSING = r"Your\s+closing\s+balance\D+\d{1,2}\D+\d{4}\D+([\d,]+\.\d{2})"
DEP_DEPOSITS = r"Total\s+deposits\D+([\d,]+\.\d{2})"
DEP_WITHDRAWALS = r"Total\s+withdrawals\D+([\d,]+\.\d{2})"
# Credit-card statements.
CC_PAGE = r"(\d+)(\s+OF\s+)(\d+)"
CC_PERIOD_FULL = r"FROM\s+(\w+\s+\d+,\s+\d+)\s+TO\s+(\w+\s+\d+,\s+\d+)"
CC_PERIOD_SHORT = r"FROM\s+(\w+\s+\d+)\s+TO\s+(\w+\s+\d+,\s+\d+)"
CC_DATE = r"(\w+)\s+(\d+),\s+(\d+)"
CC_START = r"(\w+)\s+(\d+)"
CC_PERIOD_PARTS = r"FROM\s+(\w+)\s+(\d+)(?:,\s+(\d+))?\s+TO\s+(\w+)\s+(\d+),\s+(\d+)"  # either period, part by part
CC_ACCOUNT = r"(\d{4}\D{1}\d{2}\D{8}\d{4})"
CC_PREVIOUS = r"Previous\s+(?:Account|Statement)\s+Balance\s+(-?)\$([\d,]+\.\d{2})"
CC_PAYMENTS = r"Payments\s+&\s+credits\s+(\-?)\$([\d,]+\.\d{2})"
CC_PURCHASES = r"Purchases\s+&\s+debits\s+(\-?)\$([\d,]+\.\d{2})"
CC_NEW = r"(?:Total\s+Account\s+Balance|NEW\s+BALANCE|CREDIT\s+BALANCE)\s+(\-?)\$([\d,]+\.\d{2})"
CC_CASH = r"Cash\s+advances\s+\$([\d,]+\.\d{2})"
CC_INTEREST = r"Interest\s+\$([\d,]+\.\d{2})"
CC_FEES = r"Fees\s+\$([\d,]+\.\d{2})"
# Electric utility bills.
UT_PAGE = r"(\d+) / (\d+)"
UT_PREVIOUS = r"Balance\s+forward\D+([\d,]+\.\d{2})\s?(CR)?"
UT_ELECTRICITY = r"Electricity\D+[\d,]+\.\d{2}\D+([\d,]+\.\d{2})"
UT_EPP = r"EPP\s+Diff\D+[\d,]+\.\d{2}\D+([\d,]+\.\d{2})\s?(CR)?"
UT_DUE = r"Amount due\D+([\d,]+\.\d{2})\s?(CR)?"
UT_ACCOUNT = r"(\d{7}\D{1}\d{7})"
UT_BILL_DATE = r"mission(\w{3})\W(\d{1,2})\D{5}(\d{4})"
UT_HISTORY = "Consumption history"
# Telecom bills.
TC_PAGE = r"Page (\d+) Of (\d+)"
TC_ACCOUNT = r"\D+(\d{9})\D+"
TC_INVOICE_DATE = r"\wnvoice Date (\w+) (\d{2}), (\d{4})"
TC_DUE = r"Amount Due\D+([\d,]+\.\d{2})\s?(Credit)?"
TC_PREVIOUS = r"(?:Sub-Total|Outstanding Balance)\D+([\d,]+\.\d{2})\s?(Credit)?"
TC_INTERNET = r"TOTAL INTERNET\D+([\d,]+\.\d{2})\s?(Credit)?"
TC_GST = r"GST \d\D+([\d,]+\.\d{2})\s?(Credit)?"
TC_PST = r"MB PST \d\D+([\d,]+\.\d{2})\s?(Credit)?"
# ---------------------------------------------------------------------------
# The same matches in time linear in the page. A printed pattern that starts with
# a run (digits, or anything but digits) is tried again from every place of it; the
# leftmost match starts at the run's first digit, and one character that is no digit
# before and after nine digits tells as much as a run of them.
DEP_PAGE_LINEAR = r"(?<!\d)(\d++)(\s+of\s+)(\d+)"
CC_PAGE_LINEAR = r"(?<!\d)(\d++)(\s+OF\s+)(\d+)"
UT_PAGE_LINEAR = r"(?<!\d)(\d++) / (\d+)"
TC_ACCOUNT_LINEAR = r"\D(\d{9})\D"

c = F.col


def _found(pattern: str, when: Column | None = None) -> Column:
    """The stretch of the page text that ``pattern`` matches first, '' if none (or not ``when``)."""
    m = F.regexp_extract(c("text"), "(?U)" + pattern, 0)
    return m if when is None else F.when(when, m).otherwise(F.lit(""))


def _page(pn: Column, n: int) -> Column:
    return F.coalesce(pn == n, F.lit(False))


def _any_null(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | c(n).isNull()
    return out


KEYS = ["vendor", "file", "page_idx"]


# ---------------------------------------------------------------- chequing / savings
def _deposit(df: DataFrame) -> DataFrame:
    first = c("page_idx") == 0
    s1 = df.select(
        *KEYS, _found(DEP_PAGE_LINEAR).alias("_page"), _found(DEP_PERIOD).alias("_period"), _found(DEP_ACCOUNT).alias("_account"),
        _found(DEP_OPENING, first).alias("_ob"), _found(DEP_CLOSING, first).alias("_cb"),
        _found(DEP_DEPOSITS, first).alias("_td"), _found(DEP_WITHDRAWALS, first).alias("_tw"))
    s2 = s1.select(
        *KEYS, X.page_number(c("_page"), DEP_PAGE).alias("pn"), X.account_number(c("_account"), DEP_ACCOUNT).alias("an"),
        X.period_parts(c("_period"), DEP_PERIOD_PARTS).alias("_parts"), X.money(c("_ob"), DEP_OPENING).alias("ob"),
        X.money(c("_cb"), DEP_CLOSING).alias("cb"), X.money(c("_td"), DEP_DEPOSITS).alias("td"),
        X.money(c("_tw"), DEP_WITHDRAWALS).alias("tw"))
    sd, ed = X.period_dates(c("_parts"))
    s3 = s2.select(*KEYS, "pn", "an", sd.alias("sd"), ed.alias("ed"), "ob", "cb", "td", "tw")
    kept = F.coalesce(c("pn") != 0, F.lit(False)) & c("sd").isNotNull() & c("ed").isNotNull()
    # A generator's output: a filter on it stays above the stages. Pushed below them it would hold
    # their patterns dozens of times, each searched again in the whole page.
    s4 = s3.select("*", F.explode(F.array(kept)).alias("kept"))
    money_page = c("kept") & first
    missing = money_page & _any_null("ob", "cb", "td", "tw")
    return s4.select(
        "*",
        missing.alias("e_missing_field"),
        F.coalesce(money_page & ~missing & ((c("ob") + c("td") - c("tw")) != c("cb")),
                   F.lit(False)).alias("e_balance_mismatch"),
    )


# ---------------------------------------------------------------- credit card
def _credit(df: DataFrame) -> DataFrame:
    s1 = df.select(
        *KEYS, "text", _found(CC_PAGE_LINEAR).alias("_page"), _found(CC_PERIOD_FULL).alias("_full"),
        _found(CC_PERIOD_SHORT).alias("_short"), _found(CC_ACCOUNT).alias("_account"))
    s2 = s1.withColumn("pn", X.page_number(c("_page"), CC_PAGE))
    p1 = _page(c("pn"), 1)
    amounts = {"pb": CC_PREVIOUS, "tpc": CC_PAYMENTS, "tpd": CC_PURCHASES, "nb": CC_NEW, "ca": CC_CASH, "ic": CC_INTEREST, "f": CC_FEES}
    # The start may lack its year, which is then the end's (X10). Of the two forms the full one counts if the page has it.
    period = F.when(c("_full") != "", c("_full")).otherwise(c("_short"))
    s3 = s2.select(*KEYS, "pn", X.period_parts(period, CC_PERIOD_PARTS).alias("_parts"), "_account",
                   *[_found(p, p1).alias("_" + n) for n, p in amounts.items()])
    sd, ed = X.period_dates(c("_parts"))
    signed = [X.signed_money(c("_" + n), amounts[n], "-").alias(n) for n in ("pb", "tpc", "tpd", "nb")]
    plain = [X.money(c("_" + n), amounts[n]).alias(n) for n in ("ca", "ic", "f")]
    s4 = s3.select(*KEYS, "pn", c("pn").isNull().alias("is_info"), sd.alias("_sd"), ed.alias("_ed"),
                   X.unmask(X.account_number(c("_account"), CC_ACCOUNT)).alias("_an"), *signed, *plain)
    own = ~c("is_info") & c("_sd").isNotNull() & c("_ed").isNotNull()
    s5 = s4.select(*KEYS, "pn", "is_info", F.when(own, c("_sd")).alias("sd"), F.when(own, c("_ed")).alias("ed"),
                   F.when(~c("is_info"), c("_an")).alias("an"), *amounts, F.lit(True).alias("kept"))
    missing = p1 & _any_null(*amounts)
    total = c("pb") + c("tpd") + c("tpc") + c("ca") + c("ic") + c("f")
    return s5.select(
        "*",
        (~c("is_info") & (c("sd").isNull() | c("ed").isNull())).alias("e_missing_dates"),
        missing.alias("e_missing_field"),
        F.coalesce(p1 & ~missing & (total != c("nb")), F.lit(False)).alias("e_balance_mismatch"),
    )


# ---------------------------------------------------------------- electric utility
def _utility(df: DataFrame) -> DataFrame:
    later = c("page_idx") != 0
    s1 = df.select(*KEYS, "text", _found(UT_PAGE_LINEAR, later).alias("_page"),
                   F.coalesce(F.contains("text", F.lit(UT_HISTORY)), F.lit(False)).alias("_history"))
    s2 = s1.withColumn("pn", F.when(later, X.page_number(c("_page"), UT_PAGE)).otherwise(F.lit(1)))
    p1, hist = _page(c("pn"), 1), c("_history")
    s3 = s2.select(
        *KEYS, "pn", "_history", _found(UT_PREVIOUS, p1).alias("_pb"), _found(UT_ELECTRICITY, p1).alias("_nc"),
        _found(UT_EPP, p1).alias("_ep"), _found(UT_DUE, p1).alias("_nb"), _found(UT_ACCOUNT, ~hist).alias("_an"),
        _found(UT_BILL_DATE, ~hist).alias("_bd"))
    s4 = s3.select(
        *KEYS, "pn", "_history", X.signed_money(c("_pb"), UT_PREVIOUS, "CR", 1, 2).alias("pb"),
        X.money(c("_nc"), UT_ELECTRICITY).alias("nc"),
        F.when(p1, X.default_zero(X.signed_money(c("_ep"), UT_EPP, "CR", 1, 2))).alias("_epp"),
        X.signed_money(c("_nb"), UT_DUE, "CR", 1, 2).alias("nb"), X.account_number(c("_an"), UT_ACCOUNT).alias("an"),
        X.date3(c("_bd"), UT_BILL_DATE).alias("bd"))
    missing = p1 & _any_null("pb", "nc", "nb")
    return s4.select(
        "*",
        F.when(c("_epp") > 0, c("_epp")).alias("eppd"),
        F.lit(True).alias("kept"),
        (c("pn").isNull() | (F.coalesce(c("pn"), F.lit(0)) < 1)).alias("e_page_number"),
        missing.alias("e_missing_field"),
        F.coalesce(p1 & ~missing & ((c("pb") + c("nc") + c("_epp")) != c("nb")),
                   F.lit(False)).alias("e_balance_mismatch"),
        (~hist & c("an").isNull()).alias("e_missing_account"),
        (~hist & c("bd").isNull()).alias("e_missing_bill_date"),
    ).drop("_history", "_epp")


# ---------------------------------------------------------------- telecom
def _telecom(df: DataFrame) -> DataFrame:
    later = c("page_idx") != 0
    s1 = df.select(*KEYS, "text", _found(TC_PAGE, later).alias("_page"))
    s2 = s1.withColumn("pn", F.when(later, X.page_number(c("_page"), TC_PAGE)).otherwise(F.lit(1)))
    p1, p2 = _page(c("pn"), 1), _page(c("pn"), 2)
    parts = {"pb": TC_PREVIOUS, "i": TC_INTERNET, "gst": TC_GST, "pst": TC_PST}
    s3 = s2.select(*KEYS, "pn", _found(TC_ACCOUNT_LINEAR, p1).alias("_an"), _found(TC_INVOICE_DATE, p1).alias("_bd"),
                   _found(TC_DUE, p1).alias("_nb"), *[_found(p, p2).alias("_" + n) for n, p in parts.items()])
    s4 = s3.select(
        *KEYS, "pn", X.account_number(c("_an"), TC_ACCOUNT_LINEAR).alias("an"), X.date3(c("_bd"), TC_INVOICE_DATE).alias("bd"),
        X.signed_money(c("_nb"), TC_DUE, "Credit", 1, 2).alias("nb"),
        *[X.signed_money(c("_" + n), p, "Credit", 1, 2).alias(n) for n, p in parts.items()])
    missing2 = p2 & _any_null(*parts)
    bad_pn = c("pn").isNull() | (F.coalesce(c("pn"), F.lit(0)) < 1)
    return s4.select(
        "*",
        F.lit(True).alias("kept"),
        bad_pn.alias("e_page_number"),
        (~bad_pn & ~c("pn").isin(1, 2)).alias("e_page_domain"),
        (p1 & c("an").isNull()).alias("e_missing_account"),
        (p1 & c("nb").isNull()).alias("e_missing_new_balance"),
        (p1 & c("bd").isNull()).alias("e_missing_bill_date"),
        missing2.alias("e_missing_field"),
        F.when(p1, c("nb")).alias("xp_total"),
        F.when(p2 & ~missing2, c("pb") + c("i") + c("gst") + c("pst")).cast(MONEY).alias("xp_parts"),
        (p2 & ~missing2).alias("xp_has_parts"),
    )


@dataclass
class Extractor:
    """Registry entry (P7-P9): vendor tag -> literals and a page-records function.

    ``fn`` takes the vendor's pages(vendor, file, page_idx, text) and returns
    page records; any DataFrame function may be registered. ``glob`` is the
    file pattern a folder source uses for this vendor (page-text files).
    ``row_per_page`` says that ``fn`` returns a row for each page by its form
    (projections only); of any other function the pages that it drops are
    put back as rows without a record, so that V8 and V9 see them.
    """
    tag: str
    doc_type: str
    vendor_name: str
    fn: Callable[[DataFrame], DataFrame]
    glob: str = "*.txt"
    row_per_page: bool = False


REGISTRY: dict[str, Extractor] = {
    "bank": Extractor("bank", LITERALS["BANK_STATEMENT"], LITERALS["RBC"], _deposit, row_per_page=True),
    "savings": Extractor("savings", LITERALS["BANK_STATEMENT"], LITERALS["RBC"], _deposit, row_per_page=True),
    "credit": Extractor("credit", LITERALS["CREDIT_CARD_STATEMENT"], LITERALS["RBC"], _credit, row_per_page=True),
    "utility": Extractor("utility", LITERALS["BILL"], LITERALS["MB_HYDRO"], _utility, row_per_page=True),
    "telecom": Extractor("telecom", LITERALS["BILL"], LITERALS["BELL_MTS"], _telecom, row_per_page=True),
}


def register(extractor: Extractor) -> None:
    """Add or replace a vendor extractor."""
    REGISTRY[extractor.tag] = extractor


OUT_COLUMNS = (["vendor", "file", "page_idx"] + [n for n, _ in RECORD_FIELDS]
               + ["kept"] + [f"e_{r}" for r in PAGE_REASONS]
               + ["xp_total", "xp_parts", "xp_has_parts"])


def _conform(df: DataFrame, ex: Extractor) -> DataFrame:
    """Fill the columns a vendor does not emit, stamp type/vendor literals, fix order."""
    # As SQL text: a column is then one call into the JVM.
    types = {n: t.simpleString() for n, t in RECORD_FIELDS}
    have, cols = set(df.columns), []
    for name in OUT_COLUMNS:
        if name in ("t", "v"):
            cols.append(F.lit(ex.doc_type if name == "t" else ex.vendor_name).alias(name))
            continue
        if name in have:
            value = f"CAST({name} AS {types[name]})" if name in types else name
        elif name == "is_info" or name == "xp_has_parts" or name.startswith("e_"):
            value = "FALSE"
        else:
            value = f"CAST(NULL AS {types.get(name, MONEY.simpleString())})"
        cols.append(F.expr(f"{value} AS {name}"))
    return df.select(*cols)


def extract_vendor(pages: DataFrame, tag: str) -> DataFrame:
    ex = REGISTRY[tag]
    own = pages.filter(F.col("vendor") == tag)
    recs = _conform(ex.fn(own), ex)
    if ex.row_per_page:
        return recs
    keys = ["vendor", "file", "page_idx"]
    dropped = own.select(*keys).join(recs.select(*keys), keys, "left_anti")
    return recs.unionByName(_conform(dropped.withColumn("kept", F.lit(False)), ex))


def unknown_vendor_pages(pages: DataFrame) -> DataFrame:
    """Pages whose vendor is NULL or not registered, as page rows without a record
    that reject their file for ``unknown_vendor``."""
    other = pages.filter(c("vendor").isNull() | ~c("vendor").isin(*REGISTRY))
    rows = other.select("vendor", "file", "page_idx", F.lit(False).alias("kept"), F.lit(True).alias("e_unknown_vendor"))
    return _conform(rows, Extractor("", "", "", lambda d: d)).withColumn("t", F.lit(None).cast("string")) \
        .withColumn("v", F.lit(None).cast("string"))


def extract_records(pages: DataFrame, vendors: list[str] | None = None) -> DataFrame:
    """All vendors' page records, one branch per vendor, unioned (narrow).

    Pages of no known vendor are rows too (not kept); a subset run leaves the
    other registered vendors' pages out, as asked."""
    out = unknown_vendor_pages(pages)
    for tag in vendors or list(REGISTRY):
        out = out.unionByName(extract_vendor(pages, tag))
    return out


def extract_with_pandas(pages: DataFrame, fn: Callable, tag: str, doc_type: str,
                        vendor_name: str) -> DataFrame:
    """P7 fallback for arbitrary Python extractors: ``fn(list[str]) -> list[dict]``.

    One file's pages go to one pandas group (``groupBy(file).applyInPandas``);
    a file is one document, so the group is bounded by what the source holds
    in one file. The result must have one record per page, as in the target
    format; records are conformed to the declared record schema.
    """
    import pandas as pd

    import json

    from pyspark.sql import types as T

    from ..functions.schema import RECORD_SCHEMA

    def per_file(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_idx")
        recs = list(fn(list(pdf["text"])))
        # One record per page, as the target format requires; any other count
        # keeps no record for the file, so V8 (page_count) rejects it.
        ok = len(recs) == len(pdf)
        return pd.DataFrame({
            "vendor": pdf["vendor"].values,
            "file": pdf["file"].values,
            "page_idx": pdf["page_idx"].values,
            "rec": [json.dumps(r, default=str) for r in recs] if ok else [None] * len(pdf),
        })

    out = pages.filter(F.col("vendor") == tag).groupBy("file").applyInPandas(
        per_file, "vendor string, file string, page_idx int, rec string")
    # The page number may be the text of an information page: it is read as text first.
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "pn" else f.dataType) for f in RECORD_SCHEMA.fields])
    parsed = out.select("vendor", "file", "page_idx", F.from_json("rec", as_text).alias("r"))
    df = parsed.select("vendor", "file", "page_idx", "r.*", F.col("r").isNotNull().alias("kept"))
    info = F.coalesce(c("is_info"), F.lit(False)) | F.coalesce(c("pn") == INFO_PAGE, F.lit(False))
    df = df.withColumn("is_info", info).withColumn("pn", c("pn").try_cast("int"))
    df = df.withColumn("e_page_number", c("kept") & ~c("is_info") & (F.coalesce(c("pn"), F.lit(0)) < 1))
    return _conform(df, Extractor(tag, doc_type, vendor_name, lambda d: d))
