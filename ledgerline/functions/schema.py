"""Field registry, literal values and the declared record schema.

A page record is one wide, nullable struct: every field any vendor can emit,
NULL where a vendor or page does not emit it. JSON output drops NULL fields,
which gives back the sparse per-page documents of the target format.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They must equal the target format's, as written here.
# Logical field name -> short code used in the JSON targets and tags.
FIELD_CODES = {
    "pageNumber": "pn",
    "startDate": "sd",
    "endDate": "ed",
    "accountNumber": "an",
    "month": "m",
    "day": "d",
    "year": "y",
    "vendor": "v",
    "type": "t",
    "billDate": "bd",
    "prevBalance": "pb",
    "totalPayments": "tpc",
    "totalPurchases": "tpd",
    "newBalance": "nb",
    "openingBalance": "ob",
    "closingBalance": "cb",
    "totalWithdrawals": "tw",
    "totalDeposits": "td",
    "newCharges": "nc",
    "interestCharges": "ic",
    "cashAdvances": "ca",
    "fees": "f",
    "eppDiff": "eppd",
    "internet": "i",
    "gst": "gst",
    "pst": "pst",
}

# Document types and vendor names written into every record.
LITERALS = {
    "CREDIT_CARD_STATEMENT": "Credit Card Statement",
    "BANK_STATEMENT": "Bank Statement",
    "BILL": "Bill",
    "RBC": "RBC Royal Bank",
    "MB_HYDRO": "MB Hydro",
    "BELL_MTS": "Bell MTS",
}

# The task prompt and end/pad markers of the sequence format.
TASK_PROMPT = "<doc_intel>"
EOS_TOKEN = "</s>"
PAD_TOKEN = "<pad>"
INFO_PAGE = "info"
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)
DATE_STRUCT = T.StructType([
    T.StructField("d", T.IntegerType()),
    T.StructField("m", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
])

DATE_FIELDS = ["sd", "ed", "bd"]
MONEY_FIELDS = ["pb", "tpc", "tpd", "nb", "ob", "cb", "tw", "td", "nc", "ic",
                "ca", "f", "eppd", "i", "gst", "pst"]

# Record struct in code order; `pn` is an int with a separate info flag.
RECORD_FIELDS = (
    [("pn", T.IntegerType()), ("is_info", T.BooleanType()), ("an", T.StringType())]
    + [(c, DATE_STRUCT) for c in DATE_FIELDS]
    + [(c, MONEY) for c in MONEY_FIELDS]
    + [("t", T.StringType()), ("v", T.StringType())]
)
RECORD_SCHEMA = T.StructType([T.StructField(n, t) for n, t in RECORD_FIELDS])

PAGES_SCHEMA = T.StructType([
    T.StructField("vendor", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("page_idx", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

# The JSON target schema: what `gt_parse` holds. `pn` is a string there so
# that the info page can carry "info"; money is rendered as text.
GT_DATE = T.StructType([T.StructField(k, T.IntegerType()) for k in ("d", "m", "y")])
_GT_FIELDS = (
    [T.StructField("an", T.StringType())]
    + [T.StructField(c, GT_DATE) for c in DATE_FIELDS]
    + [T.StructField(c, T.StringType()) for c in MONEY_FIELDS]
    + [T.StructField("pn", T.StringType()), T.StructField("t", T.StringType()),
       T.StructField("v", T.StringType())]
)
GT_SCHEMA = T.StructType(sorted(_GT_FIELDS, key=lambda f: f.name))


def all_codes() -> list[str]:
    return list(FIELD_CODES.values())
