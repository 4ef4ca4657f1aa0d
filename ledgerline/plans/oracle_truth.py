"""Truth tables in DuckDB SQL, computed from the driver tables.

These CTEs state what every rendered statement says, straight from the base
tables and the planted-fault rules, so that the oracle for an extraction
query never repeats an extraction pattern.
"""

from __future__ import annotations

# Fault predicates on the account key k (must match sources.fixtures).
F_BAL = "(k % 17 = 3)"
F_ACCT = "(k % 23 = 5)"
F_PN = "(k % 29 = 7)"
F_DOM = "(k % 31 = 9)"
F_AMT = "(k % 37 = 11)"

D = "DECIMAL(18,2)"


def _sum_if(cond: str, val: str) -> str:
    return f"COALESCE(SUM(CASE WHEN {cond} THEN CAST({val} AS {D}) END), CAST(0 AS {D}))"


BANK = f"""
bank_base AS (
  SELECT c.c_custkey AS k, c.c_nationkey AS nat, CAST(c.c_acctbal AS {D}) AS ob, o.dep, o.wd, o.d0, o.d1
  FROM customer c JOIN (
    SELECT o_custkey, {_sum_if("o_orderstatus = 'F'", "o_totalprice")} AS dep,
           {_sum_if("o_orderstatus = 'O'", "o_totalprice")} AS wd,
           CAST(MIN(o_orderdate) AS DATE) AS d0, CAST(MAX(o_orderdate) AS DATE) AS d1
    FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
)"""

SAVINGS = f"""
savings_base AS (
  SELECT s.s_suppkey AS k, s.s_nationkey AS nat, CAST(s.s_acctbal AS {D}) AS ob, l.dep, l.wd, l.d0, l.d1
  FROM supplier s JOIN (
    SELECT l_suppkey, {_sum_if("l_linestatus = 'F'", "l_extendedprice")} AS dep,
           {_sum_if("TRUE", "l_quantity")} AS wd,
           CAST(MIN(l_shipdate) AS DATE) AS d0, CAST(MAX(l_shipdate) AS DATE) AS d1
    FROM lineitem GROUP BY l_suppkey) l ON s.s_suppkey = l.l_suppkey
)"""


def deposit_truth(vendor: str) -> str:
    """Per file what a chequing / savings statement prints and what the
    unsigned amount patterns read back (signs are not seen)."""
    return f"""
{vendor}_t AS (
  SELECT k, '{vendor}/' || CAST(k AS VARCHAR) || '.pdf' AS file,
    CASE WHEN NOT {F_ACCT} THEN lpad(CAST(nat AS VARCHAR), 5, '0') || '-' || lpad(CAST(k AS VARCHAR), 7, '0') END AS an,
    CAST(day(d0) AS INTEGER) AS sd_d, CAST(month(d0) AS INTEGER) AS sd_m, CAST(year(d0) AS INTEGER) AS sd_y,
    CAST(day(d1) AS INTEGER) AS ed_d, CAST(month(d1) AS INTEGER) AS ed_m, CAST(year(d1) AS INTEGER) AS ed_y,
    abs(ob) AS ob_x,
    abs(CAST(ob + dep - wd + CASE WHEN {F_BAL} THEN 0.01 ELSE 0 END AS {D})) AS cb_x,
    CASE WHEN NOT {F_AMT} THEN dep END AS td_x, wd AS tw_x,
    ob, dep, wd, CAST(ob + dep - wd AS {D}) AS closing,
    {F_AMT} AS r_missing_field,
    (NOT {F_AMT}) AND (abs(ob) + dep - wd <> abs(CAST(ob + dep - wd + CASE WHEN {F_BAL} THEN 0.01 ELSE 0 END AS {D}))) AS r_balance_mismatch,
    {F_PN} AS r_page_count
  FROM {vendor}_base
)"""


CREDIT = f"""
credit_base AS (
  SELECT user_id AS k,
    {_sum_if("event_type = 'view'", "value")} AS pb,
    -{_sum_if("event_type = 'click'", "value")} AS tpc,
    {_sum_if("event_type = 'purchase'", "value")} AS tpd,
    {_sum_if("event_type = 'signup'", "value")} AS ca,
    {_sum_if("event_type = 'error'", "value")} AS ic,
    CAST(MIN(ts) AS DATE) - INTERVAL 10 DAY AS d0, CAST(MAX(ts) AS DATE) AS d1
  FROM events GROUP BY user_id
),
credit_t AS (
  SELECT k, 'credit/' || CAST(k AS VARCHAR) || '.pdf' AS file,
    CASE WHEN NOT {F_ACCT} THEN '4512' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS an,
    CAST(day(d0) AS INTEGER) AS sd_d, CAST(month(d0) AS INTEGER) AS sd_m,
    CAST(CASE WHEN k % 2 = 1 THEN year(d1) ELSE year(d0) END AS INTEGER) AS sd_y,
    CAST(day(d1) AS INTEGER) AS ed_d, CAST(month(d1) AS INTEGER) AS ed_m, CAST(year(d1) AS INTEGER) AS ed_y,
    pb, tpc, tpd, CASE WHEN NOT {F_AMT} THEN ca END AS ca_x, ca, ic, CAST(0 AS {D}) AS f,
    CAST(pb + tpc + tpd + ca + ic + CASE WHEN {F_BAL} THEN 0.01 ELSE 0 END AS {D}) AS nb_x,
    {F_AMT} AS r_missing_field,
    (NOT {F_AMT}) AND {F_BAL} AS r_balance_mismatch
  FROM credit_base
)"""

UTILITY = f"""
utility_base AS (
  SELECT l_orderkey AS k,
    {_sum_if("l_returnflag = 'N'", "l_extendedprice")} AS pb_abs,
    {_sum_if("l_returnflag = 'A'", "l_extendedprice")} AS nc,
    COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_r,
    {_sum_if("l_returnflag = 'R'", "l_quantity")} AS epp_abs,
    CAST(MAX(l_shipdate) AS DATE) AS bd
  FROM lineitem GROUP BY l_orderkey
),
utility_t AS (
  SELECT k, 'utility/' || CAST(k AS VARCHAR) || '.pdf' AS file,
    CASE WHEN NOT {F_ACCT} THEN lpad(CAST(k % 10000000 AS VARCHAR), 7, '0') || lpad(CAST((k * 7 + 3) % 10000000 AS VARCHAR), 7, '0') END AS an,
    CAST(day(bd) AS INTEGER) AS bd_d, CAST(month(bd) AS INTEGER) AS bd_m, CAST(year(bd) AS INTEGER) AS bd_y,
    CASE WHEN k % 2 = 1 THEN -pb_abs ELSE pb_abs END AS pb,
    CASE WHEN NOT {F_AMT} THEN nc END AS nc_x, nc,
    CASE WHEN k % 3 = 0 THEN -epp_abs ELSE epp_abs END AS epp,
    CAST((CASE WHEN k % 2 = 1 THEN -pb_abs ELSE pb_abs END) + nc + (CASE WHEN k % 3 = 0 THEN -epp_abs ELSE epp_abs END)
         + CASE WHEN {F_BAL} THEN 0.01 ELSE 0 END AS {D}) AS nb_x,
    {F_ACCT} AS r_missing_account, {F_AMT} AS r_missing_field,
    (NOT {F_AMT}) AND {F_BAL} AS r_balance_mismatch
  FROM utility_base
)"""

TELECOM = f"""
telecom_base AS (
  SELECT l_suppkey AS k,
    {_sum_if("l_returnflag = 'A'", "l_quantity")} AS pb_abs,
    {_sum_if("l_returnflag = 'N'", "l_extendedprice")} AS i,
    {_sum_if("l_returnflag = 'N'", "l_quantity")} AS gst,
    {_sum_if("l_returnflag = 'R'", "l_quantity")} AS pst,
    CAST(MAX(l_shipdate) AS DATE) AS bd
  FROM lineitem GROUP BY l_suppkey
),
telecom_t AS (
  SELECT k, 'telecom/' || CAST(k AS VARCHAR) || '.pdf' AS file,
    CASE WHEN NOT {F_ACCT} THEN CAST(100000000 + k AS VARCHAR) END AS an,
    CAST(day(bd) AS INTEGER) AS bd_d, CAST(month(bd) AS INTEGER) AS bd_m, CAST(year(bd) AS INTEGER) AS bd_y,
    CASE WHEN k % 2 = 0 THEN -pb_abs ELSE pb_abs END AS pb,
    CASE WHEN NOT {F_AMT} THEN i END AS i_x, i, gst, pst,
    CASE WHEN {F_DOM} THEN 3 ELSE 2 END AS pn2,
    CAST((CASE WHEN k % 2 = 0 THEN -pb_abs ELSE pb_abs END) + i + gst + pst
         + CASE WHEN {F_BAL} THEN 0.01 ELSE 0 END AS {D}) AS nb_x,
    {F_ACCT} AS r_missing_account, {F_DOM} AS r_page_domain,
    (NOT {F_DOM}) AND {F_AMT} AS r_missing_field,
    (NOT {F_DOM}) AND (NOT {F_AMT}) AND {F_BAL} AS r_balance_mismatch
  FROM telecom_base
)"""


def with_truth(*parts: str) -> str:
    return "WITH " + ",".join(parts)


ALL_TRUTH = with_truth(BANK, deposit_truth("bank"), SAVINGS, deposit_truth("savings"), CREDIT, UTILITY, TELECOM)


def reasons_sql(*flags: str) -> str:
    """concat_ws over CASE, in code order; flags are r_<reason> column names."""
    parts = [f"CASE WHEN r_{f} THEN '{f}' END" for f in sorted(flags)]
    return "concat_ws(',', " + ", ".join(parts) + ")"


VERDICT_SQL = f"""
verdicts AS MATERIALIZED (
  SELECT 'bank' AS vendor, file, {reasons_sql('balance_mismatch', 'missing_field', 'page_count')} AS reasons FROM bank_t
  UNION ALL
  SELECT 'savings', file, {reasons_sql('balance_mismatch', 'missing_field', 'page_count')} FROM savings_t
  UNION ALL
  SELECT 'credit', file, {reasons_sql('balance_mismatch', 'missing_field')} FROM credit_t
  UNION ALL
  SELECT 'utility', file, {reasons_sql('balance_mismatch', 'missing_account', 'missing_field')} FROM utility_t
  UNION ALL
  SELECT 'telecom', file, {reasons_sql('balance_mismatch', 'missing_account', 'missing_field', 'page_domain')} FROM telecom_t
)"""

ALL_WITH_VERDICTS = ALL_TRUTH + "," + VERDICT_SQL


# ----------------------------------------------------------------- page records
_REC_COLS = ["pn", "is_info", "an", "sd_d", "sd_m", "sd_y", "ed_d", "ed_m", "ed_y", "bd_d", "bd_m", "bd_y",
             "pb", "tpc", "tpd", "nb", "ob", "cb", "tw", "td", "nc", "ic", "ca", "f", "eppd", "i", "gst", "pst"]
_INT = {"pn", "sd_d", "sd_m", "sd_y", "ed_d", "ed_m", "ed_y", "bd_d", "bd_m", "bd_y"}


def _rec(vendor: str, idx: int, t: str, v: str, kept: str, vals: dict[str, str], src: str) -> str:
    cols = []
    for n in _REC_COLS:
        if n == "is_info":
            cols.append(f"{vals.get(n, 'FALSE')} AS is_info")
        elif n == "an":
            cols.append(f"{vals.get(n, 'CAST(NULL AS VARCHAR)')} AS an")
        elif n in _INT:
            cols.append(f"CAST({vals.get(n, 'NULL')} AS INTEGER) AS {n}")
        else:
            cols.append(f"CAST({vals.get(n, 'NULL')} AS {D}) AS {n}")
    return (f"SELECT '{vendor}' AS vendor, file, k, {idx} AS page_idx, " + ", ".join(cols)
            + f", '{t}' AS t, '{v}' AS v, {kept} AS kept FROM {src}")


def _dates(*names: str) -> dict[str, str]:
    return {f"{n}_{p}": f"{n}_{p}" for n in names for p in "dmy"}


# The literals, field codes and markers of the format, in its order; and its length setting.
_BS, _CC, _BILL, _RBC, _MBH, _BELL = ("Bank Statement", "Credit Card Statement", "Bill", "RBC Royal Bank",
                                      "MB Hydro", "Bell MTS")
_CODES = ["pn", "sd", "ed", "an", "m", "d", "y", "v", "t", "bd", "pb", "tpc", "tpd", "nb", "ob", "cb", "tw", "td",
          "nc", "ic", "ca", "f", "eppd", "i", "gst", "pst"]
_LITERALS = [_CC, _BS, _BILL, _RBC, _MBH, _BELL]
GT_CODES = sorted(x for x in _CODES if x not in ("d", "m", "y"))

_VOCAB = [t for x in _CODES for t in (f"<s_{x}>", f"</s_{x}>")] + _LITERALS + ["<doc_intel>"]
_WITH_MARKERS = _VOCAB + ["<sep/>", "</s>", "<pad>", "<unk>"]
VOCAB_SQL = "[" + ", ".join(f"'{t}'" for t in _VOCAB) + "]"
# Tokens: tags, markers and literals whole, any other character by itself.
_ALL_SQL = "[" + ", ".join(f"'{t}'" for t in _WITH_MARKERS) + "]"
_WORDS = "|".join(sorted(_LITERALS + ["<doc_intel>", "<sep/>", "</s>", "<pad>", "<unk>"], key=len, reverse=True))
TOKENS_SQL = f"regexp_extract_all(seq || '</s>', '</?s_[A-Za-z0-9_]+>|{_WORDS}|<[^<>\\s]+/>|[\\s\\S]')"
LABEL_IDS_SQL = (f"list_transform({TOKENS_SQL}, lambda x: CASE WHEN list_position({_ALL_SQL}, x) IS NOT NULL "
                 f"THEN list_position({_ALL_SQL}, x) - 1 WHEN length(x) = 1 THEN 1000 + ascii(x) ELSE {len(_WITH_MARKERS) - 1} END)")


def _rec_union() -> str:
    parts = []
    for dv in ("bank", "savings"):
        parts.append(_rec(dv, 0, _BS, _RBC, "TRUE", {"pn": "1", "an": "an", **_dates("sd", "ed"), "ob": "ob_x",
                                                      "cb": "cb_x", "td": "td_x", "tw": "tw_x"}, f"{dv}_t"))
        parts.append(_rec(dv, 1, _BS, _RBC, f"NOT {F_PN}", {"pn": "2", "an": "an", **_dates("sd", "ed")}, f"{dv}_t"))
    parts.append(_rec("credit", 0, _CC, _RBC, "TRUE", {"pn": "1", "an": "an", **_dates("sd", "ed"), "pb": "pb",
                                                       "tpc": "tpc", "tpd": "tpd", "nb": "nb_x", "ca": "ca_x",
                                                       "ic": "ic", "f": "f"}, "credit_t"))
    parts.append(_rec("credit", 1, _CC, _RBC, "TRUE", {"is_info": "TRUE"}, "credit_t"))
    parts.append(_rec("utility", 0, _BILL, _MBH, "TRUE", {"pn": "1", "an": "an", **_dates("bd"), "pb": "pb",
                                                          "nc": "nc_x", "nb": "nb_x",
                                                          "eppd": "CASE WHEN epp > 0 THEN epp END"}, "utility_t"))
    parts.append(_rec("utility", 1, _BILL, _MBH, "TRUE", {"pn": "2"}, "utility_t"))
    parts.append(_rec("telecom", 0, _BILL, _BELL, "TRUE", {"pn": "1", "an": "an", **_dates("bd"), "nb": "nb_x"},
                      "telecom_t"))
    parts.append(_rec("telecom", 1, _BILL, _BELL, "TRUE",
                      {"pn": "pn2", "pb": "CASE WHEN pn2 = 2 THEN pb END", "i": "CASE WHEN pn2 = 2 THEN i_x END",
                       "gst": "CASE WHEN pn2 = 2 THEN gst END", "pst": "CASE WHEN pn2 = 2 THEN pst END"}, "telecom_t"))
    return "\nUNION ALL\n".join(parts)


# Leaf fields of gt_parse in code order: (path, SQL text of the value).
GT_LEAVES = []
for _n in GT_CODES:
    if _n in ("bd", "ed", "sd"):
        GT_LEAVES += [(f"{_n}.{p}", f"CAST({_n}_{p} AS VARCHAR)") for p in "dmy"]
    elif _n == "pn":
        GT_LEAVES.append(("pn", "CASE WHEN is_info THEN 'info' ELSE CAST(pn AS VARCHAR) END"))
    elif _n in ("an", "t", "v"):
        GT_LEAVES.append((_n, _n))
    else:
        GT_LEAVES.append((_n, f"CAST({_n} AS VARCHAR)"))


def _seq_sql() -> str:
    parts = []
    for n in GT_CODES:
        if n in ("bd", "ed", "sd"):
            inner = " || ".join(f"'<s_{p}>' || CAST({n}_{p} AS VARCHAR) || '</s_{p}>'" for p in "dmy")
            parts.append(f"COALESCE('<s_{n}>' || {inner} || '</s_{n}>', '')")
        else:
            val = dict(GT_LEAVES)[n]
            parts.append(f"COALESCE('<s_{n}>' || {val} || '</s_{n}>', '')")
    return " || ".join(parts)


def _doc_key(file: str = "file", idx: str = "page_idx") -> str:
    return f"CAST(('0x' || substr(md5({file} || '#' || CAST({idx} AS VARCHAR)), 1, 8)) AS BIGINT)"


RECORDS_SQL = f"""
rec_t AS MATERIALIZED (
{_rec_union()}
),
targets AS MATERIALIZED (
  SELECT r.*, {_seq_sql()} AS seq, {_doc_key()} AS doc_key,
    CASE WHEN {_doc_key()} % 100 < 80 THEN 'train' ELSE 'validation' END AS split
  FROM rec_t r JOIN verdicts USING (vendor, file) WHERE r.kept AND verdicts.reasons = ''
)"""

ALL_WITH_TARGETS = ALL_WITH_VERDICTS + "," + RECORDS_SQL

# Fixed values of the prediction fixture: epochs, batch size, corruption rules.
EPOCHS = 6
BATCH = 3

PRED_SQL = f"""
val AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY doc_key, file, page_idx) - 1 AS idx FROM targets WHERE split = 'validation'
),
preds AS MATERIALIZED (
  SELECT e.epoch, CAST(floor(idx / {BATCH}) AS BIGINT) AS batch, val.*,
    '<doc_intel>' || (CASE WHEN doc_key % 3 = 0 THEN replace(s2, '>', '> ') ELSE s2 END) || '</s>' || '<pad>' AS raw,
    (doc_key % (e.epoch + 2) = 0) AS c7, (doc_key % 7 = 0) AS ctw
  FROM val, (SELECT range AS epoch FROM range({EPOCHS})) e,
  LATERAL (SELECT CASE WHEN doc_key % 7 = 0 THEN regexp_replace(s1, '<s_tw>.*?</s_tw>', '') ELSE s1 END AS s2
           FROM (SELECT CASE WHEN doc_key % (e.epoch + 2) = 0 THEN translate(seq, '7', '1') ELSE seq END AS s1))
),
scores AS MATERIALIZED (
  SELECT epoch, batch, idx, file, page_idx, vendor, t, doc_key,
    CASE WHEN greatest(length(pc), length(seq)) = 0 THEN 0.0
         ELSE CAST(levenshtein(pc, seq) AS DOUBLE) / greatest(length(pc), length(seq)) END AS score
  FROM (SELECT *, replace(replace(regexp_replace(regexp_replace(replace(replace(raw, '</s>', ''), '<pad>', ''),
          '<.*?>', ''), '^\\s+|\\s+$', '', 'g'), '> ', '>'), ' </s_', '</s_') AS pc FROM preds)
)"""

ALL_WITH_PREDS = ALL_WITH_TARGETS + "," + PRED_SQL


def leaf_kinds_sql() -> str:
    """Per prediction row and leaf: 'match' / 'changed' / 'missing', from the corruption rules."""
    parts = []
    for path, val in GT_LEAVES:
        if path == "tw":
            kind = f"CASE WHEN ctw THEN 'missing' WHEN c7 AND {val} LIKE '%7%' THEN 'changed' ELSE 'match' END"
        else:
            kind = f"CASE WHEN c7 AND {val} LIKE '%7%' THEN 'changed' ELSE 'match' END"
        parts.append(f"SELECT epoch, file, page_idx, t, '{path}' AS path, {kind} AS kind FROM preds WHERE {val} IS NOT NULL")
    return "leaf_kinds AS (\n" + "\nUNION ALL\n".join(parts) + "\n)"
