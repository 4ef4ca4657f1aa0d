import math
from collections import Counter

import duckdb

import __spark_entry__ as E
from ledgerline.sources.tables import TABLES

from .conftest import SF_SMALL

FAST = ["bank_reconcile", "x_money", "x_date_shared_year", "p_credit", "p_telecom", "v_utility",
        "v_rejects_by_reason", "t_linearise_props", "c_state_diff"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 150
    assert sum(1 for r in rows if r["balanced"]) > 0


def test_every_query_has_oracle_or_is_listed():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


def test_fast_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in FAST:
        df = E.queries()[name](spark, SF_SMALL)
        cur = con.execute(E.oracle_sql()[name])
        ocols = [d[0] for d in cur.description]
        assert sorted(ocols) == sorted(df.columns), name
        order = [ocols.index(c) for c in df.columns]
        orows = Counter(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())
        srows = Counter(tuple(_norm(x) for x in r) for r in df.collect())
        assert srows == orows, name
