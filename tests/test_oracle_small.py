"""Registered queries against their DuckDB oracle on the smallest tables."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF001

FAST = ["installment_rollup", "bureau_status_counts", "bureau_rollup", "txn_rollup", "hc_features",
        "lc_features", "cz_features", "gm_features", "score_from_prob", "tips_and_metrics", "roc_auc",
        "class_report", "split_assign", "source_counts", "default_rate_by_key"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["customer", "orders", "lineitem", "events", "part", "supplier", "nation", "region"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = df.columns
    got = sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == sorted(cols)
    idx = [ocols.index(c) for c in sorted(cols)]
    exp = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == exp


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "SK_ID_CURR"


def test_every_query_has_docs():
    qs = E.queries()
    assert len(qs) >= 45
    assert all(f.__doc__ for f in qs.values())
    assert set(E.oracle_sql()) <= set(qs)
