"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pitloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
# regressions on six and three factors: on all 24 no month of these tables has as many rows as coefficients
CHOSEN = ("calendar_table", "monthly_universe", "asof_join", "statement_pit_inc", "rank_ic_summary", "spread_summary", "pre_chain", "upsert_by_month", "replace_by_month", "incremental_ingest", "missing_factor_months", "redundancy_six", "redundancy_many", "fama_macbeth_six", "fama_macbeth_many", "subperiod_summary", "robustness_summary", "leaderboard_top_robustness", "leaderboard_top_subperiods", "factor_corr_matrix", "factor_amihud_illiquidity_raw", "factor_panel")


@pytest.fixture(scope="module")
def sql():
    return entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query(sql):
    assert not sql.keys() - entry.queries().keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, con, sql, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(sql[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    text = lambda r: str([f"{x:.5g}" if isinstance(x, float) else x for x in r])
    want = sorted(([r[columns.index(c)] for c in sorted(columns)] for r in found.fetchall()), key=text)
    got = sorted(([r[c] for c in sorted(columns)] for r in df.collect()), key=text)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for x, y in zip(a, b, strict=True)), (a, b)
