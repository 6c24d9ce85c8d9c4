"""Registered queries next to their SQL equivalents on the smallest tables that all of them can use."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tickloom.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
#: One or two of each family; tests/compare.py runs all of them.
NAMES = [
    "s03_bars_from_trades", "s12_default_universe", "t01_returns", "t07_rsi", "t13_obv_trend", "t19_market_context", "p20_error_class", "w07_ranking", "o01_coverage", "t28_executions", "m14_w12_fold_ranges",
    "k01_bars_on_nyse_holidays", "k04_periods_between", "k09_closed_bar", "l06_state", "j12_l03_refresh_merge", "l07_chain_audit", "j10_k06_watch_comparison", "p21_feed_constraints", "st01_stream_bars", "st06_stream_dedup", "f08_reality_report",
    "o02_coverage_contract", "w09_views", "l08_chain_heads", "l10_watch_versions", "k06_watch_states", "f06_portfolio_gate",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, name):
    said = compare(spark, connect(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert said is None, said


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r.radar_momentum for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
