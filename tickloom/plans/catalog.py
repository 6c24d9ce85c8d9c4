"""The registered queries of the market-panel engine and their SQL equivalents."""

from __future__ import annotations

from tickloom.plans import artifacts, ledger, models, prices, radar, reality, streams, validation  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Momentum radar of the regions' price series: their latest state, labelled and ranked."""
    from pyspark.sql import functions as F

    from tickloom.functions import rules
    from tickloom.operators import radar as X
    from tickloom.sources import bars as B

    bars = B.bars_from_trades(B.trades(spark, sf_dir, by="region"))
    rows = rules.apply(X.states(bars), rules.COMMON)
    return rows.select("symbol", "dt", "close", "return_1d", "return_5d", "return_20d", "rsi_14", "radar_momentum", "radar_score").orderBy(F.desc("radar_score"), "symbol")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
