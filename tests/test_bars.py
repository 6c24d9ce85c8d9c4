"""Bars of two hashed passes, as one row-by-row definition has them."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.sources import bars as B

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"


@pytest.fixture
def odd_trades(spark, tmp_path):
    """Orders on many days and of many symbols, equal and missing keys, days and prices, negative prices, rows that are there twice."""
    day = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = None if i % 97 == 0 else (i * 7919) % 400
        when = None if i % 89 == 0 else day + datetime.timedelta(days=(i * 31) % 9, hours=i % 24)
        price = None if i % 83 == 0 else -20.0 if i % 79 == 0 else 900.0 + (i * 37) % 1100 + i % 7 / 100
        rows.append((key, None if i % 101 == 0 else i % 4, i % 40, i % 10, float(1 + i % 50), price, when))
    rows += rows[::50]
    spark.createDataFrame(rows, LINE).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    brands = [(k, None if k == 39 else f"Brand#{11 + k % 7}") for k in range(40)]
    spark.createDataFrame(brands, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_bars_of_odd_trades(spark, odd_trades):
    found = B.bars_from_trades(B.trades(spark, odd_trades))
    wanted = B.trades(spark, odd_trades).groupBy("symbol", "dt").agg(
        F.min_by("px", "ord").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "ord").alias("close"), F.sum("volume").alias("volume")
    )
    as_text = [sorted(map(str, df.select(*wanted.columns).collect())) for df in (found, wanted)]
    assert as_text[0] == as_text[1]
    assert any("symbol=None" in r for r in as_text[0]) and any("dt=None" in r for r in as_text[0]) and any("nan" in r for r in as_text[0])


def test_trades_are_aggregated_without_a_sort(spark, odd_trades, monkeypatch):
    kept = []

    def stored(df, name, keep=B.stored):
        kept.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(B, "stored", stored)
    B.brand_bars(spark, odd_trades)
    days, whole = kept[0]
    assert days == "days" and "HashAggregate" in whole and "SortAggregate" not in whole
