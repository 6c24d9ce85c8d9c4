"""Queries over bars: sources, features, labels, snapshots, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import r6 as R
from tickloom.operators import features as X
from tickloom.plans.registry import query
from tickloom.plans.sqltext import W, guard, r6, sql
from tickloom.sources import bars as B

OHLCV = ["open", "high", "low", "close", "volume"]
K = "symbol, dt"


def cols(**exprs: str) -> str:
    return ", ".join(r6(e, n) for n, e in exprs.items())


@query(sql(f"SELECT {K}, {', '.join(OHLCV)} FROM bars", "bars"))
def s03_bars_from_trades(spark, sf):
    return B.brand_bars(spark, sf).select("symbol", "dt", *OHLCV)


RAW = """SELECT symbol, dt, px AS close, row_number() OVER (PARTITION BY symbol, dt ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, volume) AS seq FROM ticks"""


@query(
    sql(
        f"""SELECT symbol, dt, close FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol, dt ORDER BY seq DESC) AS r
    FROM ({RAW}) WHERE close IS NOT NULL) WHERE r = 1) WHERE n >= 1000""",
        "ticks",
    )
)
def s01_clean_bars(spark, sf):
    ticks = B.trades(spark, sf)
    raw = ticks.select("symbol", "dt", F.col("px").alias("close"), F.col("ord").alias("seq"))
    good, _ = B.clean_bars(raw, "seq", 1000)
    return good.select("symbol", "dt", "close")


@query(sql("SELECT symbol, count(*) AS n_bars, 'TOO_FEW_BARS' AS code FROM bars GROUP BY symbol HAVING count(*) < 1000", "bars"))
def s01_rejected_symbols(spark, sf):
    bars = B.brand_bars(spark, sf)
    _, errors = B.clean_bars(bars.withColumn("seq", F.col("volume")), "seq", 1000)
    return errors.select("symbol", "n_bars", "code")


@query(sql("SELECT symbol, dt, close FROM bars WHERE dt >= (SELECT max(dt) FROM bars) - 770", "bars"))
def s02_history_window(spark, sf):
    bars = B.brand_bars(spark, sf)
    last = bars.agg(F.max("dt").alias("last"))  # one row
    return B.history_window(bars.crossJoin(F.broadcast(last)), F.col("last"), 2).select("symbol", "dt", "close")


@query(sql("SELECT symbol, count(*) AS n_rows, min(dt) AS first_dt, max(dt) AS last_dt FROM bars GROUP BY symbol", "bars"))
def s06_history_metadata(spark, sf):
    return B.history_metadata(B.brand_bars(spark, sf))


@query(
    sql(
        """SELECT symbol, min(pos) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos, symbol) AS r
    FROM (SELECT symbol, p_type AS category, min(p_partkey) AS pos FROM brands GROUP BY symbol, p_type)) WHERE r <= 2 GROUP BY symbol""",
        "brands",
    )
)
def s12_default_universe(spark, sf):
    return B.default_universe(B.instruments(spark, sf), 2)


@query(sql("SELECT symbol, ann FROM anns", "anns"))
def t21_annualization(spark, sf):
    return X.annualization(B.brand_bars(spark, sf))


def _base(spark, sf):
    return X.base(B.brand_bars(spark, sf))


def _out(df, names):
    return X.rounded(df, ["symbol", "dt"], names)


@query(sql(f"SELECT {K}, {cols(**{f'ret_{n}': f'ln(close / lag(close, {n}) OVER {W})' for n in X.RETURNS})} FROM base", "base"))
def t01_returns(spark, sf):
    return _out(X.returns(_base(spark, sf)), [f"ret_{n}" for n in X.RETURNS])


def _vols(kind):
    out = {}
    for n in X.VOLS:
        std = guard("stddev_samp(lr)", "lr", n)
        if kind == "vol":
            out[f"vol_{n}"] = f"{std} * sqrt(ann)"
        elif kind == "down":
            out[f"downside_vol_{n}"] = guard("stddev_samp(dlr)", "lr", n) + " * sqrt(ann)"
        else:
            out[f"realized_sharpe_{n}"] = f"{guard('avg(lr)', 'lr', n)} / nullif({std}, 0) * sqrt(ann)"
    return out


@query(sql(f"SELECT {K}, {cols(**_vols('vol'))} FROM base", "base"))
def t02_rolling_vol(spark, sf):
    return _out(X.volatility(_base(spark, sf)), list(_vols("vol")))


@query(sql(f"SELECT {K}, {cols(**_vols('down'))} FROM base", "base"))
def t03_downside_vol(spark, sf):
    return _out(X.volatility(_base(spark, sf)), list(_vols("down")))


@query(sql(f"SELECT {K}, {cols(**_vols('sharpe'))} FROM base", "base"))
def t04_realized_sharpe(spark, sf):
    return _out(X.volatility(_base(spark, sf)), list(_vols("sharpe")))


@query(sql(f"SELECT {K}, {cols(**{f'tail_ratio_{n}': guard('quantile_cont(lr, 0.95)', 'lr', n) + ' / nullif(-' + guard('quantile_cont(lr, 0.05)', 'lr', n) + ', 0)' for n in (5, 20)})} FROM base", "base"))
def t05_tail_ratio(spark, sf):
    return _out(X.tail_ratios(_base(spark, sf), (5, 20)), ["tail_ratio_5", "tail_ratio_20"])


@query(sql(f"SELECT {K}, {cols(**{f'ma_dist_{n}': 'close / ' + guard('avg(close)', 'close', n) + ' - 1' for n in X.AVERAGES})} FROM base", "base"))
def t06_average_distance(spark, sf):
    return _out(X.average_distances(_base(spark, sf)), [f"ma_dist_{n}" for n in X.AVERAGES])


@query(sql(f"SELECT {K}, {cols(rsi_14='rsi_14', rsi_velocity=f'rsi_14 - lag(rsi_14, 5) OVER {W}')} FROM osc", "osc"))
def t07_rsi(spark, sf):
    return _out(X.oscillators(_base(spark, sf)), ["rsi_14", "rsi_velocity"])


@query(sql(f"SELECT {K}, {cols(macd='macd', macd_signal='macd_signal')} FROM osc", "osc"))
def t08_macd(spark, sf):
    return _out(X.oscillators(_base(spark, sf)), ["macd", "macd_signal"])


@query(sql(f"SELECT {K}, {cols(bollinger_z='(close - ' + guard('avg(close)', 'close', 20) + ') / nullif(' + guard('stddev_samp(close)', 'close', 20) + ', 0)')} FROM base", "base"))
def t09_bollinger(spark, sf):
    return _out(X.bollinger(_base(spark, sf)), ["bollinger_z"])


@query(sql(f"SELECT {K}, {cols(atr_pct='atr_pct')} FROM osc", "osc"))
def t10_atr(spark, sf):
    return _out(X.oscillators(_base(spark, sf)), ["atr_pct"])


LOW14, HIGH14 = guard("min(low)", "low", 14), guard("max(high)", "high", 14)


@query(sql(f"SELECT {K}, {cols(stochastic=f'(close - {LOW14}) / nullif({HIGH14} - {LOW14}, 0) - 0.5')} FROM base", "base"))
def t11_stochastic(spark, sf):
    return _out(X.stochastic(_base(spark, sf)), ["stochastic"])


LOGV = "(SELECT *, ln(1 + volume) AS logv FROM base)"
V5, V20, VS = guard("avg(logv)", "logv", 5), guard("avg(logv)", "logv", 20), guard("stddev_samp(logv)", "logv", 20)


@query(sql(f"SELECT {K}, {cols(volume_z20=f'(logv - {V20}) / nullif({VS}, 0)', volume_change=f'logv - lag(logv, 5) OVER {W}', volume_trend_20=f'{V5} / nullif({V20}, 0) - 1')} FROM {LOGV}", "base"))
def t12_volume(spark, sf):
    return _out(X.volume_features(_base(spark, sf)), ["volume_z20", "volume_change", "volume_trend_20"])


@query(
    sql(
        f"SELECT {K}, {cols(obv_trend=f'(obv - lag(obv, 20) OVER {W}) / nullif(' + guard('sum(volume)', 'volume', 20) + ', 0)')} FROM "
        "(SELECT *, sum(coalesce(sign(close - prev), 0) * volume) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS obv FROM base)",
        "base",
    )
)
def t13_obv_trend(spark, sf):
    return _out(X.obv_trend(_base(spark, sf)), ["obv_trend"])


@query(sql(f"SELECT {K}, {cols(range_pct='(high - low) / close', gap='open / prev - 1')} FROM base", "base"))
def t14_range_gap(spark, sf):
    return _out(X.range_and_gap(_base(spark, sf)), ["range_pct", "gap"])


def _ret(n):
    return f"ln(close / lag(close, {n}) OVER {W})"


@query(
    sql(
        "SELECT " + K + ", "
        + cols(
            momentum_acceleration=f"{_ret(5)} - {_ret(20)} / 4",
            trend_strength_50_200=f"(close / {guard('avg(close)', 'close', 50)} - 1) - (close / {guard('avg(close)', 'close', 200)} - 1)",
            price_volume_pressure=f"{_ret(5)} * ((logv - {V20}) / nullif({VS}, 0))",
            volatility_ratio=f"{guard('stddev_samp(lr)', 'lr', 10)} / nullif({guard('stddev_samp(lr)', 'lr', 60)}, 0)",
        )
        + f" FROM {LOGV}",
        "base",
    )
)
def t15_combos(spark, sf):
    b = X.combos(X.volume_features(X.average_distances(X.volatility(X.returns(_base(spark, sf))))))
    return _out(b, ["momentum_acceleration", "trend_strength_50_200", "price_volume_pressure", "volatility_ratio"])


@query(sql(f"SELECT {K}, {cols(skew_20=guard('skewness(lr)', 'lr', 20), skew_60=guard('skewness(lr)', 'lr', 60))} FROM base", "base"))
def t16_skew(spark, sf):
    return _out(X.skews(_base(spark, sf)), ["skew_20", "skew_60"])


@query(sql(f"SELECT {K}, {cols(**{f'drawdown_{n}': 'close / ' + guard('max(close)', 'close', n) + ' - 1' for n in (60, 252)})} FROM base", "base"))
def t17_drawdown(spark, sf):
    return _out(X.drawdowns(_base(spark, sf)), ["drawdown_60", "drawdown_252"])


def _ranges():
    out = {}
    for n in X.RANGES:
        low, high = guard("min(close)", "close", n), guard("max(close)", "close", n)
        out |= {f"range_position_{n}": f"(close - {low}) / nullif({high} - {low}, 0)", f"breakout_distance_{n}": f"close / {high} - 1", f"panic_distance_{n}": f"close / {low} - 1"}
    return out


@query(sql(f"SELECT {K}, {cols(**_ranges())} FROM base", "base"))
def t18_range_position(spark, sf):
    return _out(X.range_positions(_base(spark, sf)), list(_ranges()))


BENCH = "CASE WHEN b.symbol = 'B15-USD' THEN NULL WHEN b.symbol LIKE '%-USD' THEN 'B15-USD' WHEN b.symbol LIKE '%.WA' THEN 'B11.WA' ELSE '^B13' END"
CTX = f"""(SELECT *, ln(mc / lag(mc) OVER {W}) AS mr FROM (SELECT b.*, last_value(m.close IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.dt ROWS UNBOUNDED PRECEDING) AS mc
 FROM base b LEFT JOIN bars m ON m.symbol = {BENCH} AND m.dt = b.dt))"""


def _market():
    out = {}
    for n in X.CONTEXT:
        out[f"market_ret_{n}"] = f"ln(mc / lag(mc, {n}) OVER {W})"
        out[f"relative_strength_{n}"] = f"{_ret(n)} - ln(mc / lag(mc, {n}) OVER {W})"
    out["market_vol_20"] = guard("stddev_samp(mr)", "mr", 20) + " * sqrt(ann)"
    return out


@query(sql(f"SELECT {K}, {cols(**_market())} FROM {CTX}", "base"))
def t19_market_context(spark, sf):
    b = X.context_features(_base(spark, sf), B.brand_bars(spark, sf), B.benchmark_of)
    return _out(b, list(_market()))


F60 = "(PARTITION BY symbol ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(
    sql(
        f"""SELECT {K}, {cols(
            market_beta_60=f"CASE WHEN count(mr) OVER {F60} = 60 THEN covar_samp(lr, mr) OVER {F60} / nullif(var_samp(mr) OVER {F60}, 0) END",
            market_corr_60=f"CASE WHEN count(mr) OVER {F60} = 60 THEN corr(lr, mr) OVER {F60} END")} FROM {CTX}""",
        "base",
    )
)
def t20_beta_corr(spark, sf):
    b = X.context_features(_base(spark, sf), B.brand_bars(spark, sf), B.benchmark_of)
    return _out(b, ["market_beta_60", "market_corr_60"])


@query(sql(f"SELECT {K}, {cols(ema_12='e12', ema_26='e26')} FROM osc", "osc"))
def t22_ewm(spark, sf):
    from tickloom.functions.columns import with_ewm

    b = with_ewm(B.brand_bars(spark, sf), {"ema_12": ("close", 2 / 13), "ema_26": ("close", 2 / 27)})
    return _out(b, ["ema_12", "ema_26"])


SNAP = {
    "return_1d": f"close / lag(close, 1) OVER {W} - 1",
    "return_5d": f"close / lag(close, 5) OVER {W} - 1",
    "return_20d": f"close / lag(close, 20) OVER {W} - 1",
    "return_60d": f"close / lag(close, 60) OVER {W} - 1",
    "momentum_acceleration": f"(close / lag(close, 5) OVER {W} - 1) - (close / lag(close, 20) OVER {W} - 1) / 4",
    "relative_volume_20": f"CASE WHEN {guard('avg(volume)', 'volume', 20)} > 0 THEN volume / {guard('avg(volume)', 'volume', 20)} - 1 ELSE 0 END",
    "avg_dollar_volume_20": guard("avg(close * volume)", "close", 20),
    "drawdown_60": f"close / {guard('max(close)', 'close', 60)} - 1",
    "range_position_60": f"CASE WHEN {guard('max(close)', 'close', 60)} - {guard('min(close)', 'close', 60)} > 0 THEN (close - {guard('min(close)', 'close', 60)}) / ({guard('max(close)', 'close', 60)} - {guard('min(close)', 'close', 60)}) ELSE 0.5 END",
}
FLAGS = {
    "above_sma_50": f"coalesce(close > {guard('avg(close)', 'close', 50)}, false)",
    "above_sma_200": f"coalesce(close > {guard('avg(close)', 'close', 200)}, false)",
    "near_20d_high": f"coalesce(close >= {guard('max(close)', 'close', 20)} * 0.98, false)",
    "near_60d_high": f"coalesce(close >= {guard('max(close)', 'close', 60)} * 0.98, false)",
}
from tickloom.plans.sqltext import cte  # noqa: E402

cte(
    "tech",
    "SELECT * FROM (SELECT symbol, dt, close, " + ", ".join(f"{e} AS {n}" for n, e in {**SNAP, **FLAGS}.items()) + ", atr_pct, rsi AS rsi_14, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS back FROM osc) WHERE back = 1",
    "osc",
)
NUMBERS = [*SNAP, "atr_pct", "rsi_14"]


@query(sql(f"SELECT symbol, dt, close, {cols(**{n: n for n in NUMBERS if n != 'avg_dollar_volume_20'})}, round(avg_dollar_volume_20, 9) AS avg_dollar_volume_20, {', '.join(FLAGS)} FROM tech", "tech"))
def t23_technical_snapshot(spark, sf):
    t = X.technical_snapshot(B.brand_bars(spark, sf))
    return t.select("symbol", "dt", "close", *[F.round(n, 9).alias(n) if n == "avg_dollar_volume_20" else R(n).alias(n) for n in NUMBERS], *FLAGS)


RU = "ROWS UNBOUNDED PRECEDING"
cte("rets", f"SELECT b.symbol, dt, ann, close / lag(close) OVER (PARTITION BY b.symbol ORDER BY dt) - 1 AS ret FROM bars b JOIN anns a ON a.symbol = b.symbol", "bars", "anns")
cte(
    "risk1",
    f"""SELECT *, wealth / max(wealth) OVER (PARTITION BY symbol ORDER BY dt {RU}) - 1 AS drawdown, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= ann * 3 AS recent
    FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY dt {RU})) AS wealth FROM rets WHERE ret IS NOT NULL)""",
    "rets",
)
cte("risk2", "SELECT symbol, quantile_cont(ret, 0.05) AS var95 FROM risk1 WHERE recent GROUP BY symbol", "risk1")
cte(
    "risk",
    """SELECT symbol, avg(ret) FILTER (recent) * any_value(ann) AS annual_return, stddev_samp(ret) FILTER (recent) * sqrt(any_value(ann)) AS annual_volatility,
    stddev_samp(ret) FILTER (recent AND ret < 0) * sqrt(any_value(ann)) AS downside_volatility, min(drawdown) AS max_drawdown, any_value(var95) AS var_95_daily,
    avg(ret) FILTER (recent AND ret <= var95) AS cvar_95_daily,
    coalesce(avg(ret) FILTER (recent) * any_value(ann) / nullif(stddev_samp(ret) FILTER (recent) * sqrt(any_value(ann)), 0), 0) AS sharpe_zero_rf, any_value(ann) AS periods_per_year
    FROM risk1 JOIN risk2 USING (symbol) GROUP BY symbol""",
    "risk1",
    "risk2",
)
RISK = ["annual_return", "annual_volatility", "downside_volatility", "max_drawdown", "var_95_daily", "cvar_95_daily", "sharpe_zero_rf", "periods_per_year"]


@query(sql(f"SELECT symbol, {cols(**{n: n for n in RISK})} FROM risk", "risk"))
def t24_risk_metrics(spark, sf):
    return X.rounded(X.risk_metrics(B.brand_bars(spark, sf)), ["symbol"], RISK)


@query(sql(f"SELECT {K}, {cols(x='CASE WHEN volume > 100 THEN NULL ELSE close END')} FROM bars", "bars"))
def t25_finite(spark, sf):
    from tickloom.functions.columns import finite

    x = F.when(F.col("volume") > 200, float("inf")).when(F.col("volume") > 100, float("nan")).otherwise(F.col("close"))
    return B.brand_bars(spark, sf).select("symbol", "dt", R(finite(x)).alias("x"))


@query(
    sql(
        f"SELECT {K}, close, round({guard('avg(close)', 'close', 50)}, 9) AS sma_50, round({guard('avg(close)', 'close', 200)}, 9) AS sma_200 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS back FROM bars) WHERE back <= 500)",
        "bars",
    )
)
def t26_chart_frame(spark, sf):
    c = X.chart_frame(B.brand_bars(spark, sf))
    return c.select("symbol", "dt", "close", F.round("sma_50", 9).alias("sma_50"), F.round("sma_200", 9).alias("sma_200"))


def t27_feature_frame(spark, sf):
    """All features of every bar, with the labels of five sessions ahead; rows with every value only."""
    from tickloom.operators import labels as L

    frame = X.feature_frame(B.brand_bars(spark, sf), B.benchmark_of)
    return L.supervised(frame, X.feature_names() + X.context_names(), 5)


query()(t27_feature_frame)
