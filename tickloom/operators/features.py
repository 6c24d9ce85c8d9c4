"""Past-only window features of a bar panel; every column needs its full window of values, else it is null.

All windows share one specification, so that a panel is dealt out and sorted by symbol once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import col, finite, r6, ratio, rolling, series, trailing, with_ewm

def w():
    """Rows of one symbol in time order."""
    return series("symbol")
RETURNS = (1, 2, 5, 10, 20, 60, 120)
VOLS = (5, 10, 20, 60, 120)
AVERAGES = (10, 20, 50, 100, 200)
RANGES = (20, 60, 120)
CONTEXT = (1, 5, 20, 60, 120)


def annualization(bars: DataFrame) -> DataFrame:
    """symbol, ann: 365 for series with over a tenth of weekend rows, else 252."""
    share = F.avg(F.dayofweek("dt").isin(1, 7).cast("double"))
    return bars.groupBy("symbol").agg(F.when(share > 0.10, 365.0).otherwise(252.0).alias("ann"))


def base(bars: DataFrame) -> DataFrame:
    """bars with prev (close), lr (log return) and ann."""
    prev = F.lag("close").over(w())
    out = bars.join(annualization(bars), "symbol")  # a row for each symbol
    return out.withColumn("prev", prev).withColumn("lr", F.log(F.col("close") / F.col("prev")))


def returns(b: DataFrame, ns=RETURNS) -> DataFrame:
    return b.withColumns({f"ret_{n}": F.log(F.col("close") / F.lag("close", n).over(w())) for n in ns})


def volatility(b: DataFrame, ns=VOLS) -> DataFrame:
    root = F.sqrt("ann")
    down = F.least("lr", F.when(F.col("lr").isNotNull(), 0.0))
    out = {}
    for n in ns:
        std = rolling(F.stddev_samp("lr"), "lr", w(), n)
        out[f"vol_{n}"] = std * root
        out[f"downside_vol_{n}"] = rolling(F.stddev_samp(down), "lr", w(), n) * root
        out[f"realized_sharpe_{n}"] = ratio(rolling(F.avg("lr"), "lr", w(), n), std) * root
    return b.withColumns(out)


def tail_ratios(b: DataFrame, ns=VOLS) -> DataFrame:
    return b.withColumns(
        {f"tail_ratio_{n}": ratio(rolling(F.percentile("lr", F.lit(0.95)), "lr", w(), n), -rolling(F.percentile("lr", F.lit(0.05)), "lr", w(), n)) for n in ns}
    )


def average_distances(b: DataFrame, ns=AVERAGES) -> DataFrame:
    return b.withColumns({f"ma_dist_{n}": F.col("close") / rolling(F.avg("close"), "close", w(), n) - 1 for n in ns})


def bollinger(b: DataFrame) -> DataFrame:
    mean, std = rolling(F.avg("close"), "close", w(), 20), rolling(F.stddev_samp("close"), "close", w(), 20)
    return b.withColumn("bollinger_z", ratio(F.col("close") - mean, std))


def stochastic(b: DataFrame) -> DataFrame:
    low, high = rolling(F.min("low"), "low", w(), 14), rolling(F.max("high"), "high", w(), 14)
    return b.withColumn("stochastic", ratio(F.col("close") - low, high - low) - 0.5)


def volume_features(b: DataFrame) -> DataFrame:
    b = b.withColumn("logv", F.log1p("volume"))
    mean = {n: rolling(F.avg("logv"), "logv", w(), n) for n in (5, 20)}
    return b.withColumns(
        {
            "volume_z20": finite(ratio(F.col("logv") - mean[20], rolling(F.stddev_samp("logv"), "logv", w(), 20))),
            "volume_change": F.col("logv") - F.lag("logv", 5).over(w()),
            "volume_trend_20": ratio(mean[5], mean[20]) - 1,
        }
    )


def obv_trend(b: DataFrame) -> DataFrame:
    signed = F.coalesce(F.signum(F.col("close") - F.col("prev")), F.lit(0.0)) * F.col("volume")
    b = b.withColumn("obv", F.sum(signed).over(w().rowsBetween(Window.unboundedPreceding, 0)))
    return b.withColumn("obv_trend", ratio(F.col("obv") - F.lag("obv", 20).over(w()), rolling(F.sum("volume"), "volume", w(), 20)))


def range_and_gap(b: DataFrame) -> DataFrame:
    return b.withColumns({"range_pct": (F.col("high") - F.col("low")) / F.col("close"), "gap": F.col("open") / F.col("prev") - 1})


def combos(b: DataFrame) -> DataFrame:
    """Of columns that returns, volatility, average_distances and volume_features give."""
    return b.withColumns(
        {
            "momentum_acceleration": F.col("ret_5") - F.col("ret_20") / 4,
            "trend_strength_50_200": F.col("ma_dist_50") - F.col("ma_dist_200"),
            "price_volume_pressure": F.col("ret_5") * F.col("volume_z20"),
            "volatility_ratio": ratio("vol_10", "vol_60"),
        }
    )


def skews(b: DataFrame, ns=(20, 60)) -> DataFrame:
    """Bias-corrected skewness."""
    return b.withColumns({f"skew_{n}": finite(rolling(F.skewness("lr"), "lr", w(), n)) * float((n * (n - 1)) ** 0.5 / (n - 2)) for n in ns})


def drawdowns(b: DataFrame) -> DataFrame:
    return b.withColumns({f"drawdown_{n}": F.col("close") / rolling(F.max("close"), "close", w(), n) - 1 for n in (60, 252)})


def range_positions(b: DataFrame, ns=RANGES) -> DataFrame:
    out = {}
    for n in ns:
        low, high = rolling(F.min("close"), "close", w(), n), rolling(F.max("close"), "close", w(), n)
        out[f"range_position_{n}"] = ratio(F.col("close") - low, high - low)
        out[f"breakout_distance_{n}"] = F.col("close") / high - 1
        out[f"panic_distance_{n}"] = F.col("close") / low - 1
    return b.withColumns(out)


def oscillators(b: DataFrame) -> DataFrame:
    """rsi_14, rsi_velocity, macd, macd_signal, atr_pct: recursive averages, in one pass over each symbol."""
    diff = F.col("close") - F.col("prev")
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))
    b = b.withColumns({"__gain": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))), "__loss": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))), "__tr": spread})
    wilder = 1 / 14
    averages = {"__g": ("__gain", wilder), "__l": ("__loss", wilder), "__a": ("__tr", wilder), "__e12": ("close", 2 / 13), "__e26": ("close", 2 / 27)}
    b = with_ewm(b, averages | {"__signal": (lambda c: (c["__e12"] - c["__e26"]) / c["close"], 2 / 10)})
    rsi = 100 - 100 / (1 + ratio("__g", "__l"))
    b = b.withColumns({"rsi": rsi, "rsi_14": (rsi - 50) / 50, "macd": (F.col("__e12") - F.col("__e26")) / F.col("close"), "atr_pct": F.col("__a") / F.col("close")})
    b = b.withColumns({"rsi_velocity": F.col("rsi_14") - F.lag("rsi_14", 5).over(w()), "macd_signal": F.col("macd") - F.col("__signal")})
    return b.drop(*[c for c in b.columns if c.startswith("__")])


def context_features(b: DataFrame, bars: DataFrame, benchmark) -> DataFrame:
    """Against each symbol's benchmark: its close on the symbol's own dates, carried forward over missing ones."""
    ctx = bars.select(F.col("symbol").alias("benchmark"), "dt", F.col("close").alias("market_close"))
    b = b.withColumn("benchmark", benchmark(F.col("symbol"))).join(ctx, ["benchmark", "dt"], "left")
    b = b.withColumn("market_close", F.last("market_close", ignorenulls=True).over(w().rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("mr", F.log(F.col("market_close") / F.lag("market_close").over(w())))
    out = {}
    for n in CONTEXT:
        out[f"market_ret_{n}"] = F.log(F.col("market_close") / F.lag("market_close", n).over(w()))
        out[f"relative_strength_{n}"] = F.log(F.col("close") / F.lag("close", n).over(w())) - out[f"market_ret_{n}"]
    out["market_vol_20"] = rolling(F.stddev_samp("mr"), "mr", w(), 20) * F.sqrt("ann")
    full = F.count("mr").over(trailing(w(), 60)) == 60
    frame = trailing(w(), 60)
    out["market_beta_60"] = F.when(full, ratio(F.covar_samp("lr", "mr").over(frame), F.var_samp("mr").over(frame)))
    out["market_corr_60"] = F.when(full, ratio(F.covar_samp("lr", "mr").over(frame), F.sqrt(F.var_samp("lr").over(frame) * F.var_samp("mr").over(frame))))
    return b.withColumns(out)


def feature_names() -> list[str]:
    names = [f"ret_{n}" for n in RETURNS]
    for n in VOLS:
        names += [f"vol_{n}", f"downside_vol_{n}", f"realized_sharpe_{n}", f"tail_ratio_{n}"]
    names += [f"ma_dist_{n}" for n in AVERAGES] + ["rsi_14", "rsi_velocity", "macd", "macd_signal", "bollinger_z", "atr_pct", "stochastic"]
    names += ["volume_z20", "volume_change", "volume_trend_20", "obv_trend", "range_pct", "gap"]
    names += ["momentum_acceleration", "trend_strength_50_200", "price_volume_pressure", "volatility_ratio", "skew_20", "skew_60", "drawdown_60", "drawdown_252"]
    for n in RANGES:
        names += [f"range_position_{n}", f"breakout_distance_{n}", f"panic_distance_{n}"]
    return names


def context_names() -> list[str]:
    return [x for n in CONTEXT for x in (f"market_ret_{n}", f"relative_strength_{n}")] + ["market_vol_20", "market_beta_60", "market_corr_60"]


def feature_frame(bars: DataFrame, benchmark=None) -> DataFrame:
    """symbol, dt, the bar and all features, non-finite ones as null."""
    b = base(bars)
    for step in (returns, volatility, tail_ratios, average_distances, bollinger, stochastic, volume_features, obv_trend, range_and_gap, combos, skews, drawdowns, range_positions, oscillators):
        b = step(b)
    names = feature_names()
    if benchmark is not None:
        b = context_features(b, bars, benchmark)
        names += context_names()
    return b.select("symbol", "dt", "open", "high", "low", "close", "volume", "ann", *[finite(n).alias(n) for n in names])


def chart_frame(bars: DataFrame, last: int = 500) -> DataFrame:
    """The last rows of each symbol with averages that are computed after the cut."""
    back = series("symbol").orderBy(F.desc("dt"))
    cut = bars.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= last).drop("__r")
    return cut.withColumns({f"sma_{n}": rolling(F.avg("close"), "close", w(), n) for n in (50, 200)})


def technical_snapshot(bars: DataFrame) -> DataFrame:
    """One row per symbol: state at its last bar, in simple returns."""
    b = oscillators(base(bars))
    c = F.col("close")
    pct = {n: c / F.lag(c, n).over(w()) - 1 for n in (1, 5, 20, 60)}
    low60, high60 = rolling(F.min(c), c, w(), 60), rolling(F.max(c), c, w(), 60)
    vol20 = rolling(F.avg("volume"), "volume", w(), 20)
    b = b.withColumns(
        {
            **{f"return_{n}d": p for n, p in pct.items()},
            "momentum_acceleration": pct[5] - pct[20] / 4,
            "relative_volume_20": F.when(vol20 > 0, F.col("volume") / vol20 - 1).otherwise(0.0),
            "avg_dollar_volume_20": rolling(F.avg(c * F.col("volume")), c, w(), 20),
            "drawdown_60": c / high60 - 1,
            "range_position_60": F.when(high60 - low60 > 0, (c - low60) / (high60 - low60)).otherwise(0.5),
            "above_sma_50": F.coalesce(c > rolling(F.avg(c), c, w(), 50), F.lit(False)),
            "above_sma_200": F.coalesce(c > rolling(F.avg(c), c, w(), 200), F.lit(False)),
            "near_20d_high": F.coalesce(c >= rolling(F.max(c), c, w(), 20) * 0.98, F.lit(False)),
            "near_60d_high": F.coalesce(c >= high60 * 0.98, F.lit(False)),
        }
    )
    last = b.withColumn("__r", F.row_number().over(series("symbol").orderBy(F.desc("dt")))).where("__r = 1")
    numbers = ["return_1d", "return_5d", "return_20d", "return_60d", "momentum_acceleration", "atr_pct", "relative_volume_20", "avg_dollar_volume_20", "drawdown_60", "range_position_60"]
    flags = ["above_sma_50", "above_sma_200", "near_20d_high", "near_60d_high"]
    return last.select("symbol", "dt", "close", *numbers, col("rsi").alias("rsi_14"), *flags)


def risk_metrics(bars: DataFrame) -> DataFrame:
    """One row per symbol: moments and tails of the last three years' simple returns, drawdown over all history."""
    b = bars.join(annualization(bars), "symbol").withColumn("ret", F.col("close") / F.lag("close").over(w()) - 1)
    wealth = F.exp(F.sum(F.log1p("ret")).over(w().rowsBetween(Window.unboundedPreceding, 0)))
    b = b.where("ret IS NOT NULL").withColumn("wealth", wealth)
    b = b.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    b = b.withColumn("back", F.row_number().over(series("symbol").orderBy(F.desc("dt"))))
    recent = F.col("back") <= F.col("ann") * 3
    x = F.when(recent, F.col("ret"))
    first = b.groupBy("symbol").agg(F.percentile(x, F.lit(0.05)).alias("var_95_daily"))
    b = b.join(first, "symbol")
    out = b.groupBy("symbol").agg(
        F.first("ann").alias("ann"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.stddev_samp(F.when(x < 0, x)).alias("down"),
        F.min("drawdown").alias("max_drawdown"),
        F.first("var_95_daily").alias("var_95_daily"),
        F.avg(F.when(x <= F.col("var_95_daily"), x)).alias("cvar_95_daily"),
    )
    root = F.sqrt("ann")
    return out.select(
        "symbol",
        (F.col("mean") * F.col("ann")).alias("annual_return"),
        (F.col("std") * root).alias("annual_volatility"),
        (F.col("down") * root).alias("downside_volatility"),
        "max_drawdown",
        "var_95_daily",
        "cvar_95_daily",
        F.coalesce(ratio(F.col("mean") * F.col("ann"), F.col("std") * root), F.lit(0.0)).alias("sharpe_zero_rf"),
        F.col("ann").alias("periods_per_year"),
    )


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(v).alias(v) for v in values])
