"""Portfolio audits: greedy selection by portfolio, price checks, daily paths, slot ledgers, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators import portfolio as P
from tickloom.operators.validation import profit_factor, with_median
from tickloom.sources.storage import stored


def selection_audit(rows: DataFrame, portfolio: list[str], slots: int = 5, most: int | None = None, also: list[str] = (), reentry: bool = False, one_per_symbol: bool = True) -> DataFrame:
    """Active signals of each portfolio, taken in time order while a slot is free: selection and slot of each, and the columns `also`.

    Slots count from 1, the lowest free one is taken; a refused signal holds nothing. The walk sees a few signals a day, see operators/portfolio.
    """
    keep = [*dict.fromkeys([*portfolio, *also, "symbol", "horizon", "dt", "entry_dt", "exit_dt", "probability_up", "expected_return", "position", "ret"])]
    last = F.lit(float("inf"))
    order = [F.col("dt"), F.col("symbol"), F.col("horizon"), F.coalesce(-F.col("probability_up"), last), F.coalesce(-F.col("expected_return"), last)]
    signals, place = P.placed(rows.where("position <> 0").select(*keep), order, "signals")
    cap = slots if most is None else max(0, min(most, slots))
    brief = F.col("exit_dt") <= F.col("entry_dt") if reentry else F.col("exit_dt") < F.col("entry_dt")
    # without the rule of one position a symbol, each signal stands for itself
    alone = signals if one_per_symbol else signals.withColumns({"__symbol": F.col("symbol"), "symbol": F.col("__row_id").cast("string")})
    few = P.day_candidates(alone, portfolio, "entry_dt", place, 2 * slots, brief)
    few = few if one_per_symbol else few.withColumn("symbol", F.col("__symbol")).drop("__symbol")
    taken = stored(P.walked(few, portfolio, "entry_dt", "exit_dt", place, lambda pdf: P.take_slots(pdf, slots, cap, "entry_dt", "exit_dt", reentry, one_per_symbol)), "taken")

    def said(slot: Column, until: Column) -> Column:
        overlap = (until > F.col("entry_dt") if reentry else until.isNotNull()) & F.lit(one_per_symbol)
        return F.when(slot.isNotNull(), "SELECTED").when(overlap, "SYMBOL_OVERLAP").otherwise("GLOBAL_POSITION_CAP")

    out = P.explained(signals, taken, portfolio, "entry_dt", "exit_dt", place, said)
    return out.select(*keep, F.col("said").alias("selection"), "slot")


def price_issues(trades: DataFrame, bars: DataFrame, tolerance_bps: float = 2.0) -> DataFrame:
    """Trades whose entry or exit price isn't the bar's open within the tolerance."""
    ends = trades.select(
        "trade_id", "symbol", F.inline(F.array(F.struct(F.lit("entry").alias("side"), F.col("entry_dt").alias("dt"), F.col("entry_price").alias("expected")), F.struct(F.lit("exit").alias("side"), F.col("exit_dt").alias("dt"), F.col("exit_price").alias("expected"))))
    )
    known = bars.select("symbol").distinct().withColumn("known", F.lit(True))
    rows = ends.join(bars.select("symbol", "dt", F.col("open").alias("actual")), ["symbol", "dt"], "left").join(known, "symbol", "left")
    near = F.abs(F.col("expected") - F.col("actual")) <= F.greatest(F.lit(1e-8), F.abs("expected") * tolerance_bps / 10_000)
    issue = F.when(F.col("known").isNull(), "MISSING_HISTORY").when(F.col("actual").isNull(), "MISSING_OPEN").when(~near, "PRICE_MISMATCH")
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select("trade_id", "symbol", "side", "dt", "issue")


def trade_paths(trades: DataFrame, bars: DataFrame, prices: str = "symbol") -> DataFrame:
    """Open-to-open path of each trade on the sessions of `prices` (the symbol, or its benchmark); cost on the entry day.

    The range join has the priced symbol and the month as keys.
    """
    months = F.explode(F.transform(F.sequence(F.trunc("entry_dt", "month"), F.trunc("exit_dt", "month"), F.expr("interval 1 month")), lambda d: d)).alias("month")
    spread = trades.select("trade_id", "portfolio", "slot", F.col(prices).alias("priced"), "position", "cost", "entry_dt", "exit_dt", months)
    quotes = bars.select(F.col("symbol").alias("priced"), "dt", "open", F.trunc("dt", "month").alias("month"))
    rows = spread.join(quotes, ["priced", "month"]).where("dt BETWEEN entry_dt AND exit_dt")
    w = Window.partitionBy("trade_id").orderBy("dt")
    move = F.coalesce(F.col("open") / F.lag("open").over(w) - 1, F.lit(0.0))
    cost = F.when(F.col("dt") == F.col("entry_dt"), F.abs("position") * F.col("cost")).otherwise(0.0)
    return rows.select(
        "trade_id", "portfolio", "slot", "dt", (F.col("position") * move - cost).alias("position_return"), (move - cost).alias("long_return"), (F.col("dt") == F.col("entry_dt")).cast("int").alias("entry"), (F.col("dt") == F.col("exit_dt")).cast("int").alias("exit")
    )


def curve_calendar(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Days of each portfolio's curve: its symbols' sessions between first entry and last exit; every day for crypto."""
    span = trades.groupBy("portfolio").agg(F.min("entry_dt").alias("a"), F.max("exit_dt").alias("b"), F.max((F.col("market") == "CRYPTO").cast("int")).alias("crypto"))
    daily = span.where("crypto = 1").select("portfolio", F.explode(F.sequence("a", "b")).alias("dt"))
    symbols = trades.select("portfolio", "symbol").distinct()
    traded = bars.select("symbol", "dt").join(symbols, "symbol").join(span.where("crypto = 0"), "portfolio").where("dt BETWEEN a AND b").select("portfolio", "dt").distinct()
    return daily.unionByName(traded)


def slot_ledger(trades: DataFrame, paths: DataFrame, calendar: DataFrame, slots: int, column: str = "position_return") -> DataFrame:
    """Equity, cash, exposure by day: each slot starts with an equal share and compounds its own returns, unbalanced."""
    by_day = paths.groupBy("portfolio", "slot", "dt").agg(F.sum(F.log1p(column)).alias("g"))
    grid = calendar.withColumn("slot", F.explode(F.array(*[F.lit(s) for s in range(1, slots + 1)])))
    w = Window.partitionBy("portfolio", "slot").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    value = F.exp(F.sum(F.coalesce("g", F.lit(0.0))).over(w)) / slots
    grid = grid.join(by_day, ["portfolio", "slot", "dt"], "left").withColumn("value", value)
    # slots held after a day: entered on or before it, left after it
    ends = trades.select("portfolio", "slot", F.inline(F.array(F.struct(F.col("entry_dt").alias("dt"), F.lit(1).alias("d")), F.struct(F.col("exit_dt").alias("dt"), F.lit(-1).alias("d"))))).groupBy("portfolio", "slot", "dt").agg(F.sum("d").alias("d"))
    grid = grid.join(ends, ["portfolio", "slot", "dt"], "left").withColumn("held", (F.sum(F.coalesce("d", F.lit(0))).over(w) > 0).cast("int"))
    days = grid.groupBy("portfolio", "dt").agg(F.sum("value").alias("equity"), F.sum(F.when(F.col("held") == 0, F.col("value")).otherwise(0.0)).alias("cash"), F.sum("held").alias("active_positions"))
    before = F.coalesce(F.lag("equity").over(Window.partitionBy("portfolio").orderBy("dt")), F.lit(1.0))
    return days.withColumns({"daily_return": ratio("equity", before) - 1, "gross_exposure": ratio(F.col("equity") - F.col("cash"), "equity")})


def curve_summary(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy("portfolio").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("dd", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(0.0)) - 1)
    days = F.when(F.substring_index("portfolio", "|", 1) == "CRYPTO", 365.0).otherwise(252.0)
    return rows.groupBy("portfolio").agg(
        (F.max_by("equity", "dt") - 1).alias("total_return"),
        F.min("dd").alias("max_drawdown"),
        (ratio(F.avg("daily_return"), F.stddev_samp("daily_return")) * F.sqrt(F.first(days))).alias("daily_sharpe"),
        F.avg((F.col("active_positions") > 0).cast("double")).alias("exposure_days"),
        F.avg("active_positions").alias("avg_active_positions"),
        F.max("active_positions").alias("max_active_positions"),
        F.avg("gross_exposure").alias("avg_gross_exposure"),
        F.max("gross_exposure").alias("max_gross_exposure"),
    )


def _millionths(name: str) -> Column:
    """The mean of numbers with six digits after the point, from a sum of whole numbers: the same in whatever order the rows come."""
    return F.sum(F.round(F.col(name) * 1_000_000).cast("long")) / F.count(name) / 1_000_000


def trade_summary(trades: DataFrame, by: list[str]) -> DataFrame:
    trades, x = stored(trades, "trades"), F.col("ret")
    report = trades.groupBy(*by).agg(
        F.count("*").alias("selected_trades"), F.avg(x).alias("mean_return"), F.avg((x > 0).cast("double")).alias("hit_rate"),
        profit_factor(x).alias("profit_factor"), F.avg("actual_up").alias("actual_up_rate"), F.avg("execution_up").alias("execution_up_rate"), _millionths("probability_up").alias("avg_probability"), _millionths("expected_return").alias("avg_expected_return"),
    )
    return with_median(report, trades, by)


def group_summary(records: DataFrame, trades: DataFrame, by: list[str]) -> DataFrame:
    """All groups of the records, those without a selected trade too."""
    raw = records.groupBy(*by).agg(F.count("*").alias("observations"), F.count_if(F.col("position") != 0).alias("raw_signals"))
    return raw.join(trade_summary(trades, by), by, "left").withColumn("selected_trades", F.coalesce("selected_trades", F.lit(0)))


def curves(trades: DataFrame, bars: DataFrame, slots: int) -> DataFrame:
    """Curves of the strategy, of the same trades held long, and of their benchmarks (column `benchmark` of trades), told apart by `series`."""
    own, calendar = trade_paths(trades, bars), curve_calendar(trades, bars)
    series = {
        "strategy": slot_ledger(trades, own, calendar, slots),
        "same_trades": slot_ledger(trades, own, calendar, slots, "long_return"),
        "benchmark": slot_ledger(trades, trade_paths(trades, bars, "benchmark"), calendar, slots, "long_return"),
    }
    out = None
    for name, curve in series.items():
        curve = curve.withColumn("series", F.lit(name))
        out = curve if out is None else out.unionByName(curve)
    return out


class PriceIssues(ValueError):
    """Trades whose prices aren't those of the bars."""


def report_parts(records: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """part, value and the group summary of the records and their selected trades by each of the keys."""
    out = None
    for key in keys:
        rows = group_summary(records, trades, [key])
        rows = rows.select(F.lit(key).alias("part"), F.col(key).cast("string").alias("value"), *[c for c in rows.columns if c != key])
        out = rows if out is None else out.unionByName(rows)
    return out


def portfolio_report(records: DataFrame, audit: DataFrame, bars: DataFrame, slots: int, strict: bool = False) -> DataFrame:
    """A row for each portfolio of the records, those without a selected trade too: signals, refusals, price issues, returns of trades and curves.

    audit: the selection with trade_id, portfolio, benchmark and the records' columns. Without a trade, returns and drawdowns are 0 and rates null.
    A strict report isn't made, but fails, if any trade's prices aren't those of the bars.
    """
    trades = audit.where("selection = 'SELECTED'")
    if strict:
        found = price_issues(trades, bars).groupBy("issue").agg(F.count("*").alias("n"), F.min("trade_id").alias("first")).collect()  # a row for each kind
        if found:
            raise PriceIssues("; ".join(f"{r['issue']}: {r['n']}, first {r['first']}" for r in sorted(found)))
    counts = records.groupBy("portfolio").agg(F.count("*").alias("observations"), F.count_if(F.col("position") != 0).alias("raw_signals"))
    refused = audit.groupBy("portfolio").agg(*[F.count_if(F.col("selection") == x).alias(x.lower()) for x in ("SYMBOL_OVERLAP", "GLOBAL_POSITION_CAP")])
    issues = price_issues(trades, bars).join(trades.select("trade_id", "portfolio"), "trade_id").groupBy("portfolio").agg(F.count("*").alias("price_issues"))
    w = Window.partitionBy("portfolio", "series").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = curves(trades, bars, slots).withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    totals = rows.groupBy("portfolio").pivot("series", ["strategy", "same_trades", "benchmark"]).agg((F.max_by("equity", "dt") - 1).alias("total_return"), F.min("dd").alias("max_drawdown"))
    out = counts
    for part in (refused, issues, trade_summary(trades, ["portfolio"]), totals):
        out = out.join(part, "portfolio", "left")
    zero = ["symbol_overlap", "global_position_cap", "price_issues", "selected_trades", "mean_return", "median_return", *[c for c in totals.columns if c != "portfolio"]]
    return out.fillna(0, zero)
