"""Queries over portfolios of selected trades, and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.functions.columns import r6 as R
from tickloom.operators import calendars as C
from tickloom.operators import reality as X
from tickloom.operators import validation as V
from tickloom.plans.registry import query
from tickloom.plans.sqltext import cte, r6, sql
from tickloom.plans.validation import records, rounded
from tickloom.sources import bars as B
from tickloom.sources.storage import stored

# the greedy selection as a fold over a portfolio's signals in time order: who holds which slot until when, and what was taken
FREE = "list_position(list_transform(s.held, lambda h: h.until < t.entry_dt), true)"
TAKE = "len(list_filter(s.held, lambda h: h.until >= t.entry_dt)) < {cap} AND len(list_filter(s.held, lambda h: h.until >= t.entry_dt AND h.symbol = t.symbol)) = 0"
KEPT = "STRUCT(symbol VARCHAR, until DATE)[]"
TAKEN = "STRUCT(symbol VARCHAR, dt DATE, slot INTEGER)[]"


def picks(slots, cap):
    take = TAKE.format(cap=cap)
    start = ", ".join(["{'symbol': '', 'until': DATE '1900-01-01'}"] * slots)
    signal = f"{{'symbol': symbol, 'dt': CAST(dt AS DATE), 'entry_dt': CAST(entry_dt AS DATE), 'exit_dt': CAST(exit_dt AS DATE), 'held': CAST(NULL AS {KEPT}), 'taken': CAST(NULL AS {TAKEN})}}"
    first = f"{{'symbol': '', 'dt': CAST(NULL AS DATE), 'entry_dt': CAST(NULL AS DATE), 'exit_dt': CAST(NULL AS DATE), 'held': CAST([{start}] AS {KEPT}), 'taken': CAST([] AS {TAKEN})}}"
    held = f"list_transform(s.held, lambda h, i: CASE WHEN {take} AND i = {FREE} THEN {{'symbol': t.symbol, 'until': t.exit_dt}} ELSE h END)"
    taken = f"CASE WHEN {take} THEN list_append(s.taken, {{'symbol': t.symbol, 'dt': t.dt, 'slot': CAST({FREE} AS INTEGER)}}) ELSE s.taken END"
    step = f"{{'symbol': t.symbol, 'dt': t.dt, 'entry_dt': t.entry_dt, 'exit_dt': t.exit_dt, 'held': {held}, 'taken': {taken}}}"
    return f"""SELECT market, horizon, p.symbol, p.dt, p.slot FROM (SELECT market, horizon, unnest((list_reduce(todo, lambda s, t: {step}, {first})).taken) AS p FROM
    (SELECT market, horizon, list({signal} ORDER BY entry_dt, dt, symbol, probability_up DESC, expected_return DESC) AS todo FROM records WHERE position <> 0 GROUP BY market, horizon))"""


cte("picks_5", picks(5, 5), "records")
cte("picks_3", picks(3, 3), "records")
cte("picks_3_2", picks(3, 2), "records")
cte(
    "audit",
    """SELECT a.market, a.horizon, a.symbol, a.dt, CASE WHEN p.slot IS NOT NULL THEN 'SELECTED' WHEN EXISTS (SELECT 1 FROM taken_3_2 h WHERE h.market = a.market AND h.horizon = a.horizon AND h.symbol = a.symbol AND h.dt < a.dt AND h.exit_dt >= a.entry_dt)
    THEN 'SYMBOL_OVERLAP' ELSE 'GLOBAL_POSITION_CAP' END AS selection, p.slot FROM records a LEFT JOIN picks_3_2 p USING (market, horizon, symbol, dt) WHERE a.position <> 0""",
    "records",
    "taken_3_2",
)
cte("taken_3_2", "SELECT p.*, r.exit_dt FROM picks_3_2 p JOIN records r USING (market, horizon, symbol, dt)", "picks_3_2", "records")
cte(
    "trades",
    "SELECT concat_ws('|', symbol, CAST(dt AS VARCHAR), CAST(horizon AS VARCHAR)) AS trade_id, market || '|' || CAST(horizon AS VARCHAR) AS portfolio, r.*, p.slot FROM records r JOIN picks_5 p USING (market, horizon, symbol, dt)",
    "records",
    "picks_5",
)

SLOTS = 5

cte("b2", "SELECT * FROM bars WHERE symbol NOT LIKE '^%3' AND day(dt) <> 13", "bars")


def portfolios(rows):
    return rows.withColumn("portfolio", F.concat_ws("|", "market", F.col("horizon").cast("string")))


def audited(spark, sf, rows=None):
    """The greedy selection of every active signal, each market and horizon a portfolio of SLOTS slots; written once, since its readers are many."""
    rows = portfolios(records(spark, sf) if rows is None else rows)
    audit = X.selection_audit(rows, ["portfolio"], SLOTS, also=rows.columns)
    return stored(audit.withColumn("trade_id", F.concat_ws("|", "symbol", F.col("dt").cast("string"), F.col("horizon").cast("string"))), "selection")


def selected_trades(spark, sf):
    return audited(spark, sf).where("selection = 'SELECTED'").drop("selection")


@query(sql("SELECT market, horizon, symbol, dt, selection, slot FROM audit", "audit"))
def f01_selection_audit(spark, sf):
    return X.selection_audit(records(spark, sf), ["market", "horizon"], 3, 2).select("market", "horizon", "symbol", "dt", "selection", "slot")


@query(sql(f"SELECT market, horizon, symbol, dt, p.slot, {r6('ret', 'ret')} FROM picks_3 p JOIN records USING (market, horizon, symbol, dt)", "picks_3", "records"))
def f02_selected_trades(spark, sf):
    audit = X.selection_audit(records(spark, sf), ["market", "horizon"], 3)
    return audit.where("selection = 'SELECTED'").select("market", "horizon", "symbol", "dt", "slot", R("ret").alias("ret"))


@query(sql("SELECT market, horizon, selection, count(*) AS n FROM audit GROUP BY ALL", "audit"))
def a13_selection_counts(spark, sf):
    return X.selection_audit(records(spark, sf), ["market", "horizon"], 3, 2).groupBy("market", "horizon", "selection").agg(F.count("*").alias("n"))


@query(
    sql(
        """SELECT trade_id, symbol, side, dt, issue FROM (SELECT e.*, CASE WHEN NOT EXISTS (SELECT 1 FROM b2 WHERE b2.symbol = e.symbol) THEN 'MISSING_HISTORY' WHEN b.open IS NULL THEN 'MISSING_OPEN'
    WHEN abs(expected - b.open) > greatest(1e-8, abs(expected) * 2 / 10000) THEN 'PRICE_MISMATCH' END AS issue
    FROM (SELECT trade_id, symbol, 'entry' AS side, entry_dt AS dt, entry_price * CASE WHEN slot = 2 THEN 1.01 ELSE 1 END AS expected FROM trades UNION ALL SELECT trade_id, symbol, 'exit', exit_dt, exit_price FROM trades) e
    LEFT JOIN b2 b ON b.symbol = e.symbol AND b.dt = e.dt) WHERE issue IS NOT NULL""",
        "trades",
        "b2",
    )
)
def j05_price_audit(spark, sf):
    bars = B.brand_bars(spark, sf).where("symbol NOT LIKE '^%3' AND dayofmonth(dt) <> 13")
    trades = selected_trades(spark, sf).withColumn("entry_price", F.col("entry_price") * F.when(F.col("slot") == 2, 1.01).otherwise(1.0))
    return X.price_issues(trades, bars)


MOVE = "coalesce(open / lag(open) OVER (PARTITION BY trade_id ORDER BY b.dt) - 1, 0)"
PATH = """SELECT trade_id, portfolio, slot, dt, position * mv - c AS position_return, mv - c AS long_return, CAST(dt = entry_dt AS INTEGER) AS entry, CAST(dt = exit_dt AS INTEGER) AS exit FROM (SELECT t.trade_id, t.portfolio, t.slot, t.position, t.entry_dt, t.exit_dt, b.dt,
 {move} AS mv, CASE WHEN b.dt = entry_dt THEN abs(position) * cost ELSE 0 END AS c FROM trades t JOIN bars b ON b.symbol = {priced} AND b.dt BETWEEN t.entry_dt AND t.exit_dt)"""
cte("paths", PATH.format(move=MOVE, priced="t.symbol"), "trades", "bars")
BENCH = "CASE WHEN t.symbol LIKE '%-USD' THEN 'B15-USD' WHEN t.symbol LIKE '%.WA' THEN 'B11.WA' ELSE '^B13' END"
cte("bench_paths", PATH.format(move=MOVE, priced=BENCH), "trades", "bars")


def benchmarked(trades):
    s = F.col("symbol")
    return trades.withColumn("benchmark", F.coalesce(B.benchmark_of(s), s))


@query(sql(f"SELECT trade_id, dt, {r6('position_return', 'position_return')}, {r6('long_return', 'long_return')}, entry, exit FROM paths", "paths"))
def f03_j06_trade_paths(spark, sf):
    p = X.trade_paths(selected_trades(spark, sf), B.brand_bars(spark, sf))
    return p.select("trade_id", "dt", R("position_return").alias("position_return"), R("long_return").alias("long_return"), "entry", "exit")


@query(sql(f"SELECT trade_id, dt, {r6('long_return', 'benchmark_return')} FROM bench_paths", "bench_paths"))
def j07_benchmark_paths(spark, sf):
    p = X.trade_paths(benchmarked(selected_trades(spark, sf)), B.brand_bars(spark, sf), "benchmark")
    return p.select("trade_id", "dt", R("long_return").alias("benchmark_return"))


cte("spans", "SELECT portfolio, min(entry_dt) AS a, max(exit_dt) AS b FROM trades GROUP BY portfolio", "trades")
cte(
    "curve_days",
    """SELECT portfolio, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS dt FROM spans WHERE portfolio LIKE 'CRYPTO|%' UNION ALL
    SELECT DISTINCT portfolio, dt FROM bars JOIN (SELECT DISTINCT portfolio, symbol FROM trades) USING (symbol) JOIN spans USING (portfolio) WHERE portfolio NOT LIKE 'CRYPTO|%' AND dt BETWEEN a AND b""",
    "spans",
    "bars",
    "trades",
)


@query(sql("SELECT portfolio, dt FROM curve_days", "curve_days"))
def o06_curve_calendar(spark, sf):
    return X.curve_calendar(selected_trades(spark, sf), B.brand_bars(spark, sf))


LW = "(PARTITION BY portfolio, slot ORDER BY dt ROWS UNBOUNDED PRECEDING)"


def ledger_sql(paths, column):
    return f"""SELECT *, equity / coalesce(lag(equity) OVER (PARTITION BY portfolio ORDER BY dt), 1) - 1 AS daily_return, (equity - cash) / equity AS gross_exposure FROM (
    SELECT portfolio, dt, sum(value) AS equity, sum(CASE WHEN held = 0 THEN value ELSE 0 END) AS cash, sum(held) AS active_positions FROM (SELECT portfolio, slot, dt, exp(sum(coalesce(g, 0)) OVER {LW}) / 5 AS value,
    CASE WHEN sum(coalesce(d, 0)) OVER {LW} > 0 THEN 1 ELSE 0 END AS held FROM (SELECT portfolio, dt, slot FROM curve_days, (SELECT unnest([1, 2, 3, 4, 5]) AS slot)) g0
    LEFT JOIN (SELECT portfolio, slot, dt, sum(ln(1 + {column})) AS g FROM {paths} GROUP BY ALL) USING (portfolio, slot, dt)
    LEFT JOIN (SELECT portfolio, slot, dt, sum(d) AS d FROM (SELECT portfolio, slot, entry_dt AS dt, 1 AS d FROM trades UNION ALL SELECT portfolio, slot, exit_dt, -1 FROM trades) GROUP BY ALL) USING (portfolio, slot, dt)) GROUP BY portfolio, dt)"""


cte("ledger", ledger_sql("paths", "position_return"), "paths", "curve_days", "trades")
cte("bench_ledger", ledger_sql("bench_paths", "long_return"), "bench_paths", "curve_days", "trades")


def ledgers(spark, sf, benchmark=False, trades=None):
    trades, bars = benchmarked(selected_trades(spark, sf) if trades is None else trades), B.brand_bars(spark, sf)
    paths = X.trade_paths(trades, bars, "benchmark" if benchmark else "symbol")
    return X.slot_ledger(trades, paths, X.curve_calendar(trades, bars), 5, "long_return" if benchmark else "position_return")


VALUES = ["equity", "cash", "daily_return", "gross_exposure"]


@query(sql(f"SELECT portfolio, dt, {', '.join(r6(v, v) for v in VALUES)}, active_positions FROM ledger", "ledger"))
def f04_slot_ledger(spark, sf):
    return ledgers(spark, sf).select("portfolio", "dt", *[R(v).alias(v) for v in VALUES], "active_positions")


@query(sql(f"SELECT portfolio, dt, {r6('l.equity', 'equity')}, {r6('b.equity', 'benchmark_equity')} FROM ledger l JOIN bench_ledger b USING (portfolio, dt)", "ledger", "bench_ledger"))
def f05_daily_curve(spark, sf):
    trades = selected_trades(spark, sf)
    bench = ledgers(spark, sf, True, trades).select("portfolio", "dt", R("equity").alias("benchmark_equity"))
    return ledgers(spark, sf, trades=trades).select("portfolio", "dt", R("equity").alias("equity")).join(bench, ["portfolio", "dt"])


SUMMARY = {
    "total_return": "arg_max(equity, dt) - 1",
    "max_drawdown": "min(dd)",
    "daily_sharpe": "avg(daily_return) / nullif(stddev_samp(daily_return), 0) * sqrt(CASE WHEN portfolio LIKE 'CRYPTO|%' THEN 365 ELSE 252 END)",
    "exposure_days": "avg(CASE WHEN active_positions > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "avg_active_positions": "avg(active_positions)",
    "avg_gross_exposure": "avg(gross_exposure)",
    "max_gross_exposure": "max(gross_exposure)",
}


@query(sql(f"SELECT portfolio, {', '.join(r6(e, n) for n, e in SUMMARY.items())}, max(active_positions) AS max_active_positions FROM (SELECT *, equity / max(equity) OVER (PARTITION BY portfolio ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ledger) GROUP BY portfolio", "ledger"))
def a10_curve_summary(spark, sf):
    return rounded(X.curve_summary(ledgers(spark, sf)), ["portfolio", "max_active_positions"])


TRADES = {
    "mean_return": "avg(ret)",
    "median_return": "quantile_cont(ret, 0.5)",
    "hit_rate": "avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "profit_factor": "coalesce(sum(ret) FILTER (ret > 0), 0) / nullif(-sum(ret) FILTER (ret < 0), 0)",
    "actual_up_rate": "avg(actual_up)",
    "execution_up_rate": "avg(execution_up)",
    # numbers of six digits: their sums are whole, so that a mean on the edge of rounding is the same in any order of rows
    "avg_probability": "sum(CAST(round(probability_up * 1000000) AS BIGINT)) / count(probability_up) / 1000000",
    "avg_expected_return": "sum(CAST(round(expected_return * 1000000) AS BIGINT)) / count(expected_return) / 1000000",
}


@query(sql(f"SELECT portfolio, count(*) AS selected_trades, {', '.join(r6(e, n) for n, e in TRADES.items())} FROM trades GROUP BY portfolio", "trades"))
def a11_trade_summary(spark, sf):
    return rounded(X.trade_summary(selected_trades(spark, sf), ["portfolio"]), ["portfolio", "selected_trades"])


@query(
    sql(
        f"""SELECT symbol, horizon, observations, raw_signals, coalesce(selected_trades, 0) AS selected_trades, {', '.join(TRADES)} FROM (SELECT symbol, horizon, count(*) AS observations, count(*) FILTER (position <> 0) AS raw_signals FROM records GROUP BY ALL)
    LEFT JOIN (SELECT symbol, horizon, count(*) AS selected_trades, {', '.join(r6(e, n) for n, e in TRADES.items())} FROM trades GROUP BY symbol, horizon) USING (symbol, horizon)""",
        "records",
        "trades",
    )
)
def a12_group_summary(spark, sf):
    return rounded(X.group_summary(records(spark, sf), selected_trades(spark, sf), ["symbol", "horizon"]), ["symbol", "horizon", "observations", "raw_signals", "selected_trades"])


cte("same_ledger", ledger_sql("paths", "long_return"), "paths", "curve_days", "trades")
CURVES = {"strategy": "ledger", "same_trades": "same_ledger", "benchmark": "bench_ledger"}
cte("all_records", "SELECT market || '|' || CAST(horizon AS VARCHAR) AS portfolio, * FROM records", "records")
cte(
    "refusals",
    """SELECT a.portfolio, count(*) FILTER (EXISTS (SELECT 1 FROM trades h WHERE h.portfolio = a.portfolio AND h.symbol = a.symbol AND h.dt < a.dt AND h.exit_dt >= a.entry_dt)) AS symbol_overlap, count(*) AS refused
    FROM all_records a WHERE a.position <> 0 AND NOT EXISTS (SELECT 1 FROM trades t WHERE t.portfolio = a.portfolio AND t.symbol = a.symbol AND t.dt = a.dt) GROUP BY a.portfolio""",
    "all_records",
    "trades",
)
cte(
    "bad_prices",
    """SELECT portfolio, count(*) AS price_issues FROM (SELECT portfolio, symbol, entry_dt AS dt, entry_price AS expected FROM trades UNION ALL SELECT portfolio, symbol, exit_dt, exit_price FROM trades) e
    LEFT JOIN bars b USING (symbol, dt) WHERE b.open IS NULL OR abs(expected - b.open) > greatest(1e-8, abs(expected) * 2 / 10000) GROUP BY portfolio""",
    "trades",
    "bars",
)
for _name, _curve in CURVES.items():
    cte(f"{_name}_totals", f"SELECT portfolio, arg_max(equity, dt) - 1 AS total_return, min(dd) AS max_drawdown FROM (SELECT *, equity / max(equity) OVER (PARTITION BY portfolio ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {_curve}) GROUP BY portfolio", _curve)
cte("trade_stats", f"SELECT portfolio, count(*) AS selected_trades, {', '.join(f'{e} AS {n}' for n, e in TRADES.items())} FROM trades GROUP BY portfolio", "trades")
RATES = [n for n in TRADES if n not in ("mean_return", "median_return")]
TOTALS = ", ".join(f"{r6(f'coalesce({n}_totals.{c}, 0)', f'{n}_{c}')}" for n in CURVES for c in ("total_return", "max_drawdown"))


@query(
    sql(
        f"""SELECT portfolio, observations, raw_signals, coalesce(symbol_overlap, 0) AS symbol_overlap, coalesce(refused - symbol_overlap, 0) AS global_position_cap, coalesce(price_issues, 0) AS price_issues, coalesce(selected_trades, 0) AS selected_trades,
    {r6('coalesce(mean_return, 0)', 'mean_return')}, {r6('coalesce(median_return, 0)', 'median_return')}, {', '.join(r6(n, n) for n in RATES)}, {TOTALS}
    FROM (SELECT portfolio, count(*) AS observations, count(*) FILTER (position <> 0) AS raw_signals FROM all_records GROUP BY portfolio) LEFT JOIN refusals USING (portfolio) LEFT JOIN bad_prices USING (portfolio) LEFT JOIN trade_stats USING (portfolio)
    {' '.join(f'LEFT JOIN {n}_totals USING (portfolio)' for n in CURVES)}""",
        "all_records",
        "refusals",
        "bad_prices",
        "trade_stats",
        *[f"{n}_totals" for n in CURVES],
    )
)
def f08_reality_report(spark, sf):
    bars = B.brand_bars(spark, sf)
    rows = stored(V.records(bars), "records")
    report = X.portfolio_report(portfolios(rows), benchmarked(audited(spark, sf, rows)), bars, SLOTS)
    return rounded(report, ["portfolio", "observations", "raw_signals", "symbol_overlap", "global_position_cap", "price_issues", "selected_trades"])


def part_sql(key):
    stats = ", ".join(r6(e, n) for n, e in TRADES.items())
    return f"""SELECT '{key}' AS part, CAST({key} AS VARCHAR) AS value, observations, raw_signals, coalesce(selected_trades, 0) AS selected_trades, {', '.join(TRADES)} FROM (SELECT {key}, count(*) AS observations, count(*) FILTER (position <> 0) AS raw_signals FROM records GROUP BY {key})
    LEFT JOIN (SELECT {key}, count(*) AS selected_trades, {stats} FROM trades GROUP BY {key}) USING ({key})"""


@query(sql(" UNION ALL ".join(part_sql(k) for k in ("symbol", "horizon", "fold", "market")), "records", "trades"))
def f08_report_parts(spark, sf):
    """The report's parts by symbol, horizon, fold and market; the trades' prices are held against the bars first, strictly."""
    bars = B.brand_bars(spark, sf)
    rows = stored(V.records(bars), "records")
    audit = audited(spark, sf, rows)
    X.portfolio_report(portfolios(rows), benchmarked(audit), bars, SLOTS, strict=True)
    parts = X.report_parts(rows, audit.where("selection = 'SELECTED'"), ["symbol", "horizon", "fold", "market"])
    return rounded(parts, ["part", "value", "observations", "raw_signals", "selected_trades"])


# calendars: the years of the tables

YEARS = "(SELECT unnest(generate_series(1990, 2032)) AS y)"
WD = "(isodow({0}) - 1)"


def _nth(month, weekday, nth):
    first = f"make_date(y, {month}, 1)"
    return f"({first} + CAST(({weekday} - {WD.format(first)} + 7) % 7 + {7 * (nth - 1)} AS INTEGER))"


def _observed(month, day):
    d = f"make_date(y, {month}, {day})"
    return f"(CASE {WD.format(d)} WHEN 5 THEN {d} - 1 WHEN 6 THEN {d} + 1 ELSE {d} END)"


RULES = [_observed(1, 1), _nth(1, 0, 3), _nth(2, 0, 3), "(make_date(y, easter_month, easter_day) - 2)", f"(make_date(y, 5, 31) - CAST({WD.format('make_date(y, 5, 31)')} AS INTEGER))", _observed(6, 19), _observed(7, 4), _nth(9, 0, 1), _nth(11, 3, 4), _observed(12, 25)]
LISTED = ", ".join(f"DATE '{d}'" for d in C.NYSE_CLOSED)
GPW = ", ".join(f"DATE '{d}'" for d in C.GPW_CLOSED)
cte("years", "SELECT CAST(unnest(generate_series(1990, 2032)) AS INTEGER) AS y")
cte("nyse", f"SELECT DISTINCT y, CAST(dt AS DATE) AS dt FROM (SELECT y, unnest([{', '.join(RULES)}]) AS dt FROM {rules.as_sql('years', C.EASTER)} WHERE y NOT BETWEEN 2026 AND 2028) UNION ALL SELECT CAST(year(dt) AS INTEGER), dt FROM (SELECT unnest([{LISTED}]) AS dt)", "years")
cte("gpw", f"SELECT unnest([{GPW}]) AS dt")
cte(
    "sessions",
    f"""SELECT *, sum(CAST(is_session AS INTEGER)) OVER (PARTITION BY kind ORDER BY dt) AS n FROM (SELECT kind, dt, kind = 'CRYPTO_24_7' OR (isodow(dt) < 6 AND NOT ((kind = 'NYSE' AND dt IN (SELECT dt FROM nyse)) OR (kind = 'GPW' AND dt IN (SELECT dt FROM gpw)))) AS is_session
    FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2032-12-31', INTERVAL 1 DAY))::DATE AS dt), (SELECT unnest(['CRYPTO_24_7', 'GPW', 'NYSE']) AS kind) WHERE kind <> 'GPW' OR year(dt) = 2026)""",
    "nyse",
    "gpw",
)


def calendar(spark):
    return C.sessions(C.years(spark, 1990, 2032))


def bar_days(spark, sf):
    """symbol, calendar kind and day of each bar."""
    return rules.apply(B.brand_bars(spark, sf), rules.CLASS[:1]).select("symbol", F.col("calendar_kind").alias("kind"), "dt")


KIND = rules.CLASS[0]["calendar_kind"]
cte("bar_days", f"SELECT symbol, {KIND} AS kind, dt FROM bars", "bars")


@query(sql("SELECT symbol, dt FROM bars JOIN nyse USING (dt)", "bars", "nyse"))
def k01_bars_on_nyse_holidays(spark, sf):
    return B.brand_bars(spark, sf).join(C.nyse_holidays(C.years(spark, 1990, 2032)).select("dt"), "dt").select("symbol", "dt")


@query(sql("SELECT symbol, (dt + 10300)::DATE AS dt FROM bars WHERE (dt + 10300)::DATE IN (SELECT dt FROM gpw)", "bars", "gpw"))
def k02_gpw_closed(spark, sf):
    """Bar days moved into the published year that are closed days there."""
    moved = B.brand_bars(spark, sf).select("symbol", F.date_add("dt", 10300).alias("dt"))
    return moved.join(F.broadcast(C.gpw_holidays(C.years(spark, 2026, 2026)).select("dt")), "dt").select("symbol", "dt")  # ten days


@query(sql("SELECT b.symbol, b.dt, s.is_session, CAST(s.n AS BIGINT) AS session_number FROM bar_days b JOIN sessions s USING (kind, dt)", "bar_days", "sessions"))
def k03_session_calendar(spark, sf):
    return bar_days(spark, sf).join(calendar(spark), ["kind", "dt"]).select("symbol", "dt", "is_session", F.col("n").alias("session_number"))


ITEMS = "(SELECT symbol, kind, dt AS start_dt, (dt + 31)::DATE AS end_dt, 20 AS horizon FROM bar_days)"


def items(spark, sf):
    return bar_days(spark, sf).select("symbol", "kind", F.col("dt").alias("start_dt"), F.date_add("dt", 31).alias("end_dt"), F.lit(20).alias("horizon"))


PERIODS = f"(SELECT i.*, CAST(b.n - a.n AS BIGINT) AS periods FROM {ITEMS} i LEFT JOIN sessions a ON a.kind = i.kind AND a.dt = start_dt LEFT JOIN sessions b ON b.kind = i.kind AND b.dt = end_dt)"


@query(sql(f"SELECT symbol, start_dt, periods FROM {PERIODS}", "bar_days", "sessions"))
def k04_periods_between(spark, sf):
    return C.periods_between(items(spark, sf), calendar(spark), "start_dt", "end_dt").select("symbol", "start_dt", "periods")


@query(sql(f"SELECT symbol, start_dt, CASE WHEN periods IS NULL THEN 'UNKNOWN' WHEN periods >= horizon THEN 'HORIZON_ENDED' ELSE 'ACTIVE' END AS status, CASE WHEN periods IS NOT NULL THEN greatest(horizon - periods, 0) END AS remaining FROM {PERIODS}", "bar_days", "sessions"))
def k05_lifecycle(spark, sf):
    return C.lifecycle(C.periods_between(items(spark, sf), calendar(spark), "start_dt", "end_dt")).select("symbol", "start_dt", "status", "remaining")


@query(
    sql(
        """SELECT trade_id, (SELECT max(d) FROM (SELECT unnest(generate_series(entry_dt, entry_dt + 35, INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6 AND (SELECT count(*) FROM (SELECT unnest(generate_series(entry_dt + 1, d, INTERVAL 1 DAY)) AS e) WHERE isodow(e) < 6) = horizon) AS planned_exit,
    CAST((SELECT count(*) FROM (SELECT unnest(generate_series(entry_dt + 1, exit_dt, INTERVAL 1 DAY)) AS e) WHERE isodow(e) < 6) AS INTEGER) AS elapsed FROM trades WHERE isodow(entry_dt) < 6""",
        "trades",
    )
)
def k07_business_progress(spark, sf):
    rows = selected_trades(spark, sf).where(F.weekday("entry_dt") < 5)
    return C.business_progress(rows, F.col("exit_dt")).select("trade_id", "planned_exit", "elapsed")


@query(
    sql(
        """SELECT ledger_id, dt, CASE WHEN dt = max(dt) OVER (PARTITION BY ledger_id) THEN 'RUN' ELSE 'MISSED' END AS action FROM (SELECT symbol AS ledger_id, kind, max(dt) AS last_audit FROM bar_days WHERE kind <> 'GPW' GROUP BY ALL)
    JOIN (SELECT kind, dt FROM sessions WHERE is_session) USING (kind) WHERE dt > last_audit AND dt <= DATE '2001-12-10' AND dt >= DATE '2001-12-10' - 45""",
        "bar_days",
        "sessions",
    )
)
def k08_missing_sessions(spark, sf):
    audits = bar_days(spark, sf).where("kind <> 'GPW'").groupBy(F.col("symbol").alias("ledger_id"), "kind").agg(F.max("dt").alias("last_audit"))
    return C.missing_sessions(audits, calendar(spark), F.lit("2001-12-10").cast("date"))


LOCAL = "(timezone('Europe/Warsaw', timezone('UTC', ts)))"


@query(f"SELECT event_id, (CAST({LOCAL} AS DATE) > CAST(ts AS DATE)) OR (CAST({LOCAL} AS DATE) = CAST(ts AS DATE) AND hour({LOCAL}) * 60 + minute({LOCAL}) >= 1340) AS closed FROM events")
def k09_closed_bar(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select("event_id", C.bar_is_closed(F.col("ts").cast("timestamp"), F.to_date("ts")).alias("closed"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10'")
def k10_freeze_guard(spark, sf):
    return B.table(spark, sf, "events").where(F.to_date("ts") >= F.lit("2024-01-10").cast("date")).select("event_id")
