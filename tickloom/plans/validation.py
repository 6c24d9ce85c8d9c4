"""Queries over walk-forward records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.functions.columns import r6 as R
from tickloom.operators import labels as L
from tickloom.operators import validation as V
from tickloom.plans.registry import query
from tickloom.plans.sqltext import W, cte, r6, sql
from tickloom.sources import bars as B

WH = "PARTITION BY symbol, horizon ORDER BY dt ROWS BETWEEN 249 PRECEDING AND CURRENT ROW"
cte("hs", "SELECT unnest([1, 5, 20]) AS horizon")
cte("posd", f"SELECT *, row_number() OVER {W} AS pos, ln(close / lag(close, 20) OVER {W}) AS x FROM bars", "bars")
cte("lags", "SELECT b.*, horizon, p.x AS px, b.close / p.close - 1 AS py FROM posd b, hs LEFT JOIN posd p ON p.symbol = b.symbol AND p.pos = b.pos - horizon", "posd", "hs")
cte(
    "fits",
    f"""SELECT symbol, dt, pos, horizon, x, least(greatest(my + slope * (x - mx), -0.2), 0.2) AS er, sy FROM (SELECT *, regr_slope(py, px) OVER ({WH}) AS slope, avg(px) OVER ({WH}) AS mx,
    avg(CASE WHEN px IS NOT NULL THEN py END) OVER ({WH}) AS my, stddev_samp(py) OVER ({WH}) AS sy FROM lags) WHERE pos >= 300""",
    "lags",
)
cte("fcast", "SELECT symbol, dt, pos, horizon, x, round(er, 6) AS expected_return, round(1 / (1 + exp(-4 * er / sy)), 6) AS probability_up, round(1 / (1 + exp(-0.5 * x / sy)), 6) AS lp, 'HIGH' AS quality, 'ML' AS mode FROM fits", "fits")
cte(
    "execs",
    """SELECT a.symbol, a.dt, horizon, n.dt AS entry_dt, n.open AS entry_price, e.dt AS exit_dt, e.open AS exit_price, f.close / a.close - 1 AS forward_return,
    CASE WHEN f.close IS NOT NULL THEN CAST(f.close / a.close - 1 > 0 AS INTEGER) END AS actual_up, e.open / n.open - 1 AS execution_return
    FROM posd a, hs LEFT JOIN posd n ON n.symbol = a.symbol AND n.pos = a.pos + 1 LEFT JOIN posd e ON e.symbol = a.symbol AND e.pos = a.pos + horizon + 1
    LEFT JOIN posd f ON f.symbol = a.symbol AND f.pos = a.pos + horizon""",
    "posd",
    "hs",
)
cte(
    "records",
    f"""SELECT symbol, asset_class AS market, horizon, dt, pos, CAST(floor((pos - 300) / 90) AS INTEGER) AS fold, entry_dt, exit_dt, entry_price, exit_price, probability_up, expected_return, decision AS position, decision_reason,
    decision * execution_return AS gross_return, decision * execution_return - abs(decision) * 0.002::DOUBLE AS ret, 0.002::DOUBLE AS cost, execution_return - 0.002::DOUBLE AS always_long_return, execution_return AS buy_hold_return,
    CASE WHEN x > 0 THEN 1 ELSE -1 END * execution_return - 0.002::DOUBLE AS momentum_return,
    CASE WHEN lp >= 0.52 THEN execution_return - 0.002::DOUBLE WHEN lp <= 0.48 THEN -execution_return - 0.002::DOUBLE ELSE 0::DOUBLE END AS linear_return, actual_up, CAST(execution_return > 0 AS INTEGER) AS execution_up
    FROM {rules.as_sql("(SELECT * FROM fcast JOIN execs USING (symbol, dt, horizon) WHERE exit_price IS NOT NULL AND forward_return IS NOT NULL)", [rules.CLASS[0], *rules.gate(0.52)])}""",
    "fcast",
    "execs",
)


def records(spark, sf):
    return V.records(B.brand_bars(spark, sf))


def rounded(df, keys, skip=()):
    return df.select(*keys, *[F.col(c) if c in skip else R(c).alias(c) for c in df.columns if c not in keys])


@query(sql("SELECT symbol, dt, horizon, entry_dt, entry_price, exit_dt, exit_price, " + ", ".join(r6(c, c) for c in ("forward_return", "execution_return")) + ", actual_up FROM execs", "execs"))
def t28_executions(spark, sf):
    rows = L.executions(B.brand_bars(spark, sf), [1, 5, 20])
    return rows.select("symbol", "dt", "horizon", "entry_dt", "entry_price", "exit_dt", "exit_price", R("forward_return").alias("forward_return"), R("execution_return").alias("execution_return"), "actual_up")


@query(sql(f"SELECT symbol, dt, lag(dt, 5) OVER {W} AS label_dt FROM bars", "bars"))
def t29_label_cutoff(spark, sf):
    return L.known_at(B.brand_bars(spark, sf), 5).select("symbol", "dt", "label_dt")


@query(sql(f"SELECT symbol, dt, horizon, probability_up, {r6('expected_return', 'expected_return')} FROM fcast", "fcast"))
def m13_factor_walk_forward(spark, sf):
    return V.factor_forecast(B.brand_bars(spark, sf)).select("symbol", "dt", "horizon", "probability_up", R("expected_return").alias("expected_return"))


FIELDS = ["gross_return", "ret", "always_long_return", "buy_hold_return", "momentum_return", "linear_return"]


@query(sql("SELECT symbol, market, horizon, dt, fold, position, decision_reason, actual_up, execution_up, " + ", ".join(r6(c, c) for c in FIELDS) + " FROM records", "records"))
def m15_validation_records(spark, sf):
    return records(spark, sf).select("symbol", "market", "horizon", "dt", "fold", "position", "decision_reason", "actual_up", "execution_up", *[R(c).alias(c) for c in FIELDS])


@query(sql("SELECT symbol, horizon, dt, position FROM records WHERE horizon IN (5, 20) AND market IN ('US', 'CRYPTO')", "records"))
def p13_records_filter(spark, sf):
    return records(spark, sf).where(F.col("horizon").isin(5, 20) & F.col("market").isin("US", "CRYPTO")).select("symbol", "horizon", "dt", "position")


P = "least(greatest(probability_up, 0.0001), 0.9999)"
PF = "CASE WHEN -sum(ret) FILTER (position <> 0 AND ret < 0) > 0 THEN coalesce(sum(ret) FILTER (position <> 0 AND ret > 0), 0) / -sum(ret) FILTER (position <> 0 AND ret < 0) WHEN sum(ret) FILTER (position <> 0 AND ret > 0) > 0 THEN 'Infinity'::DOUBLE END"
MEASURES = {
    "mean_return": "avg(ret) FILTER (position <> 0)",
    "median_return": "quantile_cont(ret, 0.5) FILTER (position <> 0)",
    "profit_factor": PF,
    "hit_rate": "avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (position <> 0)",
    "brier": f"avg(power(actual_up - {P}, 2))",
    "always_long": "avg(always_long_return)",
    "buy_hold": "avg(buy_hold_return)",
    "momentum": "avg(momentum_return)",
    "linear": "avg(linear_return)",
}
COUNTS = "count(*) AS observations, count(*) FILTER (position <> 0) AS trades, count(*) FILTER (position = 0) AS rejected"
SETS = [["market"], ["symbol"], ["horizon"], ["fold"], []]
KEYS = ["market", "symbol", "horizon", "fold"]


@query(sql(f"SELECT market, symbol, horizon, fold, CAST(grouping_id(market, symbol, horizon, fold) AS BIGINT) AS level, {COUNTS}, {', '.join(r6(e, n) for n, e in MEASURES.items())} FROM records GROUP BY GROUPING SETS ((market), (symbol), (horizon), (fold), ())", "records"))
def a02_group_report(spark, sf):
    out = V.group_report(records(spark, sf), SETS, KEYS)
    return rounded(out, [*KEYS, "level", "observations", "trades", "rejected"])


@query(sql(f"SELECT {COUNTS}, {', '.join(r6(e, n) for n, e in MEASURES.items())} FROM records", "records"))
def a01_trade_aggregate(spark, sf):
    return rounded(V.trade_aggregate(records(spark, sf)), ["observations", "trades", "rejected"])


@query(sql("SELECT market, decision_reason, count(*) AS n FROM records WHERE position = 0 GROUP BY ALL", "records"))
def a01_rejection_reasons(spark, sf):
    return V.rejection_reasons(records(spark, sf))


@query(
    sql(
        f"""SELECT horizon, market, {r6('(sum(rk) FILTER (actual_up = 1) - n1 * (n1 + 1) / 2) / (n1 * n0)', 'auc')} FROM (SELECT *, count(*) FILTER (actual_up = 1) OVER (PARTITION BY horizon, market) AS n1,
    count(*) FILTER (actual_up = 0) OVER (PARTITION BY horizon, market) AS n0, rank() OVER (PARTITION BY horizon, market ORDER BY probability_up) + (count(*) OVER (PARTITION BY horizon, market, probability_up) - 1) / 2 AS rk FROM records) GROUP BY horizon, market, n1, n0""",
        "records",
    )
)
def a03_auc(spark, sf):
    return rounded(V.auc(records(spark, sf), ["horizon", "market"]), ["horizon", "market"])


@query(
    sql(
        f"""SELECT horizon, {r6(f'avg(power(actual_up - {P}, 2))', 'brier')}, {r6('avg(CASE WHEN CAST(probability_up >= 0.5 AS INTEGER) = actual_up THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 'accuracy')},
    {r6('greatest(avg(actual_up), 1 - avg(actual_up))', 'baseline')}, {r6('avg(abs(expected_return - buy_hold_return))', 'mae')} FROM records GROUP BY horizon""",
        "records",
    )
)
def a04_brier_accuracy(spark, sf):
    from tickloom.functions.columns import clip

    out = records(spark, sf).groupBy("horizon").agg(
        F.avg(F.pow(F.col("actual_up") - clip("probability_up", 1e-4, 1 - 1e-4), 2)).alias("brier"),
        F.avg(((F.col("probability_up") >= 0.5).cast("int") == F.col("actual_up")).cast("double")).alias("accuracy"),
        F.greatest(F.avg("actual_up"), 1 - F.avg("actual_up")).alias("baseline"),
        F.avg(F.abs(F.col("expected_return") - F.col("buy_hold_return"))).alias("mae"),
    )
    return rounded(out, ["horizon"])


@query(sql(f"SELECT symbol, {r6('sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0)', 'profit_factor')} FROM records WHERE position <> 0 GROUP BY symbol", "records"))
def a05_profit_factor(spark, sf):
    out = records(spark, sf).where(V.ACTIVE).groupBy("symbol").agg(V.profit_factor(F.col("ret")).alias("profit_factor"))
    return rounded(out, ["symbol"])


@query(
    sql(
        f"""SELECT horizon, k, {r6('avg(s)', 'mean_return')}, {r6('quantile_cont(s, 0.5)', 'median_return')}, {r6('sum(s) FILTER (s > 0) / -sum(s) FILTER (s < 0)', 'profit_factor')}
    FROM (SELECT horizon, k, gross_return - abs(position) * cost * k AS s FROM records, (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE]) AS k) WHERE position <> 0) GROUP BY horizon, k""",
        "records",
    )
)
def a06_cost_stress(spark, sf):
    return rounded(V.cost_stress(records(spark, sf)), ["horizon", "k"])


@query(
    sql(
        f"""SELECT horizon, {r6('any_value(share)', 'top_symbol_profit_share')}, {r6("sum(ret) FILTER (ret > 0 AND r <= greatest(1, ceil(wins * 0.01::DOUBLE))) / sum(ret) FILTER (ret > 0)", 'top_1pct_trade_profit_share')},
    {', '.join(r6(f"avg(ret) FILTER (r > greatest(1, ceil(n * {p / 100}::DOUBLE)))", f'return_without_best_{p}pct') for p in (1, 5, 10))}
    FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ret DESC, symbol, dt) AS r, count(*) OVER (PARTITION BY horizon) AS n, count(*) FILTER (ret > 0) OVER (PARTITION BY horizon) AS wins FROM records WHERE position <> 0)
    JOIN (SELECT horizon, max(p) / nullif(sum(p), 0) AS share FROM (SELECT horizon, symbol, greatest(sum(ret), 0) AS p FROM records WHERE position <> 0 GROUP BY ALL) GROUP BY horizon) USING (horizon) GROUP BY horizon""",
        "records",
    )
)
def a07_concentration(spark, sf):
    return rounded(V.concentration(records(spark, sf)), ["horizon"])


@query(
    sql(
        f"""SELECT horizon, k, count(*) AS trades, {r6('avg(ret)', 'mean_return')}, {r6('quantile_cont(ret, 0.5)', 'median_return')}, {r6('avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 'hit_rate')},
    {r6('sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0)', 'profit_factor')} FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ret DESC, symbol, dt) AS r FROM records WHERE position <> 0), (SELECT unnest([1, 2, 3]) AS k) WHERE r > k GROUP BY horizon, k""",
        "records",
    )
)
def a08_without_best(spark, sf):
    return rounded(V.without_best(records(spark, sf)), ["horizon", "k", "trades"])


cte("pieces", "SELECT horizon, entry_dt, ret / (date_diff('day', entry_dt, greatest(entry_dt, exit_dt)) + 1) AS piece, unnest(generate_series(entry_dt, greatest(entry_dt, exit_dt), INTERVAL 1 DAY))::DATE AS dt FROM records WHERE position <> 0", "records")
cte("days", "SELECT horizon, dt, avg(piece) AS daily, count(*) AS active, count(*) FILTER (dt = entry_dt) AS entries FROM pieces GROUP BY horizon, dt", "pieces")
cte(
    "timeline",
    """SELECT horizon, dt, coalesce(daily, 0) AS daily, coalesce(active, 0) AS active, coalesce(entries, 0) AS entries FROM (SELECT horizon, unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY))::DATE AS dt FROM days GROUP BY horizon)
    LEFT JOIN days USING (horizon, dt)""",
    "days",
)


@query(sql(f"SELECT horizon, dt, {r6('daily', 'daily')}, active, entries FROM timeline", "timeline"))
def f07_portfolio_timeline(spark, sf):
    return rounded(V.timeline(records(spark, sf)), ["horizon", "dt", "active", "entries"])


@query(sql("SELECT horizon, dt, count(*) AS open_positions FROM pieces GROUP BY ALL", "pieces"))
def j08_interval_explode(spark, sf):
    rows = records(spark, sf).where(V.ACTIVE)
    days = rows.select("horizon", F.explode(F.sequence("entry_dt", F.greatest("entry_dt", "exit_dt"))).alias("dt"))
    return days.groupBy("horizon", "dt").agg(F.count("*").alias("open_positions"))


RP = "OVER (PARTITION BY horizon ORDER BY dt ROWS UNBOUNDED PRECEDING)"
RISKS = {
    "sharpe": "avg(daily) / nullif(stddev_samp(daily), 0) * sqrt(252)",
    "sortino": "avg(daily) / nullif(stddev_samp(daily) FILTER (daily < 0), 0) * sqrt(252)",
    "max_drawdown": "min(dd)",
    "exposure": "avg(CASE WHEN active > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "avg_concurrent": "avg(active)",
    "turnover": "sum(entries) / count(*)",
}


@query(sql(f"SELECT horizon, {', '.join(r6(e, n) for n, e in RISKS.items())} FROM (SELECT *, wealth / max(wealth) {RP} - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + daily)) {RP}) AS wealth FROM timeline)) GROUP BY horizon", "timeline"))
def a09_a25_timeline_risk(spark, sf):
    return rounded(V.timeline_risk(V.timeline(records(spark, sf))), ["horizon"])


@query(
    sql(
        """SELECT horizon, symbol, CAST((list_reduce(t, lambda s, x: {'a': x.a, 'b': CASE WHEN s.b IS NULL OR x.a > s.b THEN x.b ELSE s.b END, 'n': CASE WHEN s.b IS NULL OR x.a > s.b THEN s.n + 1 ELSE s.n END}, {'a': CAST(NULL AS DATE), 'b': CAST(NULL AS DATE), 'n': 0})).n AS INTEGER) AS n
    FROM (SELECT horizon, symbol, list({'a': CAST(entry_dt AS DATE), 'b': CAST(exit_dt AS DATE), 'n': 0} ORDER BY entry_dt, exit_dt) AS t FROM records WHERE position <> 0 GROUP BY ALL)""",
        "records",
    )
)
def w15_non_overlapping(spark, sf):
    return V.non_overlapping(records(spark, sf))


FOLDS = """SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY test_start) AS fold, test_start - 4 AS train_end, test_start, least(e, test_start + 63) AS test_end, 'WALK_FORWARD' AS fold_type FROM
 (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY test_start) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m FROM
 (SELECT symbol, e, unnest(generate_series(256, e - 1, 63)) AS test_start FROM (SELECT symbol, CASE WHEN n - 126 >= 277 THEN greatest(257, n - 126 - 5) ELSE n END AS e FROM lengths)) WHERE least(e, test_start + 63) - test_start >= 20 AND test_start - 4 >= 250)
 WHERE m <= 4 OR i IN (0, floor((m - 1) / 3), floor(2 * (m - 1) / 3), m - 1)"""
cte("lengths", "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol", "bars")
cte("folds", FOLDS, "lengths")


@query(sql("SELECT * FROM folds UNION ALL SELECT symbol, coalesce(k, 0) + 1, n - 126 - 4, n - 126, n, 'HOLDOUT' FROM lengths LEFT JOIN (SELECT symbol, count(*) AS k FROM folds GROUP BY symbol) USING (symbol) WHERE n - 126 >= 277", "folds", "lengths"))
def m14_w12_fold_ranges(spark, sf):
    lengths = B.brand_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return V.fold_ranges(lengths, 5)


@query()
def a21_bootstrap(spark, sf):
    return rounded(V.bootstrap_mean(records(spark, sf), 250), ["horizon"])


@query()
def a22_block_bootstrap(spark, sf):
    rows = records(spark, sf)
    by_fold = V.block_bootstrap(rows, F.col("fold"), 500).withColumn("blocks", F.lit("fold"))
    by_date = V.block_bootstrap(rows, F.floor(F.datediff("entry_dt", F.lit("1992-01-01")) / 180).cast("int"), 500).withColumn("blocks", F.lit("calendar"))
    return rounded(by_fold.unionByName(by_date), ["horizon", "blocks"])


@query()
def a23_fingerprint(spark, sf):
    return V.fingerprint(B.brand_bars(spark, sf))


@query(sql(f"SELECT horizon, market, {r6('greatest(avg(actual_up), 1 - avg(actual_up))', 'baseline')} FROM records GROUP BY ALL", "records"))
def a24_baseline(spark, sf):
    out = records(spark, sf).groupBy("horizon", "market").agg(F.greatest(F.avg("actual_up"), 1 - F.avg("actual_up")).alias("baseline"))
    return rounded(out, ["horizon", "market"])


BT = "OVER (PARTITION BY symbol, horizon ORDER BY dt ROWS UNBOUNDED PRECEDING)"


@query(
    sql(
        f"""SELECT symbol, horizon, dt, {r6('equity', 'equity')}, {r6('hold', 'hold')}, {r6(f'equity / max(equity) {BT} - 1', 'drawdown')} FROM (SELECT *, exp(sum(ln(1 + ret / horizon)) {BT}) AS equity, exp(sum(ln(1 + buy_hold_return / horizon)) {BT}) AS hold FROM records)""",
        "records",
    )
)
def w04_backtest_equity(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "horizon").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = records(spark, sf).withColumns({"equity": F.exp(F.sum(F.log1p(F.col("ret") / F.col("horizon"))).over(w)), "hold": F.exp(F.sum(F.log1p(F.col("buy_hold_return") / F.col("horizon"))).over(w))})
    rows = rows.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)
    return rows.select("symbol", "horizon", "dt", *[R(c).alias(c) for c in ("equity", "hold", "drawdown")])


JOBS = "CASE WHEN symbol LIKE '%-USD' THEN 'v1' ELSE 'v0' END"


@query(sql(f"SELECT symbol, horizon FROM lengths, hs WHERE NOT (symbol LIKE '%-USD' AND horizon = 5)", "lengths", "hs"))
def j14_pending_jobs(spark, sf):
    """Jobs that no finished one covers: same symbol, horizon, configuration and data."""
    lengths = B.brand_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("fingerprint"))
    jobs = lengths.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in V.HORIZONS]))).withColumn("config", F.lit("v1"))
    done = jobs.where(F.col("symbol").endswith("-USD") & (F.col("horizon") == 5)).unionByName(jobs.where("symbol LIKE '%.WA'").withColumn("config", F.lit("v0")))
    return jobs.join(done, ["symbol", "horizon", "config", "fingerprint"], "left_anti").select("symbol", "horizon")
