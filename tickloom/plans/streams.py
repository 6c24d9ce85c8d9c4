"""Queries that drain a stream of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.functions.columns import r6 as R
from tickloom.operators import features as X
from tickloom.operators import radar as RD
from tickloom.plans import radar as PR
from tickloom.plans.ledger import done
from tickloom.plans.prices import CTX
from tickloom.plans.reality import calendar
from tickloom.plans.registry import ORACLES, query
from tickloom.plans.sqltext import W, r6, sql
from tickloom.sources import bars as B
from tickloom.sources.storage import stored
from tickloom.streaming import jobs as S
from tickloom.streaming import ordered as O

#: Streams come in parts, split at this day.
MIDDLE = "1996-01-01"
DAY = "CAST(date_trunc('day', ts) AS DATE)"


@query(
    f"""SELECT {DAY} AS dt, event_type, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, first(value ORDER BY ts DESC, event_id DESC) AS close, count(*) AS n FROM events GROUP BY ALL"""
)
def st01_stream_bars(spark, sf):
    """Complete mode: after the drain all windows are there, the open ones too."""
    out = S.drained(S.bars(S.read_events(spark, sf)), "bars", "complete")
    return out.select(F.to_date("window.start").alias("dt"), "event_type", "open", "high", "low", "close", "n")


@query(
    f"""SELECT start, event_type, {r6('first(value ORDER BY ts DESC, event_id DESC) - first(value ORDER BY ts, event_id)', 'move')}, {r6('stddev_samp(value)', 'spread')}
    FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS start FROM events) GROUP BY start, event_type"""
)
def st02_sliding_momentum(spark, sf):
    out = S.drained(S.sliding_momentum(S.read_events(spark, sf)), "slide", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", R("move").alias("move"), R("spread").alias("spread"))


def flushed(spark, sf, of, name):
    """What a stream of the events gives once all its windows are closed."""
    return S.drained_in_parts([B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))], of, name)


GAPS = "SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events"


@query(f"SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM ({GAPS})) GROUP BY user_id, s")
def st03_session_windows(spark, sf):
    out = flushed(spark, sf, S.session_windows, "sessions")
    return out.select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query(f"SELECT {DAY} AS dt, event_type, count(*) AS n FROM events GROUP BY ALL")
def st04_late_data(spark, sf):
    """Windows that the watermark has closed, after the flush all of them; late events for a closed window are dropped."""
    return flushed(spark, sf, S.bars, "closed").select(F.to_date("window.start").alias("dt"), "event_type", "n")


TARGET = "2001-12-10"


@query(ORACLES["k08_missing_sessions"])
def st04_session_gaps(spark, sf):
    """K-08 from a stream of trades, halves of the years one after the other."""
    trades = rules.apply(B.trades(spark, sf).select("symbol", "dt"), rules.CLASS[:1]).where("calendar_kind <> 'GPW'")
    trades = trades.select(F.col("dt").cast("timestamp").alias("ts"), "symbol", F.col("calendar_kind").alias("kind"))
    parts = [trades.where(f"ts < '{MIDDLE}'"), trades.where(f"ts >= '{MIDDLE}'")]
    return S.session_gaps(parts, calendar(spark), F.lit(TARGET).cast("date"), "gaps")


@query(ORACLES["f06_portfolio_gate"])
def st05_position_lifecycle(spark, sf):
    """The decisions of the portfolio gate from a stream of signals, which come in no order."""
    signals = stored(done(spark, sf).select(F.col("signal_date").cast("timestamp").alias("ts"), "ledger_id", "signal_id", "symbol", "signal_date", "exit_date"), "signals")
    early = F.col("signal_date") < MIDDLE
    out = S.drained_in_parts([signals.where(early), signals.where(~early)], O.gated, "gate")
    return out.where("ledger_id IS NOT NULL")


@query("SELECT DISTINCT event_id FROM events")
def st06_stream_dedup(spark, sf):
    stream = S.read_events(spark, sf)
    return S.drained(S.deduplicated(stream, ["event_id"]).select("event_id"), "dedup")


@query(ORACLES["m17_fast_scan"])
def st07_continuous_refresh(spark, sf):
    """The fast scan of all symbols, refreshed by batches of new bars; only the symbols of a batch are scanned again."""
    bars = stored(B.brand_bars(spark, sf).withColumn("ts", F.col("dt").cast("timestamp")), "bars")
    # most symbols have bars in all parts, one has none in the last
    parts = [bars.where(f"ts < '{MIDDLE}'"), bars.where(f"ts >= '{MIDDLE}' AND symbol <> '^B13'"), bars.where(f"ts >= '{MIDDLE}' AND symbol = '^B13'")]
    return PR.take(S.refreshed_scan(parts, RD.fast_scan, "refresh"), [*PR.KEY, *PR.FAST_COLUMNS])


CONTEXT = ", ".join(r6(f"ln(mc / lag(mc, {n}) OVER {W})", f"market_ret_{n}") for n in X.CONTEXT)


@query(sql(f"SELECT symbol, dt, {r6('mc', 'market_close')}, {CONTEXT} FROM {CTX}", "base"))
def st08_stream_context(spark, sf):
    """Each bar's benchmark as of its day, from a stream of bars in two parts."""
    bars = stored(B.brand_bars(spark, sf).select(F.col("dt").cast("timestamp").alias("ts"), "symbol", "close"), "bars")
    benchmarks = stored(bars.select("symbol").distinct().select("symbol", B.benchmark_of(F.col("symbol")).alias("benchmark")).where("benchmark IS NOT NULL"), "benchmarks")
    out = S.drained_in_parts([bars.where(f"ts < '{MIDDLE}'"), bars.where(f"ts >= '{MIDDLE}'")], lambda s: O.market_context(s, benchmarks, X.CONTEXT), "context")
    return out.where("symbol IS NOT NULL").select("symbol", "dt", *[R(c).alias(c) for c in ("market_close", *[f"market_ret_{n}" for n in X.CONTEXT])])
