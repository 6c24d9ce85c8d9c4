"""Market calendars: holiday rules, session tables, periods between dates, lifecycles, session gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import rules

#: Published full-day closures. Other years follow the rules (first list) or are unknown (second list).
NYSE_CLOSED = (
    "2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25 "
    "2027-01-01 2027-01-18 2027-02-15 2027-03-26 2027-05-31 2027-06-18 2027-07-05 2027-09-06 2027-11-25 2027-12-24 "
    "2028-01-17 2028-02-21 2028-04-14 2028-05-29 2028-06-19 2028-07-04 2028-09-04 2028-11-23 2028-12-25"
).split()
GPW_CLOSED = "2026-01-01 2026-01-06 2026-04-03 2026-04-06 2026-05-01 2026-06-04 2026-11-11 2026-12-24 2026-12-25 2026-12-31".split()

#: Easter Sunday in whole-number arithmetic on column y; floor(a / b) stands for whole division.
EASTER: rules.Layers = [
    {"ga": "y % 19", "gb": "floor(y / 100)", "gc": "y % 100"},
    {"gd": "floor(gb / 4)", "ge": "gb % 4", "gg": "floor((gb - floor((gb + 8) / 25) + 1) / 3)", "gi": "floor(gc / 4)", "gk": "gc % 4"},
    {"gh": "(19 * ga + gb - gd - gg + 15) % 30"},
    {"gl": "(32 + 2 * ge + 2 * gi - gh - gk) % 7"},
    {"gm": "floor((ga + 11 * gh + 22 * gl) / 451)"},
    {"gn": "gh + gl - 7 * gm + 114"},
    {"easter_month": "cast(floor(gn / 31) AS int)", "easter_day": "cast(gn % 31 + 1 AS int)"},
]


def years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))


def _date(month, day) -> Column:
    return F.make_date(F.col("y"), F.lit(month) if isinstance(month, int) else month, F.lit(day) if isinstance(day, int) else day)


def _nth(month: int, weekday: int, nth: int) -> Column:
    """weekday counts from Monday, 0."""
    first = _date(month, 1)
    return F.date_add(first, (F.lit(weekday) - F.weekday(first) + 7) % 7 + 7 * (nth - 1))


def _observed(month: int, day: int) -> Column:
    d = _date(month, day)
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def nyse_holidays(ys: DataFrame) -> DataFrame:
    """dt of full closures: published years as published, others by rule."""
    last_may = F.date_sub(_date(5, 31), F.weekday(_date(5, 31)))
    easter = F.make_date(F.col("y"), F.col("easter_month"), F.col("easter_day"))
    rule = F.array(_observed(1, 1), _nth(1, 0, 3), _nth(2, 0, 3), F.date_sub(easter, 2), last_may, _observed(6, 19), _observed(7, 4), _nth(9, 0, 1), _nth(11, 3, 4), _observed(12, 25))
    published = F.array(*[F.lit(d).cast("date") for d in NYSE_CLOSED])
    rows = rules.apply(ys, EASTER)
    days = F.when(F.col("y").between(2026, 2028), F.filter(published, lambda d: F.year(d) == F.col("y"))).otherwise(F.array_distinct(rule))
    return rows.select("y", F.explode(days).alias("dt"))


def gpw_holidays(ys: DataFrame) -> DataFrame:
    published = F.array(*[F.lit(d).cast("date") for d in GPW_CLOSED])
    return ys.where("y = 2026").select("y", F.explode(published).alias("dt"))


def sessions(ys: DataFrame) -> DataFrame:
    """kind, dt, is_session, n: sessions of the kind's calendar up to and with dt; a few hundred rows a year and kind.

    Years without a published closed list have no rows for that market: their sessions are unknown.
    """
    days = ys.select("y", F.explode(F.sequence(_date(1, 1), _date(12, 31))).alias("dt"))
    kinds = days.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("CRYPTO_24_7", "GPW", "NYSE")])))
    closed = nyse_holidays(ys).withColumn("kind", F.lit("NYSE")).unionByName(gpw_holidays(ys).withColumn("kind", F.lit("GPW"))).select("kind", "dt").distinct().withColumn("closed", F.lit(True))
    rows = kinds.join(closed, ["kind", "dt"], "left").where("kind <> 'GPW' OR y = 2026")
    is_session = (F.col("kind") == "CRYPTO_24_7") | ((F.weekday("dt") < 5) & F.col("closed").isNull())
    w = Window.partitionBy("kind").orderBy("dt")
    return rows.select("kind", "dt", is_session.alias("is_session")).withColumn("n", F.sum(F.col("is_session").cast("int")).over(w))


def periods_between(items: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """items (with kind) and periods: sessions after start up to end, null where the calendar is unknown."""
    c = calendar.select("kind", "dt", "n")
    a = c.select("kind", F.col("dt").alias(start), F.col("n").alias("__a"))
    b = c.select("kind", F.col("dt").alias(end), F.col("n").alias("__b"))
    out = items.join(a, ["kind", start], "left").join(b, ["kind", end], "left")
    return out.withColumn("periods", F.when(F.col(end) <= F.col(start), 0).otherwise(F.col("__b") - F.col("__a"))).drop("__a", "__b")


def lifecycle(items: DataFrame) -> DataFrame:
    """items with periods and horizon: elapsed, remaining, status."""
    bad = F.col("periods").isNull() | F.col("horizon").isNull() | (F.col("horizon") <= 0)
    status = F.when(bad, "UNKNOWN").when(F.col("periods") >= F.col("horizon"), "HORIZON_ENDED").otherwise("ACTIVE")
    return items.withColumns({"status": status, "remaining": F.when(~bad, F.greatest(F.col("horizon") - F.col("periods"), F.lit(0)))})


def weekday_number(d: Column) -> Column:
    """Weekdays since Monday, 1 January 1900, up to and with d; a weekend day counts as the Friday before."""
    days = F.datediff(d, F.lit("1900-01-01").cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))


def business_progress(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows with entry_dt and horizon: planned exit `horizon` weekdays on, sessions elapsed and remaining."""
    n = weekday_number(F.col("entry_dt"))
    to = n + F.col("horizon")
    exit_ = F.date_add(F.lit("1900-01-01").cast("date"), (F.floor(to / 5) * 7 + F.pmod(to, F.lit(5))).cast("int"))
    elapsed = F.greatest(weekday_number(as_of) - n, F.lit(0))
    return rows.withColumns({"planned_exit": exit_, "elapsed": elapsed.cast("int"), "remaining": F.greatest(F.col("horizon") - elapsed, F.lit(0)).cast("int")})


def missing_sessions(ledgers: DataFrame, calendar: DataFrame, target: Column, lookback: int = 45) -> DataFrame:
    """Sessions after each ledger's last audit up to the target; only the newest is to run, the others are missed."""
    c = calendar.where("is_session").select("kind", "dt")
    rows = ledgers.join(c, "kind").where((F.col("dt") > F.col("last_audit")) & (F.col("dt") <= target) & (F.col("dt") >= F.date_sub(target, lookback)))
    newest = F.max("dt").over(Window.partitionBy("ledger_id"))
    return rows.withColumn("action", F.when(F.col("dt") == newest, "RUN").otherwise("MISSED")).select("ledger_id", "dt", "action")


def bar_is_closed(now: Column, day: Column, hour: int = 22, minute: int = 20) -> Column:
    """Whether the bar of `day` is closed at UTC time `now`, by the local clock in Warsaw."""
    local = F.from_utc_timestamp(now, "Europe/Warsaw")
    ready = F.hour(local) * 60 + F.minute(local) >= hour * 60 + minute
    return (F.to_date(local) > day) | ((F.to_date(local) == day) & ready)
