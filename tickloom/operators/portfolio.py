"""Greedy selection inside portfolios of a few slots, whose serial part doesn't grow with the number of signals.

On one day a portfolio of S slots can take only signals that are early in its order: a symbol's second signal of a day fares no better than its
first, positions that are held block at most S symbols, and S new ones fill the slots. So the first signals of the first few symbols of each day are
all that a walk through the days has to see, however many signals there are; Spark finds them with partial aggregates and
limits inside tasks. Days on which no position can be open cut a portfolio's walk in parts that run side by side. What the walk
takes tells, by a join in Spark, why each other signal was refused.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.storage import stored


def forever() -> Column:
    return F.lit("9999-12-31").cast("date")


def same(keys: list[str], renamed: str = "__p") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"{renamed}{i}")) for i, k in enumerate(keys)])


def placed(signals: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, list[str]]:
    """signals, written, with the place of each inside its day: columns of the values of `order`, and a row number that tells equal ones apart."""
    names = [*[f"__o{i}" for i in range(len(order))], "__row_id"]
    return stored(signals.withColumns(dict(zip(names, [*order, F.monotonically_increasing_id()], strict=True))), name), names


def day_candidates(signals: DataFrame, portfolio: list[str], day: str, place: list[str], symbols: int, brief: Column) -> DataFrame:
    """The first signal of each of the first `symbols` symbols of a portfolio's day.

    brief: whether a position is over on the day that it begins. Such signals hold no slot up and are candidates all of them; each makes room for
    one symbol more, which it may block. There are none in sound data.
    """
    brief = F.coalesce(brief, F.lit(False))
    row = F.struct(*[F.col(c) for c in signals.columns])
    first = signals.where(~brief).groupBy(*portfolio, day, "symbol").agg(F.min(F.struct(F.struct(*place).alias("place"), row.alias("row"))).alias("first"))
    odd = signals.where(brief)
    more = odd.groupBy(*portfolio, day).agg(F.count("*").alias("__more")).withColumnsRenamed({k: f"__p{i}" for i, k in enumerate([*portfolio, day])})
    first = first.withColumn("r", F.row_number().over(Window.partitionBy(*portfolio, day).orderBy("first.place")))
    early = first.where(F.col("r") <= symbols)
    # places past the limit matter on days with brief positions only
    late = first.where(F.col("r") > symbols).join(more, same([*portfolio, day])).where(F.col("r") <= symbols + F.col("__more"))
    return early.select("first.row.*").unionByName(late.select("first.row.*")).unionByName(odd)


def day_parts(candidates: DataFrame, portfolio: list[str], day: str, until: str) -> DataFrame:
    """portfolio, day, part: a new part begins on a day before which every position that could be held is over."""
    days = candidates.groupBy(*portfolio, day).agg(F.max(F.coalesce(F.col(until), forever())).alias("last"))
    by_day = Window.partitionBy(*portfolio).orderBy(day)  # one row a day
    cut = (F.max("last").over(by_day.rowsBetween(Window.unboundedPreceding, -1)) < F.col(day)).cast("int")
    return days.withColumn("cut", F.coalesce(cut, F.lit(0))).select(*portfolio, day, F.sum("cut").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("part"))


def walked(candidates: DataFrame, portfolio: list[str], day: str, until: str, place: list[str], walk: Callable[[pd.DataFrame], list]) -> DataFrame:
    """The candidates that the walk takes, with their slots; walk: slots, or None, of a part's candidates in order."""
    parts = day_parts(candidates, portfolio, day, until).withColumnsRenamed({k: f"__p{i}" for i, k in enumerate([*portfolio, day])})
    rows = candidates.join(parts, same([*portfolio, day])).drop(*[f"__p{i}" for i in range(len(portfolio) + 1)])
    kept = candidates.columns
    schema = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in kept) + ", slot int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([day, *place], kind="stable")[kept]
        pdf = pdf.assign(slot=pd.array(walk(pdf), dtype="Int32"))
        return pdf[pdf["slot"].notna()]

    return rows.groupBy(*portfolio, "part").applyInPandas(run, schema)


def free_slot(held: dict, slots: int) -> int | None:
    return next((s for s in range(1, slots + 1) if s not in held), None)


def take_slots(pdf: pd.DataFrame, slots: int, most: int | None, day: str, until: str, reentry: bool, one_per_symbol: bool) -> list[int | None]:
    """Slots of the signals, in order, that find a free one; a position is over on the day after it ends, or on the day itself if `reentry`."""
    cap = slots if most is None else max(0, min(most, slots))
    held: dict[int, tuple] = {}  # slot: (symbol, until)
    out = []
    for symbol, start, end in zip(pdf["symbol"], pdf[day], pdf[until], strict=True):
        held = {s: x for s, x in held.items() if pd.isna(x[1]) or (x[1] > start if reentry else x[1] >= start)}
        blocked = one_per_symbol and any(x[0] == symbol for x in held.values())
        slot = None if blocked or len(held) >= cap else free_slot(held, slots)
        if slot:
            held[slot] = (symbol, end)
        out.append(slot)
    return out


class GateBook:
    """The open positions of one portfolio: symbol: (day of the exit or None, slot; 0 once it is over). Signals come in order of days."""

    def __init__(self, slots: int, most: int, held: dict[str, tuple] | None = None):
        self.slots, self.most, self.held = slots, most, held or {}

    def decide(self, symbol: str, day, until) -> tuple[str, int | None]:
        """Same-day re-entry, open symbol, free slot, cap, in this order; a position that ends on the day keeps its symbol till the next day, not its slot."""
        self.held = {k: (e, s if e is None or e > day else 0) for k, (e, s) in self.held.items() if e is None or e >= day}
        used = {s: None for _, s in self.held.values() if s}
        slot = free_slot(used, self.slots)
        if symbol in self.held:
            return "SAME_DAY_REENTRY" if self.held[symbol][0] == day else "SYMBOL_OPEN", None
        if slot is None:
            return "NO_FREE_SLOT", None
        if self.most and len(used) >= self.most:
            return "MAX_POSITIONS", None
        self.held[symbol] = (until, slot)
        return "ACCEPTED", slot


def gate_slots(pdf: pd.DataFrame, slots: int, most: int, day: str, until: str) -> list[int | None]:
    book = GateBook(slots, most)
    return [book.decide(symbol, start, None if pd.isna(end) else end)[1] for symbol, start, end in zip(pdf["symbol"], pdf[day], pdf[until], strict=True)]


def explained(signals: DataFrame, taken: DataFrame, portfolio: list[str], day: str, until: str, place: list[str], said: Callable[[Column, Column], Column]) -> DataFrame:
    """signals with slot and `said`: a function of slot and of the end of the position of the same symbol that was taken earlier and isn't over before the day.

    A symbol's positions don't overlap in a portfolio: there is one such position, or one that ends on the day and one that begins on it. The
    join has portfolio, symbol and month as keys; what has no end is looked up by its symbol.
    """
    keys = [*portfolio, "symbol"]
    held = taken.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)], F.col(day).alias("__start"), F.col(until).alias("__until"), F.struct(*place).alias("__before"))
    month = lambda c: F.trunc(c, "month")
    ended = held.where("__until IS NOT NULL").withColumn("__month", F.explode(F.sequence(month("__start"), F.greatest(month("__start"), month("__until")), F.expr("interval 1 month"))))
    endless = held.where("__until IS NULL").groupBy(*[f"__p{i}" for i in range(len(keys))]).agg(F.min(F.struct("__start", "__before")).alias("__o"))
    asks = signals.select(*keys, "__row_id", day, F.struct(*place).alias("__place"), month(day).alias("__at"))

    def earlier(start: str, before: str) -> Column:
        return (F.col(start) < F.col(day)) | ((F.col(start) == F.col(day)) & (F.col(before) < F.col("__place")))

    met = asks.join(ended, same(keys) & (F.col("__at") == F.col("__month"))).where(earlier("__start", "__before") & (F.col("__until") >= F.col(day))).select("__row_id", "__until")
    met = met.unionByName(asks.join(endless, same(keys)).where(earlier("__o.__start", "__o.__before")).select("__row_id", forever().alias("__until")))
    met = met.groupBy(F.col("__row_id").alias("__met")).agg(F.max("__until").alias("__last"))
    own = taken.select(F.col("__row_id").alias("__row"), "slot")
    out = signals.join(own, F.col("__row_id") == F.col("__row"), "left").join(met, F.col("__row_id") == F.col("__met"), "left")
    return out.withColumn("said", said(F.col("slot"), F.col("__last"))).drop("__row", "__met", "__last", "__row_id", *place)
