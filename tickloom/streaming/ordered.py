"""Stateful operators that see each key's rows in time order: rows wait until the watermark has passed their day.

What comes later than the watermark is dropped, what comes twice counts once, and so the result is that of the batch form over the same rows, in
whatever order and in however many batches they come. State is the waiting rows of a key, one small value of the operator, and a timer.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tickloom.operators.portfolio import GateBook

DAY_MS = 86_400_000


class InOrder(StatefulProcessor):
    """Keeps rows of `columns` (the first is `at`, milliseconds) till their day is over, and hands them to `step` in order of all columns."""

    columns: list[tuple[str, str]]
    output: list[str]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in self.columns))
        self.passed = handle.getValueState("passed", "at long")
        self.kept = handle.getValueState("kept", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = self.passed.get()[0] if self.passed.exists() else -math.inf
        kinds, fresh = {"long": int, "int": int, "double": float, "string": str}, []
        for pdf in rows:
            values = [[None if pd.isna(x) else kinds[t](x) for x in pdf[n]] for n, t in self.columns]
            fresh += [r for r in zip(*values, strict=True) if r[0] + DAY_MS > passed]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(r[0] for r in fresh) + DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        due, rest = [r for r in rows if r[0] + DAY_MS <= now], [r for r in rows if r[0] + DAY_MS > now]
        self.waiting.clear()
        if rest:
            self.waiting.appendList(rest)
            self.handle.registerTimer(min(r[0] for r in rest) + DAY_MS)
        self.passed.update((now,))
        if due:
            kept = json.loads(self.kept.get()[0]) if self.kept.exists() else None
            due = sorted(set(due), key=lambda r: tuple((x is None, x) for x in r))
            out, kept = self.step(key, due, kept)
            self.kept.update((json.dumps(kept),))
            if out:
                yield pd.DataFrame(out, columns=self.output)

    def close(self) -> None:
        pass

    def step(self, key, rows: list[tuple], kept) -> tuple[list[tuple], object]:
        """Output rows of some days, in order, and what to keep."""
        raise NotImplementedError


class Gate(InOrder):
    """The portfolio gate; days are numbers since 1970. A signal that comes again counts once."""

    columns = [("at", "long"), ("symbol", "string"), ("signal_id", "string"), ("day", "int"), ("until", "int")]
    output = ["ledger_id", "signal_id", "symbol", "day", "until", "decision", "slot"]

    def __init__(self, slots: int, most: int):
        self.slots, self.most = slots, most

    def step(self, key, rows, kept):
        book = GateBook(self.slots, self.most, {k: tuple(v) for k, v in (kept or {}).items()})
        out, seen = [], set()
        for _, symbol, signal_id, day, until in rows:
            if signal_id not in seen:
                seen.add(signal_id)
                decision, slot = book.decide(symbol, int(day), None if until is None else int(until))
                out.append((key[0], signal_id, symbol, int(day), until, decision, slot))
        return out, {k: list(v) for k, v in book.held.items()}


class MarketContext(InOrder):
    """A symbol's bars with its benchmark's close as of each: that of the day, else the one before; and its log returns over rows."""

    columns = [("at", "long"), ("own", "int"), ("close", "double")]

    def __init__(self, spans: tuple[int, ...]):
        self.spans = spans
        self.output = ["symbol", "at", "close", "market_close", *[f"market_ret_{n}" for n in spans]]

    def step(self, key, rows, kept):
        day, today, seen = (kept or {}).get("day"), (kept or {}).get("today"), (kept or {}).get("seen", [])
        out = []
        for at, own, close in rows:  # at one instant the benchmark's bar, own 0, comes first
            if not own:
                day, today = at, close
                continue
            market = today if day == at else seen[-1] if seen else None
            seen = [*seen[-max(self.spans) :], market]
            back = lambda n, seen=seen: seen[-1 - n] if len(seen) > n else None
            out.append((key[0], at, close, market, *[math.log(market / back(n)) if market and back(n) else None for n in self.spans]))
        return out, {"day": day, "today": today, "seen": seen}


def _in_order(stream: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def gated(signals: DataFrame, slots: int = 5, most: int = 5, late: str = "1 day") -> DataFrame:
    """A stream of signals (ts, ledger_id, signal_id, symbol, signal_date, exit_date) with the gate's decisions, each once its day is over."""
    rows = signals.withWatermark("ts", late).select("ts", "ledger_id", "symbol", "signal_id", F.unix_millis("ts").alias("at"), F.unix_date("signal_date").alias("day"), F.unix_date("exit_date").alias("until"))
    out = _in_order(rows, "ledger_id", Gate(slots, most), "ledger_id string, signal_id string, symbol string, day int, until int, decision string, slot int")
    return out.select("ledger_id", "signal_id", "symbol", F.date_from_unix_date("day").alias("signal_date"), F.date_from_unix_date("until").alias("exit_date"), "decision", "slot")


def market_context(bars: DataFrame, benchmarks: DataFrame, spans: tuple[int, ...], late: str = "1 day") -> DataFrame:
    """A stream of bars (ts, symbol, close), the benchmarks' own among them, with each symbol's benchmark as of its bars.

    benchmarks (symbol, benchmark) is a table: a benchmark's bar goes to every symbol that it is the benchmark of, so a symbol is a key, however
    many share a benchmark; that is one row for each symbol and day, as many as there are bars.
    """
    bars = bars.withWatermark("ts", late)
    own = bars.select("ts", "symbol", F.unix_millis("ts").alias("at"), F.lit(1).alias("own"), "close")
    market = bars.withColumnRenamed("symbol", "benchmark").join(benchmarks, "benchmark").select("ts", "symbol", F.unix_millis("ts").alias("at"), F.lit(0).alias("own"), "close")
    schema = ", ".join(["symbol string, at long, close double, market_close double", *[f"market_ret_{n} double" for n in spans]])
    out = _in_order(own.unionByName(market), "symbol", MarketContext(spans), schema)
    return out.withColumn("dt", F.to_date(F.timestamp_millis("at"))).drop("at")
