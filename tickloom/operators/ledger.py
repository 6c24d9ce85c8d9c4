"""Signals, executions, the event ledger and the journal, as tables.

Events are append-only rows (ledger_id, seq, event_type, signal_id, ...); state is one aggregation over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators import portfolio as P
from tickloom.operators.validation import profit_factor, with_median
from tickloom.sources.storage import shared_folder, stored

COST = 0.0015


def sessions(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("dt")))


def next_session(signals: DataFrame, numbered: DataFrame, strict: bool) -> DataFrame:
    """signals with next_pos: the first session after the signal date (or on it), by a merge in date order."""
    marks = numbered.select("symbol", "dt", F.col("pos").alias("next_pos"), F.lit(0 if strict else 1).alias("o"), F.lit(None).cast("string").alias("signal_id"))
    asks = signals.select("symbol", F.col("signal_date").alias("dt"), F.lit(None).cast("int").alias("next_pos"), F.lit(1 if strict else 0).alias("o"), "signal_id")
    # from late to early: the last session seen is the next one; at one date the order says whether it counts
    w = Window.partitionBy("symbol").orderBy(F.desc("dt"), F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asks).withColumn("next_pos", F.last("next_pos", ignorenulls=True).over(w)).where("signal_id IS NOT NULL")
    return signals.join(found.select("signal_id", "next_pos"), "signal_id")


def executed(signals: DataFrame, bars: DataFrame, journal: bool = False) -> DataFrame:
    """Entry at the next session's open after the signal date, exit `horizon` sessions on; the journal enters one session after the first on or past it."""
    n = sessions(bars)
    rows = next_session(signals, n, strict=not journal).withColumn("entry_pos", F.col("next_pos") + (1 if journal else 0))
    entry = n.select("symbol", F.col("pos").alias("entry_pos"), F.col("dt").alias("entry_date"), F.col("open").alias("entry_price"))
    exit_ = n.select("symbol", F.col("pos").alias("exit_pos"), F.col("dt").alias("exit_date"), F.col("open").alias("exit_price"))
    last = n.groupBy("symbol").agg(F.max("pos").alias("last_pos"))
    rows = rows.join(entry, ["symbol", "entry_pos"], "left").withColumn("exit_pos", F.col("entry_pos") + F.col("horizon"))
    rows = rows.join(exit_, ["symbol", "exit_pos"], "left").join(last, "symbol")
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    gross = sign * (F.col("exit_price") / F.col("entry_price") - 1)
    elapsed = F.when(F.col("entry_price").isNull(), 0).otherwise(F.least(F.col("horizon"), F.greatest(F.lit(0), F.col("last_pos") - F.col("entry_pos"))))
    return rows.withColumns(
        {
            "status": F.when(F.col("exit_price").isNotNull(), "closed").otherwise("open"),
            "gross_return": gross,
            "strategy_return": gross - (0.0 if journal else COST),
            "hit": (gross - (0.0 if journal else COST)) > 0,
            "bars_elapsed": elapsed,
            "bars_remaining": F.col("horizon") - elapsed,
        }
    )


def new_signals(signals: DataFrame, known: DataFrame) -> DataFrame:
    """Signals whose id isn't known; of repeats in the batch the first stays, in order of their other columns."""
    others = [c for c in signals.columns if c != "signal_id"]
    first = signals.groupBy("signal_id").agg(F.min(F.struct(*others)).alias("s")).select("signal_id", "s.*").select(*signals.columns)
    return first.join(known.select("signal_id"), "signal_id", "left_anti")


def refresh_merge(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh evaluations replace known rows that aren't closed and are unchanged since the evaluation read them."""
    f = fresh.select("signal_id", F.col("status").alias("n_status"), F.col("strategy_return").alias("n_return"), F.col("token").alias("n_token"))
    rows = known.join(f, "signal_id", "left")
    take = (F.col("status") != "closed") & F.col("n_status").isNotNull() & F.col("token").eqNullSafe(F.col("n_token"))
    return rows.select("signal_id", F.when(take, F.col("n_status")).otherwise(F.col("status")).alias("status"), F.when(take, F.col("n_return")).otherwise(F.col("strategy_return")).alias("strategy_return"))


def events(trades: DataFrame) -> DataFrame:
    """Ledger events of executed signals, numbered in each ledger by date and kind."""

    def of(kind, order, day, where, *cols):
        values = [F.col(c) if c in cols else F.lit(None).cast("double" if c.endswith(("price", "return")) else "date").alias(c) for c in ("entry_date", "entry_price", "exit_date", "exit_price", "strategy_return")]
        return trades.where(where).select("ledger_id", F.lit(kind).alias("event_type"), F.lit(order).alias("o"), F.col(day).alias("event_date"), "signal_id", "symbol", *values)

    parts = [
        of("SIGNAL_OBSERVED", 2, "signal_date", "true"),
        of("POSITION_ACCEPTED", 3, "signal_date", "accepted"),
        of("POSITION_SKIPPED", 3, "signal_date", "NOT accepted"),
        of("ENTRY_FILLED", 0, "entry_date", "accepted AND entry_date IS NOT NULL", "entry_date", "entry_price"),
        of("POSITION_CLOSED", 1, "exit_date", "accepted AND exit_date IS NOT NULL", "exit_date", "exit_price", "strategy_return"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return numbered(rows, ["ledger_id"], "event_date", ["o", "signal_id"]).drop("o")


def numbered(rows: DataFrame, group: list[str], day: str, order: list[str], name: str = "seq") -> DataFrame:
    """rows with their number in the group, by day and then `order`: a window sees one day of a group, the days are laid end to end by their counts."""
    days = rows.groupBy(*group, day).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumnsRenamed({k: f"__p{i}" for i, k in enumerate([*group, day])}).drop("__n")
    place = F.row_number().over(Window.partitionBy(*group, day).orderBy(*order))
    out = rows.join(days, P.same([*group, day])).withColumn(name, (F.col("__before") + place).cast("int"))
    return out.drop("__before", *[f"__p{i}" for i in range(len(group) + 1)])


def state(evts: DataFrame) -> DataFrame:
    """Latest state of each signal: a later event's fields overwrite earlier ones."""

    def latest(field, kind):
        return F.max_by(F.when(F.col("event_type") == kind, F.col(field)), F.when(F.col("event_type") == kind, F.col("seq"))).alias(field)

    rank = F.when(F.col("event_type") == "POSITION_CLOSED", 4).when(F.col("event_type") == "ENTRY_FILLED", 3).when(F.col("event_type") == "POSITION_SKIPPED", 2).when(F.col("event_type") == "POSITION_ACCEPTED", 1).otherwise(0)
    rows = evts.groupBy("ledger_id", "signal_id").agg(
        F.first("symbol").alias("symbol"), F.max("seq").alias("last_seq"), F.max(F.when(rank > 0, F.struct("seq", rank.alias("r")))).alias("s"),
        latest("entry_date", "ENTRY_FILLED"), latest("entry_price", "ENTRY_FILLED"), latest("exit_date", "POSITION_CLOSED"), latest("exit_price", "POSITION_CLOSED"), latest("strategy_return", "POSITION_CLOSED"),
    )
    r = F.col("s.r")
    status = F.when(r == 4, "CLOSED").when(r == 3, "OPEN").when(r == 2, "SKIPPED").when(r == 1, "ACCEPTED").otherwise("PENDING")
    return rows.withColumn("status", status).drop("s")


GENESIS = "GENESIS"
#: Rows of a ledger whose links one task of an audit compares.
SEGMENT = 10_000


def canonical(fields: dict[str, str], columns: dict[str, Column] | None = None) -> Column:
    """One JSON object of the columns, as text: keys in order, no spaces, null as null, doubles with twelve digits after the point, dates as text.

    fields: kinds (text, number, date, whole) by name; columns: what stands for a name, if it isn't the column of that name.
    """
    parts = []
    for name in sorted(fields):
        c = (columns or {}).get(name, F.col(name))
        value = {"number": lambda c: F.format_string("%.12f", c), "whole": lambda c: c.cast("string")}.get(fields[name], lambda c: F.concat(F.lit('"'), escaped(c.cast("string")), F.lit('"')))(c)
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(F.when(c.isNotNull(), value), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def escaped(c: Column) -> Column:
    """Text as it stands in a JSON string: quotes, backslashes and line ends escaped."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


#: What an event's hash covers, with the hash before it.
EVENT_FIELDS = {"ledger_id": "text", "seq": "whole", "event_type": "text", "event_date": "date", "signal_id": "text", "symbol": "text", "entry_date": "date", "entry_price": "number", "exit_date": "date", "exit_price": "number", "strategy_return": "number"}
_MARK = "\u0000"


def payloads(evts: DataFrame) -> DataFrame:
    """ledger_id, seq, payload: the canonical text of each event, with a mark where the hash before it stands."""
    text = canonical({**EVENT_FIELDS, "previous_hash": "text"}, {"previous_hash": F.lit(_MARK)})
    return evts.select("ledger_id", "seq", text.alias("payload"))


def chain_append(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """ledger_id, seq, payload, previous_hash, event_hash: the chain of each ledger goes on from its head; events: ledger_id, seq, payload.

    The hash before stands where the payload has its mark, or before the payload if it has none.

    heads (ledger_id, event_hash) is a table with a row for each ledger that has events. A chain is serial; its ledger's rows stream by in order, and
    one hash is held.
    """
    seeds = heads.select(F.col("ledger_id").alias("__id"), F.col("event_hash").alias("seed")) if heads is not None else None
    rows = events.select("ledger_id", "seq", "payload")
    rows = rows.join(seeds, F.col("ledger_id").eqNullSafe(F.col("__id")), "left").drop("__id") if seeds is not None else rows.withColumn("seed", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = None, GENESIS
        for batch in batches:
            previous, hashes = [], []
            for ledger_id, payload, seed in zip(*(batch.column(c).to_pylist() for c in ("ledger_id", "payload", "seed")), strict=True):
                if (ledger_id,) != at:
                    at, before = (ledger_id,), seed or GENESIS
                previous.append(before)
                linked = payload.replace(_MARK, before) if _MARK in payload else f"{before}|{payload}"
                before = hashlib.sha256(linked.encode("utf-8", "surrogatepass")).hexdigest()
                hashes.append(before)
            yield pa.RecordBatch.from_arrays([batch.column("ledger_id"), batch.column("seq"), batch.column("payload"), pa.array(previous, pa.string()), pa.array(hashes, pa.string())], names=["ledger_id", "seq", "payload", "previous_hash", "event_hash"])

    ordered = rows.repartition("ledger_id").sortWithinPartitions("ledger_id", "seq")
    return ordered.mapInArrow(run, "ledger_id string, seq int, payload string, previous_hash string, event_hash string")


def chain_heads(chained: DataFrame) -> DataFrame:
    return chained.groupBy("ledger_id").agg(F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"))


def chain_audit(chained: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The first event of each ledger whose link or hash doesn't hold; every event is checked by itself, links inside segments of a ledger and over their seams."""
    rows = chained.withColumn("__segment", F.floor(F.col("seq") / segment))
    ends = rows.groupBy(F.col("ledger_id").alias("__ledger"), (F.col("__segment") + 1).alias("__next")).agg(F.max_by("event_hash", "seq").alias("__seam"))
    w = Window.partitionBy("ledger_id", "__segment").orderBy("seq")
    rows = rows.withColumns({"__lag": F.lag("event_hash").over(w), "__first": F.row_number().over(w) == 1})
    rows = rows.join(ends, F.col("ledger_id").eqNullSafe(F.col("__ledger")) & (F.col("__segment") == F.col("__next")) & F.col("__first"), "left")
    before = F.coalesce("__lag", "__seam", F.lit(GENESIS))
    marked = F.contains(F.col("payload"), F.lit(_MARK))
    own = F.sha2(F.when(marked, F.replace(F.col("payload"), F.lit(_MARK), F.col("previous_hash"))).otherwise(F.concat_ws("|", "previous_hash", "payload")), 256)
    rows = rows.withColumn("issue", F.when(F.col("previous_hash") != before, "BROKEN_LINK").when(F.col("event_hash") != own, "HASH_MISMATCH"))
    out = rows.groupBy("ledger_id").agg(F.count("*").alias("n_events"), F.min(F.when(F.col("issue").isNotNull(), F.struct("seq", "issue"))).alias("b"))
    return out.select("ledger_id", "n_events", "b.seq", "b.issue")


# intake


class Intake:
    """Batches of signals, each taken whole or not at all: written to a folder of its own, and there once its marker is.

    A batch that is handed in again replaces itself. checks: names and conditions that every row must meet.
    """

    def __init__(self, spark, name: str, checks: dict[str, Column]):
        self.spark, self.at, self.checks = spark, shared_folder(spark, name), checks

    def submit(self, batches: DataFrame) -> DataFrame:
        """batch_id, rows, failed: batches (batch_id and signals) are written in one job; only those without a failed row get their marker. Returns all verdicts."""
        failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in self.checks.items()]))
        rows = stored(batches.withColumn("__failed", failed), "intake")
        verdicts = rows.groupBy("batch_id").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__failed")))), ",").alias("failed"))
        verdicts = stored(verdicts, "verdicts")
        good = verdicts.where("failed = ''").select(F.col("batch_id").alias("__batch"))
        conf = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(conf, "static")
        self.spark.conf.set(conf, "dynamic")
        try:
            rows.drop("__failed").write.mode("overwrite").partitionBy("batch_id").parquet(f"{self.at}/staged")
            # the markers are a table: what isn't in it doesn't exist for a reader
            good.withColumn("batch_id", F.col("__batch")).write.mode("overwrite").partitionBy("batch_id").parquet(f"{self.at}/committed")
        finally:
            self.spark.conf.set(conf, before)
        return verdicts

    def signals(self) -> DataFrame:
        """Rows of the batches that have their marker; of a signal in several batches the one of the first."""
        staged, done = (self.spark.read.option("basePath", f"{self.at}/{x}").parquet(f"{self.at}/{x}") for x in ("staged", "committed"))
        rows = staged.join(done.select(F.col("__batch")), F.col("batch_id").cast("string") == F.col("__batch"), "left_semi")
        others = [c for c in rows.columns if c not in ("signal_id", "batch_id")]
        return rows.groupBy("signal_id").agg(F.min_by(F.struct(*others, "batch_id"), "batch_id").alias("s")).select("signal_id", "s.*")

    def audits(self) -> DataFrame:
        """ledger_id, snapshot: one audit event for each snapshot of which a batch was taken, however often it came."""
        return self.signals().select("ledger_id", F.col("signal_date").alias("snapshot")).distinct()


# watchlist


def watch_versions(history: DataFrame | None, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """History of a watchlist after a batch: keys, state, valid_from, valid_to (null: active); versions that ended are kept.

    fresh: keys, at, state; state null archives. A state that doesn't change goes on; each key has one active version at most. A batch is later than
    what is known; a batch that comes again changes nothing.
    """
    changes = fresh.select(*keys, F.col("at").alias("valid_from"), "state")
    ended = None
    if history is not None:
        active = history.where("valid_to IS NULL")
        ended = history.where("valid_to IS NOT NULL")
        last = history.groupBy(*keys).agg(F.max(F.coalesce("valid_to", "valid_from")).alias("__last")).withColumnsRenamed({k: f"__p{i}" for i, k in enumerate(keys)})
        late = changes.join(last, P.same(keys), "left").where("__last IS NULL OR valid_from > __last").drop("__last", *[f"__p{i}" for i in range(len(keys))])
        changes = active.select(*keys, "valid_from", "state").unionByName(late)
    w = Window.partitionBy(*keys).orderBy("valid_from")  # a key's changes of one batch
    moved = changes.withColumn("__was", F.lag(F.struct("state")).over(w)).where("__was IS NULL OR NOT (__was.state <=> state)")
    rows = moved.withColumn("valid_to", F.lead("valid_from").over(w)).where("state IS NOT NULL").select(*keys, "state", "valid_from", "valid_to")
    return rows if ended is None else ended.select(*rows.columns).unionByName(rows)


def health(evts: DataFrame, slots: int) -> DataFrame:
    evts = stored(evts, "events")
    states = stored(state(evts), "state")
    counts = states.groupBy("ledger_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PENDING", "ACCEPTED", "OPEN", "CLOSED", "SKIPPED")], F.count("*").alias("signals"), F.avg("strategy_return").alias("mean_return"), F.avg((F.col("strategy_return") > 0).cast("double")).alias("hit_rate"))
    counts = with_median(counts, states.where("status = 'CLOSED'"), ["ledger_id"], "strategy_return")
    days = evts.groupBy("ledger_id").agg(F.count("*").alias("events"), F.count_distinct(F.when(F.col("event_type") == "SIGNAL_OBSERVED", F.col("event_date"))).alias("signal_days"))
    return counts.join(days, "ledger_id").withColumn("free_slots", F.lit(slots) - F.col("n_open") - F.col("n_accepted"))


def journal_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and returns of the closed rows; the drawdown is in order of the signals' days, of the exits' where there are none."""
    closed = F.col("status") == "closed"
    rows, x = stored(rows, "journal"), F.when(closed, F.col("strategy_return"))
    report = rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.avg(x).alias("average_return"), F.avg(x).alias("expectancy"),
        F.max(x).alias("best_return"), F.min(x).alias("worst_return"), profit_factor(x).alias("profit_factor"), ratio(F.avg(F.when(x > 0, x)), -F.avg(F.when(x < 0, x))).alias("payoff_ratio"),
    )
    ended = rows.where(closed)
    report = with_median(report, ended, by, "strategy_return")
    day = "signal_date" if "signal_date" in rows.columns else "exit_date"
    falls = worst_fall(ended, by, day, ["signal_id"], "strategy_return").withColumnsRenamed({k: f"__p{i}" for i, k in enumerate(by)})
    return report.join(falls, P.same(by), "left").drop(*[f"__p{i}" for i in range(len(by))])


def worst_fall(rows: DataFrame, group: list[str], day: str, order: list[str], value: str) -> DataFrame:
    """group, max_drawdown of the compounded returns in order of days: windows see a day of a group, or the days of one, never its rows."""
    inside = Window.partitionBy(*group, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*group, day, *order, F.log1p(value).alias("g")).withColumn("up", F.sum("g").over(inside))
    rows = rows.withColumn("high", F.max("up").over(inside))
    days = rows.groupBy(*group, day).agg(F.sum("g").alias("move"), F.max("up").alias("top"))
    before = Window.partitionBy(*group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("base", F.coalesce(F.sum("move").over(before), F.lit(0.0)))
    days = days.withColumn("peak", F.max(F.col("base") + F.col("top")).over(before)).withColumnsRenamed({k: f"__d{i}" for i, k in enumerate([*group, day])}).drop("move", "top")
    rows = rows.join(days, P.same([*group, day], "__d"))
    fall = F.exp(F.col("base") + F.col("up") - F.greatest(F.col("base") + F.col("high"), F.col("peak"))) - 1
    return rows.groupBy(*group).agg(F.min(fall).alias("max_drawdown"))


def compared(items: DataFrame, current: DataFrame) -> DataFrame:
    """comparison and the changes of each watched item against its current analysis.

    items: item_id, key, symbol, horizon, decision (1, 0, -1, null: invalid), probability_up, expected_return, quality; current: the same with key, at most one row
    for each key. An item without a current analysis, or with one of another symbol or horizon, isn't compared.
    """
    now = current.select(F.col("key").alias("__key"), F.lit(True).alias("__there"), *[F.col(c).alias(f"now_{c}") for c in ("symbol", "horizon", "decision", "probability_up", "expected_return", "quality")])
    rows = items.join(now, F.col("key") == F.col("__key"), "left")
    then, after = F.col("decision"), F.col("now_decision")
    other = (F.col("symbol") != F.col("now_symbol")) | (F.col("horizon") != F.col("now_horizon"))
    said = (
        F.when(F.col("__there").isNull(), "NO_CURRENT_ANALYSIS")
        .when(other, "MISMATCH")
        .when(then.isNull() | after.isNull(), "DECISION_UNAVAILABLE")
        .when((then == 0) & (after == 0), "UNCHANGED")
        .when(then == 0, "GAINED_CONFIRMATION")
        .when(then == after, "STILL_CONFIRMED")
        .when(after == 0, "WEAKENED")
        .otherwise("REVERSED")
    )
    rows = rows.withColumn("comparison", said)
    told = ~F.col("comparison").isin("NO_CURRENT_ANALYSIS", "MISMATCH")
    changed = F.when(F.col("quality") == F.col("now_quality"), "SAME").otherwise(F.concat_ws(">", "quality", "now_quality"))
    return rows.select("item_id", "comparison", *[F.when(told, F.col(f"now_{c}") - F.col(c)).alias(f"delta_{c}") for c in ("probability_up", "expected_return")], F.when(told, changed).alias("quality_change"))


def paper_portfolio(rows: DataFrame, by: str, capital: float = 10_000.0, fraction: float = 0.1, cost_bps: float = 20.0) -> DataFrame:
    """Sequential paper portfolio of closed entries: a running product; the floor at zero binds once a factor is 0 or less."""
    w = Window.partitionBy(by).orderBy("exit_date", "symbol", "horizon", "signal_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("status = 'closed'").withColumn("factor", 1 + fraction * (F.col("strategy_return") - cost_bps / 10_000))
    alive = F.min("factor").over(w) > 0
    grown = F.exp(F.sum(F.when(F.col("factor") > 0, F.log("factor")).otherwise(0.0)).over(w))
    rows = rows.withColumn("capital", F.when(alive, grown * capital).otherwise(0.0))
    before = F.coalesce(F.lag("capital").over(Window.partitionBy(by).orderBy("exit_date", "symbol", "horizon", "signal_id")), F.lit(capital))
    return rows.withColumns({"pnl": F.col("capital") - before, "drawdown": F.col("capital") / F.greatest(F.max("capital").over(w), F.lit(capital)) - 1})


def gate_portfolios(trades: DataFrame, slots: int = 5, most: int = 5) -> DataFrame:
    """The gate over each portfolio's signals in order of day, symbol and id: same-day re-entry, open symbol, free slot, cap, in this order.

    A position's exit frees its slot before the day's signals are looked at, but its symbol waits for the next day. The walk sees a few signals a day.
    """
    rows = trades.select("ledger_id", "signal_id", "symbol", "signal_date", "exit_date")
    signals, place = P.placed(rows, [F.col("symbol"), F.col("signal_id")], "signals")
    few = P.day_candidates(signals, ["ledger_id"], "signal_date", place, 3 * slots, F.col("exit_date") <= F.col("signal_date"))
    taken = stored(P.walked(few, ["ledger_id"], "signal_date", "exit_date", place, lambda pdf: P.gate_slots(pdf, slots, most, "signal_date", "exit_date")), "taken")
    full = "MAX_POSITIONS" if most and most < slots else "NO_FREE_SLOT"

    def said(slot: Column, until: Column) -> Column:
        return F.when(slot.isNotNull(), "ACCEPTED").when(until == F.col("signal_date"), "SAME_DAY_REENTRY").when(until.isNotNull(), "SYMBOL_OPEN").otherwise(full)

    out = P.explained(signals, taken, ["ledger_id"], "signal_date", "exit_date", place, said)
    return out.select("ledger_id", "signal_id", "symbol", "signal_date", "exit_date", F.col("said").alias("decision"), "slot")


def staleness(snapshots: DataFrame, now, hours: float, schema_version: int = 8, horizons: int = 3) -> DataFrame:
    """verdict of each snapshot: the first rule that it breaks, or FRESH; whatever isn't known counts against it."""
    rules = {
        "STATUS": F.col("status") == "complete",
        "SCHEMA": F.col("schema_version") >= schema_version,
        "COVERAGE": F.col("coverage") != "INVALID",
        "HORIZONS": F.col("n_horizons") >= horizons,
        "RECORDS": F.col("bad_records") == 0,
        "NO_TIME": F.col("updated_at").isNotNull(),
        "AGE": F.col("updated_at") >= now - F.make_dt_interval(hours=F.lit(int(hours))),
    }
    broken = [F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]
    return snapshots.withColumn("verdict", F.coalesce(*broken, F.lit("FRESH")))


#: What a feed's observation may say of itself.
FEED_TERMS = {"data_type": ("TRADE", "QUOTE", "BAR"), "basis": ("RAW", "ADJUSTED", "UNKNOWN"), "delivery": ("REALTIME", "DELAYED", "END_OF_DAY", "UNKNOWN"), "capable": ("YES", "NO", "UNKNOWN")}
BAR_STATES = ("CLOSED", "IN_PROGRESS", "UNKNOWN")


def feed_faults() -> Column:
    """Names, in order, of the rules that an observation of a feed breaks; what isn't known breaks a rule that asks for it."""
    text = lambda name: F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0
    bar, said = F.col("data_type") == "BAR", lambda c: F.coalesce(c, F.lit(False))
    bad = {
        "BAR_INTERVAL": bar & ~text("bar_interval"),
        "BAR_STATE": bar & ~said(F.col("bar_state").isin(*BAR_STATES)),
        "CAPABILITY": ~said(F.col("capable").isin(*FEED_TERMS["capable"])),
        "CURRENCY": ~text("currency"),
        "DATA_TYPE": ~said(F.col("data_type").isin(*FEED_TERMS["data_type"])),
        "DELAY": F.col("delay").isNotNull() & (F.isnan("delay") | (F.col("delay") < 0)),
        "DELIVERY": ~said(F.col("delivery").isin(*FEED_TERMS["delivery"])),
        "END_OF_DAY_BAR": (F.col("delivery") == "END_OF_DAY") & ~said(bar),
        "INSTRUMENT": ~text("instrument"),
        "ONLY_BAR": ~said(bar) & (F.col("bar_interval").isNotNull() | F.col("bar_state").isNotNull()),
        "PRICE_BASIS": ~said(F.col("basis").isin(*FEED_TERMS["basis"])),
        "REALTIME": (F.col("delivery") == "REALTIME") & (F.col("capable") == "NO"),
        "RETRIEVED": F.col("retrieved").isNull(),
        "RETRIEVED_AFTER_CHECK": F.col("retrieved") > F.col("checked"),
        "SOURCE": ~text("source_name"),
        "VENUE": F.col("venue").isNotNull() & ~text("venue"),
    }
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in sorted(bad.items())]))
