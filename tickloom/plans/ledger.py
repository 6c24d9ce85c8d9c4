"""Queries over signals, ledgers, journals, watchlists, evidence and feed checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.functions.columns import r6 as R
from tickloom.operators import ledger as X
from tickloom.plans.registry import query
from tickloom.plans.sqltext import W, cte, r6, sql
from tickloom.plans.validation import records, rounded
from tickloom.sources import bars as B
from tickloom.sources.storage import stored

CLASS = rules.CLASS[0]["asset_class"]
cte(
    "signals",
    f"""SELECT symbol, (dt + 2)::DATE AS signal_date, 5 AS horizon, CASE WHEN m > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, {CLASS} AS ledger_id, symbol || '|' || CAST((dt + 2)::DATE AS VARCHAR) AS signal_id, abs(m) > 0.15 AS accepted
    FROM (SELECT *, close / lag(close, 20) OVER {W} - 1 AS m FROM bars) WHERE abs(m) > 0.1""",
    "bars",
)


def signals(spark, sf):
    bars = B.brand_bars(spark, sf)
    m = F.col("close") / F.lag("close", 20).over(Window.partitionBy("symbol").orderBy("dt")) - 1
    rows = rules.apply(bars.withColumn("m", m).where(F.abs("m") > 0.1), rules.CLASS[:1]).withColumn("signal_date", F.date_add("dt", 2))
    return rows.select("symbol", "signal_date", F.lit(5).alias("horizon"), F.when(F.col("m") > 0, "LONG").otherwise("SHORT").alias("direction"), F.col("asset_class").alias("ledger_id"), F.concat_ws("|", "symbol", F.col("signal_date").cast("string")).alias("signal_id"), (F.abs("m") > 0.15).alias("accepted"))


cte("numbered", f"SELECT *, row_number() OVER {W} AS pos FROM bars", "bars")


def executed_sql(journal):
    op, add, cost = (">=", 1, "0.0") if journal else (">", 0, "0.0015")
    return f"""SELECT *, CASE WHEN exit_price IS NOT NULL THEN 'closed' ELSE 'open' END AS status, g AS gross_return, g - {cost} AS strategy_return, (g - {cost}) > 0 AS hit,
    CASE WHEN entry_price IS NULL THEN 0 ELSE least(horizon, greatest(0, last_pos - entry_pos)) END AS bars_elapsed, horizon - CASE WHEN entry_price IS NULL THEN 0 ELSE least(horizon, greatest(0, last_pos - entry_pos)) END AS bars_remaining
    FROM (SELECT s.*, e.pos AS ep, e.dt AS entry_date, e.open AS entry_price, x.dt AS exit_date, x.open AS exit_price, CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * (x.open / e.open - 1) AS g
    FROM (SELECT s.*, (SELECT min(pos) FROM numbered n WHERE n.symbol = s.symbol AND n.dt {op} s.signal_date) + {add} AS entry_pos, (SELECT max(pos) FROM numbered n WHERE n.symbol = s.symbol) AS last_pos FROM signals s) s
    LEFT JOIN numbered e ON e.symbol = s.symbol AND e.pos = entry_pos LEFT JOIN numbered x ON x.symbol = s.symbol AND x.pos = entry_pos + horizon)"""


cte("done", executed_sql(False), "signals", "numbered")
cte("jdone", executed_sql(True), "signals", "numbered")


def done(spark, sf, journal=False):
    return X.executed(signals(spark, sf), B.brand_bars(spark, sf), journal)


SHOWN = "signal_id, status, entry_date, entry_price, exit_date, exit_price, hit, bars_elapsed, bars_remaining"


@query(sql(f"SELECT {SHOWN}, {r6('strategy_return', 'strategy_return')} FROM done", "done"))
def j03_l05_executions(spark, sf):
    return done(spark, sf).select(*SHOWN.split(", "), R("strategy_return").alias("strategy_return"))


@query(sql(f"SELECT {SHOWN}, {r6('strategy_return', 'strategy_return')} FROM jdone", "jdone"))
def j04_l02_journal_entries(spark, sf):
    return done(spark, sf, True).select(*SHOWN.split(", "), R("strategy_return").alias("strategy_return"))


@query(sql("SELECT symbol, dt, pos FROM numbered", "numbered"))
def w13_session_numbers(spark, sf):
    return X.sessions(B.brand_bars(spark, sf)).select("symbol", "dt", "pos")


@query(sql("SELECT DISTINCT signal_id FROM signals WHERE direction = 'SHORT' OR NOT accepted", "signals"))
def j11_l01_new_signals(spark, sf):
    s = signals(spark, sf)
    return X.new_signals(s.unionByName(s), s.where("direction = 'LONG' AND accepted")).select("signal_id")


MERGE_T = "CASE WHEN symbol LIKE '^%' THEN 'b' ELSE 'a' END"


@query(sql(f"SELECT signal_id, CASE WHEN symbol LIKE '^%' THEN 'open' ELSE status END AS status, CASE WHEN NOT symbol LIKE '^%' THEN {r6('strategy_return')} END AS strategy_return FROM jdone", "jdone"))
def j12_l03_refresh_merge(spark, sf):
    fresh = done(spark, sf, True)
    known = fresh.select("signal_id", F.lit("open").alias("status"), F.lit(None).cast("double").alias("strategy_return"), F.expr(MERGE_T).alias("token"))
    return rounded(X.refresh_merge(known, fresh.withColumn("token", F.lit("a"))), ["signal_id", "status"])


cte(
    "events_l",
    """SELECT ledger_id, event_type, event_date, signal_id, symbol, entry_date, entry_price, exit_date, exit_price, strategy_return, CAST(row_number() OVER (PARTITION BY ledger_id ORDER BY event_date, o, signal_id) AS INTEGER) AS seq FROM (
    SELECT ledger_id, 'SIGNAL_OBSERVED' AS event_type, 2 AS o, signal_date AS event_date, signal_id, symbol, NULL::DATE AS entry_date, NULL::DOUBLE AS entry_price, NULL::DATE AS exit_date, NULL::DOUBLE AS exit_price, NULL::DOUBLE AS strategy_return FROM done
    UNION ALL SELECT ledger_id, CASE WHEN accepted THEN 'POSITION_ACCEPTED' ELSE 'POSITION_SKIPPED' END, 3, signal_date, signal_id, symbol, NULL, NULL, NULL, NULL, NULL FROM done
    UNION ALL SELECT ledger_id, 'ENTRY_FILLED', 0, entry_date, signal_id, symbol, entry_date, entry_price, NULL, NULL, NULL FROM done WHERE accepted AND entry_date IS NOT NULL
    UNION ALL SELECT ledger_id, 'POSITION_CLOSED', 1, exit_date, signal_id, symbol, NULL, NULL, exit_date, exit_price, strategy_return FROM done WHERE accepted AND exit_date IS NOT NULL)""",
    "done",
)


def events(spark, sf):
    return X.events(done(spark, sf))


@query(sql("SELECT ledger_id, seq, event_type, event_date, signal_id FROM events_l", "events_l"))
def l04_ledger_events(spark, sf):
    return events(spark, sf).select("ledger_id", "seq", "event_type", "event_date", "signal_id")


cte(
    "state_l",
    """SELECT ledger_id, signal_id, CASE arg_max(CASE event_type WHEN 'POSITION_CLOSED' THEN 4 WHEN 'ENTRY_FILLED' THEN 3 WHEN 'POSITION_SKIPPED' THEN 2 WHEN 'POSITION_ACCEPTED' THEN 1 END, seq) FILTER (event_type <> 'SIGNAL_OBSERVED')
    WHEN 4 THEN 'CLOSED' WHEN 3 THEN 'OPEN' WHEN 2 THEN 'SKIPPED' WHEN 1 THEN 'ACCEPTED' ELSE 'PENDING' END AS status, max(seq) AS last_seq, max(entry_date) AS entry_date, max(exit_price) AS exit_price, max(strategy_return) AS strategy_return FROM events_l GROUP BY ledger_id, signal_id""",
    "events_l",
)


@query(sql(f"SELECT ledger_id, signal_id, status, last_seq, entry_date, exit_price, {r6('strategy_return', 'strategy_return')} FROM state_l", "state_l"))
def l06_state(spark, sf):
    return X.state(events(spark, sf)).select("ledger_id", "signal_id", "status", "last_seq", "entry_date", "exit_price", R("strategy_return").alias("strategy_return"))


@query(
    sql(
        f"""SELECT ledger_id, n_pending, n_accepted, n_open, n_closed, n_skipped, signals, events, mean_return, median_return, hit_rate, signal_days, 5 - n_open - n_accepted AS free_slots FROM (SELECT ledger_id, {', '.join(f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in ('PENDING', 'ACCEPTED', 'OPEN', 'CLOSED', 'SKIPPED'))}, count(*) AS signals, {r6('avg(strategy_return)', 'mean_return')}, {r6("quantile_cont(strategy_return, 0.5) FILTER (status = 'CLOSED')", 'median_return')}, {r6('avg(CASE WHEN strategy_return > 0 THEN 1.0::DOUBLE WHEN strategy_return IS NOT NULL THEN 0.0::DOUBLE END)', 'hit_rate')} FROM state_l GROUP BY ledger_id)
    JOIN (SELECT ledger_id, count(*) AS events, count(DISTINCT event_date) FILTER (event_type = 'SIGNAL_OBSERVED') AS signal_days FROM events_l GROUP BY ledger_id) USING (ledger_id)""",
        "state_l",
        "events_l",
    )
)
def l09_a16_ledger_health(spark, sf):
    out = X.health(events(spark, sf), 5)
    return rounded(out, ["ledger_id", "n_pending", "n_accepted", "n_open", "n_closed", "n_skipped", "signals", "events", "signal_days", "free_slots"])


@query(sql("SELECT ledger_id, event_type, count(*) AS n, count(DISTINCT signal_id) AS n_signals FROM events_l GROUP BY ALL", "events_l"))
def a17_event_counts(spark, sf):
    return events(spark, sf).groupBy("ledger_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct("signal_id").alias("n_signals"))


@query(sql("SELECT ledger_id, seq, event_type, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY seq DESC) AS r FROM events_l) WHERE r <= 30", "events_l"))
def w16_last_events(spark, sf):
    rows = events(spark, sf)
    last = rows.groupBy(F.col("ledger_id").alias("of")).agg(F.max("seq").alias("last"))  # numbers have no gaps
    return rows.join(last, F.col("ledger_id") == F.col("of")).where("seq > last - 30").select("ledger_id", "seq", "event_type", "signal_id")


def json_sql(previous: str) -> str:
    """An event as one JSON object with its keys in order, put together by hand."""
    parts = []
    for name in sorted([*X.EVENT_FIELDS, "previous_hash"]):
        kind = X.EVENT_FIELDS.get(name, "hash")
        value = {"number": f"printf('%.12f', {name})", "whole": f"CAST({name} AS VARCHAR)", "hash": previous}.get(kind, f"'\"' || CAST({name} AS VARCHAR) || '\"'")
        parts.append(f"'\"{name}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


@query()
def l08_hash_chain(spark, sf):
    return X.chain_append(X.payloads(events(spark, sf)))


BEFORE, AFTER = (part for part in json_sql("MARK").split("coalesce(MARK, 'null')"))
cte(
    "chain_heads",
    f"""SELECT ledger_id, CAST(len(todo) AS INTEGER) AS seq, (list_reduce(todo, lambda h, x: {{'p': x.p, 's': x.s, 'h': sha256(x.p || '"' || h.h || '"' || x.s)}}, {{'p': '', 's': '', 'h': 'GENESIS'}})).h AS event_hash
    FROM (SELECT ledger_id, list({{'p': {BEFORE} '', 's': '' {AFTER}, 'h': ''}} ORDER BY seq) AS todo FROM events_l GROUP BY ledger_id)""",
    "events_l",
)


@query(sql("SELECT * FROM chain_heads", "chain_heads"))
def l08_chain_heads(spark, sf):
    """The head of each ledger's chain after its events were appended in two runs, the second from the heads of the first."""
    parts = X.payloads(stored(events(spark, sf), "events"))
    first = stored(X.chain_append(parts.where("seq <= 200")), "chain")
    second = X.chain_append(parts.where("seq > 200"), X.chain_heads(first))
    return X.chain_heads(first.unionByName(second))


PREV = "CASE WHEN seq = 1 THEN 'GENESIS' WHEN seq >= 40 AND ledger_id = 'US' THEN 'tampered' ELSE 'x' END"
QUOTED = "'\"' || prev || '\"'"


@query(
    sql(
        f"""SELECT ledger_id, count(*) AS n_events, CAST(min(seq) FILTER (issue IS NOT NULL) AS INTEGER) AS seq, arg_min(issue, seq) FILTER (issue IS NOT NULL) AS issue FROM (SELECT *, CASE WHEN prev <> coalesce(lag(h) OVER (PARTITION BY ledger_id ORDER BY seq), 'GENESIS') THEN 'BROKEN_LINK' WHEN h <> sha256({json_sql(QUOTED)}) THEN 'HASH_MISMATCH' END AS issue
    FROM (SELECT *, sha256({json_sql(QUOTED)}) AS h FROM (SELECT *, {PREV} AS prev FROM events_l))) GROUP BY ledger_id""",
        "events_l",
    )
)
def l07_chain_audit(spark, sf):
    """A chain whose links were all rewritten: the audit names the first event that doesn't hold."""
    e = X.payloads(events(spark, sf))
    prev = F.when(F.col("seq") == 1, "GENESIS").when((F.col("seq") >= 40) & (F.col("ledger_id") == "US"), "tampered").otherwise("x")
    e = e.withColumn("previous_hash", prev).withColumn("event_hash", F.sha2(F.replace(F.col("payload"), F.lit("\u0000"), F.col("previous_hash")), 256))
    return X.chain_audit(e)


# intake by batches, a month of a ledger each

CHECKS_SQL = {
    "DIRECTION": "direction IN ('LONG', 'SHORT')",
    "HORIZON": "horizon IN (1, 5, 20)",
    "INDEX_SHORT_ON_13TH": "NOT (symbol LIKE '^%' AND direction = 'SHORT' AND day(signal_date) = 13)",
    "SYMBOL": "symbol IS NOT NULL AND symbol <> ''",
}
BATCH = "ledger_id || '_' || strftime(signal_date, '%Y%m')"
cte("batches", f"SELECT *, {BATCH} AS batch_id FROM done", "done")
cte("verdicts", f"SELECT batch_id, count(*) AS rows, concat_ws(',', {', '.join(f"CASE WHEN NOT bool_and({c}) THEN '{n}' END" for n, c in sorted(CHECKS_SQL.items()))}) AS failed FROM batches GROUP BY batch_id", "batches")
cte("taken_in", "SELECT b.* FROM batches b JOIN verdicts USING (batch_id) WHERE failed = ''", "batches", "verdicts")


def intake(spark, sf):
    """The intake after all batches came, and every third of them once more."""
    batches = stored(done(spark, sf).withColumn("batch_id", F.concat_ws("_", "ledger_id", F.date_format("signal_date", "yyyyMM"))), "batches")
    box = X.Intake(spark, "intake", {n: F.expr(c) for n, c in CHECKS_SQL.items()})
    verdicts = box.submit(batches)
    box.submit(batches.where("month(signal_date) IN (3, 6, 9, 12)"))
    return box, verdicts


@query(sql("SELECT * FROM verdicts", "verdicts"))
def l01_intake_verdicts(spark, sf):
    return intake(spark, sf)[1]


# the gate as a fold over a ledger's signals in order: who holds which slot until when, what ended lately, and what was taken
GATE_HELD, GATE_TAKEN = "STRUCT(symbol VARCHAR, until DATE)[]", "STRUCT(signal_id VARCHAR, slot INTEGER)[]"


def gate_sql(slots, source="done"):
    none = f"'held': CAST(NULL AS {GATE_HELD}), 'gone': CAST(NULL AS {GATE_HELD}), 'taken': CAST(NULL AS {GATE_TAKEN})"
    signal = f"{{'signal_id': signal_id, 'symbol': symbol, 'dt': CAST(signal_date AS DATE), 'until': CAST(coalesce(exit_date, DATE '9999-12-31') AS DATE), {none}}}"
    empty = ", ".join(["{'symbol': '', 'until': DATE '1900-01-01'}"] * slots)
    first = f"{{'signal_id': '', 'symbol': '', 'dt': CAST(NULL AS DATE), 'until': CAST(NULL AS DATE), 'held': CAST([{empty}] AS {GATE_HELD}), 'gone': CAST([] AS {GATE_HELD}), 'taken': CAST([] AS {GATE_TAKEN})}}"
    free = "list_position(list_transform(s.held, lambda h: h.until <= t.dt), true)"
    take = f"{free} IS NOT NULL AND len(list_filter(list_concat(s.held, s.gone), lambda h: h.symbol = t.symbol AND h.until >= t.dt)) = 0"
    held = f"list_transform(s.held, lambda h, i: CASE WHEN {take} AND i = {free} THEN {{'symbol': t.symbol, 'until': t.until}} ELSE h END)"
    gone = f"CASE WHEN {take} THEN list_append(list_filter(s.gone, lambda g: g.until >= t.dt), s.held[{free}]) ELSE s.gone END"
    taken = f"CASE WHEN {take} THEN list_append(s.taken, {{'signal_id': t.signal_id, 'slot': CAST({free} AS INTEGER)}}) ELSE s.taken END"
    step = f"{{'signal_id': t.signal_id, 'symbol': t.symbol, 'dt': t.dt, 'until': t.until, 'held': {held}, 'gone': {gone}, 'taken': {taken}}}"
    return f"""SELECT ledger_id, p.signal_id, p.slot FROM (SELECT ledger_id, unnest((list_reduce(todo, lambda s, t: {step}, {first})).taken) AS p FROM
    (SELECT ledger_id, list({signal} ORDER BY signal_date, symbol, signal_id) AS todo FROM {source} GROUP BY ledger_id))"""


cte("gate_taken", gate_sql(5), "done")
cte("gate_held", "SELECT d.ledger_id, d.symbol, d.signal_date, d.exit_date FROM done d JOIN gate_taken USING (ledger_id, signal_id)", "done", "gate_taken")
EARLIER = "h.ledger_id = d.ledger_id AND h.symbol = d.symbol AND h.signal_date < d.signal_date"


@query(
    sql(
        f"""SELECT d.ledger_id, d.signal_id, d.symbol, d.signal_date, d.exit_date, CASE WHEN g.slot IS NOT NULL THEN 'ACCEPTED' WHEN EXISTS (SELECT 1 FROM gate_held h WHERE {EARLIER} AND h.exit_date = d.signal_date) THEN 'SAME_DAY_REENTRY'
    WHEN EXISTS (SELECT 1 FROM gate_held h WHERE {EARLIER} AND (h.exit_date IS NULL OR h.exit_date > d.signal_date)) THEN 'SYMBOL_OPEN' ELSE 'NO_FREE_SLOT' END AS decision, g.slot FROM done d LEFT JOIN gate_taken g USING (ledger_id, signal_id)""",
        "done",
        "gate_taken",
        "gate_held",
    )
)
def f06_portfolio_gate(spark, sf):
    return X.gate_portfolios(done(spark, sf))


cte("gate_in", gate_sql(5, "taken_in"), "taken_in")


@query(
    sql(
        """SELECT ledger_id, 'SNAPSHOT_AUDIT' AS event_type, signal_date AS event_date, NULL::VARCHAR AS signal_id FROM (SELECT DISTINCT ledger_id, signal_date FROM taken_in)
    UNION ALL SELECT ledger_id, 'SIGNAL_OBSERVED', signal_date, signal_id FROM taken_in
    UNION ALL SELECT t.ledger_id, CASE WHEN g.slot IS NULL THEN 'POSITION_SKIPPED' ELSE 'POSITION_ACCEPTED' END, signal_date, t.signal_id FROM taken_in t LEFT JOIN gate_in g ON g.ledger_id = t.ledger_id AND g.signal_id = t.signal_id""",
        "taken_in",
        "gate_in",
    )
)
def l04_intake_events(spark, sf):
    """Events of what was taken in: an audit for each snapshot, every signal, and the gate's decision on it."""
    box, _ = intake(spark, sf)
    taken = stored(box.signals(), "taken")
    audits = box.audits().select("ledger_id", F.lit("SNAPSHOT_AUDIT").alias("event_type"), F.col("snapshot").alias("event_date"), F.lit(None).cast("string").alias("signal_id"))
    seen = taken.select("ledger_id", F.lit("SIGNAL_OBSERVED").alias("event_type"), F.col("signal_date").alias("event_date"), "signal_id")
    gated = X.gate_portfolios(taken).select("ledger_id", F.when(F.col("decision") == "ACCEPTED", "POSITION_ACCEPTED").otherwise("POSITION_SKIPPED").alias("event_type"), F.col("signal_date").alias("event_date"), "signal_id")
    return audits.unionByName(seen).unionByName(gated)


@query(sql("SELECT a.signal_id FROM signals a WHERE EXISTS (SELECT 1 FROM done d WHERE d.symbol = a.symbol AND d.accepted AND d.exit_date = a.signal_date)", "signals", "done"))
def j15_same_day_reentry(spark, sf):
    closed = done(spark, sf).where("accepted AND exit_date IS NOT NULL").select("symbol", F.col("exit_date").alias("signal_date"))
    return signals(spark, sf).join(closed, ["symbol", "signal_date"], "left_semi").select("signal_id")


JOURNAL = {
    "hit_rate": "avg(CASE WHEN strategy_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (status = 'closed')",
    "average_return": "avg(strategy_return) FILTER (status = 'closed')",
    "median_return": "quantile_cont(strategy_return, 0.5) FILTER (status = 'closed')",
    "expectancy": "avg(strategy_return) FILTER (status = 'closed')",
    "best_return": "max(strategy_return) FILTER (status = 'closed')",
    "worst_return": "min(strategy_return) FILTER (status = 'closed')",
    "profit_factor": "coalesce(sum(strategy_return) FILTER (strategy_return > 0), 0) / nullif(-sum(strategy_return) FILTER (strategy_return < 0), 0)",
    "payoff_ratio": "avg(strategy_return) FILTER (strategy_return > 0) / nullif(-avg(strategy_return) FILTER (strategy_return < 0), 0)",
}


def journal_query(name, by):
    def run(spark, sf):
        return rounded(X.journal_summary(done(spark, sf, True), by), [*by, "total", "closed", "open"])

    run.__name__ = name
    keys = ", ".join(by)
    order = f"(PARTITION BY {keys} ORDER BY signal_date, signal_id ROWS UNBOUNDED PRECEDING)"
    falls = f"SELECT {keys}, min(wealth / top - 1) AS fall FROM (SELECT *, max(wealth) OVER {order} AS top FROM (SELECT *, exp(sum(ln(1 + strategy_return)) OVER {order}) AS wealth FROM jdone WHERE status = 'closed')) GROUP BY {keys}"
    query(sql(f"SELECT {keys}, total, closed, open, {', '.join(JOURNAL)}, {r6('fall', 'max_drawdown')} FROM (SELECT {keys}, count(*) AS total, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status <> 'closed') AS open, {', '.join(r6(e, n) for n, e in JOURNAL.items())} FROM jdone GROUP BY {keys}) LEFT JOIN ({falls}) USING ({keys})", "jdone"))(run)


journal_query("a14_journal_summary", ["ledger_id"])
journal_query("a15_journal_breakdown", ["direction", "symbol"])

PW = "(PARTITION BY ledger_id ORDER BY exit_date, symbol, horizon, signal_id ROWS UNBOUNDED PRECEDING)"
cte("paper", f"SELECT *, exp(sum(ln(1 + 0.1 * (strategy_return - 0.002))) OVER {PW}) * 10000 AS capital FROM jdone WHERE status = 'closed'", "jdone")


@query(sql(f"SELECT signal_id, {r6('capital / 10000', 'growth')}, {r6('capital / greatest(max(capital) OVER ' + PW + ', 10000) - 1', 'drawdown')} FROM paper", "paper"))
def w06_paper_portfolio(spark, sf):
    rows = X.paper_portfolio(done(spark, sf, True), "ledger_id")
    return rows.select("signal_id", R(F.col("capital") / 10000).alias("growth"), R("drawdown").alias("drawdown"))


JW = "(PARTITION BY symbol ORDER BY signal_date, signal_id ROWS UNBOUNDED PRECEDING)"


@query(sql(f"SELECT signal_id, {r6(f'sum(ln(1 + strategy_return)) OVER {JW}', 'log_equity')} FROM jdone WHERE status = 'closed'", "jdone"))
def w05_journal_equity(spark, sf):
    w = Window.partitionBy("symbol").orderBy("signal_date", "signal_id").rowsBetween(Window.unboundedPreceding, 0)
    return done(spark, sf, True).where("status = 'closed'").select("signal_id", R(F.sum(F.log1p("strategy_return")).over(w)).alias("log_equity"))


CLAIMS = "(SELECT symbol, unnest([5, 20]) AS horizon, CASE WHEN symbol LIKE '%-USD' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'RESEARCH_CANDIDATE' END AS status FROM (SELECT DISTINCT symbol FROM bars) WHERE NOT symbol LIKE '^%')"


def claims(spark, sf):
    """Claims with their symbols as arrays, as a registry holds them."""
    symbols = B.brand_bars(spark, sf).select("symbol").distinct().where("symbol NOT LIKE '^%'")
    kind = F.when(F.col("symbol").endswith("-USD"), "INSUFFICIENT_EVIDENCE").otherwise("RESEARCH_CANDIDATE")
    lists = symbols.groupBy(kind.alias("status")).agg(F.collect_list("symbol").alias("exact_symbols"))
    return lists.withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(20)))).withColumn("claim_id", F.concat_ws("_", "status", F.col("horizon").cast("string")))


@query(sql(f"SELECT s.signal_id, coalesce(c.status, 'UNTESTED') AS status FROM signals s LEFT JOIN {CLAIMS} c USING (symbol, horizon)", "signals", "bars"))
def j09_evidence(spark, sf):
    flat = claims(spark, sf).select("horizon", "status", F.explode("exact_symbols").alias("symbol"))
    return signals(spark, sf).join(flat, ["symbol", "horizon"], "left").select("signal_id", F.coalesce("status", F.lit("UNTESTED")).alias("status"))


@query(sql("SELECT symbol, 20 AS horizon, 2 AS n_claims FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol LIKE '%.WA'", "bars"))
def o08_overlapping_claims(spark, sf):
    c = claims(spark, sf)
    more = c.where("horizon = 20").withColumns({"exact_symbols": F.filter("exact_symbols", lambda s: s.endswith(".WA")), "claim_id": F.lit("extra")})
    flat = c.unionByName(more).select("claim_id", "horizon", F.explode("exact_symbols").alias("symbol"))
    return flat.groupBy("symbol", "horizon").agg(F.count_distinct("claim_id").cast("int").alias("n_claims")).where("n_claims > 1")


@query(sql(f"SELECT count(*) AS total, count(*) FILTER (direction = 'LONG') AS active, count(*) FILTER (direction <> 'LONG') AS archived, count(DISTINCT symbol) AS symbols FROM signals", "signals"))
def a20_watchlist_summary(spark, sf):
    s = signals(spark, sf)
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("direction") == "LONG").alias("active"), F.count_if(F.col("direction") != "LONG").alias("archived"), F.count_distinct("symbol").alias("symbols"))


@query(sql("SELECT signal_id, count(*) OVER (PARTITION BY symbol, direction) > 1 AS duplicate FROM signals", "signals"))
def o09_watchlist_duplicates(spark, sf):
    return signals(spark, sf).select("signal_id", (F.count("*").over(Window.partitionBy("symbol", "direction")) > 1).alias("duplicate"))


@query(sql("SELECT signal_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY signal_date DESC, signal_id DESC) AS r FROM signals) WHERE r = 1", "signals"))
def l10_watchlist_active(spark, sf):
    """The item that is active for each symbol and horizon: the latest upsert."""
    return signals(spark, sf).groupBy("symbol", "horizon").agg(F.max_by("signal_id", F.struct("signal_date", "signal_id")).alias("signal_id")).select("signal_id")


@query(
    sql(
        """SELECT symbol, horizon, state, valid_from, valid_to FROM (SELECT *, lead(valid_from) OVER (PARTITION BY symbol, horizon ORDER BY valid_from) AS valid_to FROM
    (SELECT symbol, horizon, signal_date AS valid_from, state, lag(state) OVER w AS was, row_number() OVER w AS i FROM (SELECT *, CASE WHEN accepted THEN direction END AS state FROM signals) WINDOW w AS (PARTITION BY symbol, horizon ORDER BY signal_date))
    WHERE i = 1 OR state IS DISTINCT FROM was) WHERE state IS NOT NULL""",
        "signals",
    )
)
def l10_watch_versions(spark, sf):
    """The watchlist's history, kept by three batches of upserts and archivings, the second of which comes twice."""
    items = stored(signals(spark, sf).select("symbol", "horizon", F.col("signal_date").alias("at"), F.when(F.col("accepted"), F.col("direction")).alias("state")), "items")
    cuts, history = ("1994-06-01", "1997-01-01", "9999-12-31"), None
    for low, high in zip(("0001-01-01", *cuts[:2]), cuts, strict=True):
        part = items.where((F.col("at") >= low) & (F.col("at") < high))
        history = stored(X.watch_versions(history, part, ["symbol", "horizon"]), "watchlist")
        if high == cuts[1]:
            history = stored(X.watch_versions(history, part, ["symbol", "horizon"]), "watchlist")
    return history.select("symbol", "horizon", "state", "valid_from", "valid_to")


THEN_NOW = """CASE WHEN n.symbol IS NULL THEN 'NO_CURRENT_ANALYSIS' WHEN t.direction = n.direction THEN 'STILL_CONFIRMED' ELSE 'REVERSED' END"""
LATEST = "(SELECT symbol, arg_max(direction, signal_date) AS direction FROM signals WHERE signal_date >= (SELECT max(signal_date) - 45 FROM signals) GROUP BY symbol)"


@query(sql(f"SELECT t.signal_id, {THEN_NOW} AS comparison FROM signals t LEFT JOIN {LATEST} n USING (symbol)", "signals"))
def j10_k06_watch_comparison(spark, sf):
    s = signals(spark, sf)
    last = s.agg(F.date_sub(F.max("signal_date"), 45).alias("since"))  # one row: an analysis of the last weeks is a current one
    recent = s.crossJoin(F.broadcast(last)).where("signal_date >= since")
    now = recent.groupBy("symbol").agg(F.max_by("direction", "signal_date").alias("now"))
    said = F.when(F.col("now").isNull(), "NO_CURRENT_ANALYSIS").when(F.col("direction") == F.col("now"), "STILL_CONFIRMED").otherwise("REVERSED")
    return s.join(now, "symbol", "left").select("signal_id", said.alias("comparison"))


# every record against the latest analysis of its symbol and horizon; some have none, one of another horizon, or an invalid decision
cte(
    "watched",
    """SELECT symbol || '|' || horizon || '|' || CAST(dt AS VARCHAR) AS item_id, symbol || '|' || CASE WHEN symbol LIKE '%.DE' THEN 20 ELSE horizon END AS key, symbol, horizon, dt, CASE WHEN NOT (symbol LIKE '^%' AND horizon = 1) THEN position END AS decision,
    probability_up, expected_return, CASE WHEN abs(expected_return) > 0.01 THEN 'HIGH' ELSE 'LOW' END AS quality FROM records""",
    "records",
)
cte("analysed", "SELECT * EXCLUDE (key), symbol || '|' || horizon AS key FROM watched WHERE symbol NOT LIKE '%-USD' QUALIFY row_number() OVER (PARTITION BY symbol, horizon ORDER BY dt DESC) = 1", "watched")


@query(
    sql(
        f"""SELECT w.item_id, CASE WHEN a.key IS NULL THEN 'NO_CURRENT_ANALYSIS' WHEN a.horizon <> w.horizon THEN 'MISMATCH' ELSE CASE WHEN coalesce(w.decision * a.decision, 9) = 9 THEN 'DECISION_UNAVAILABLE' WHEN w.decision = a.decision THEN CASE w.decision WHEN 0 THEN 'UNCHANGED' ELSE 'STILL_CONFIRMED' END
    WHEN w.decision = 0 THEN 'GAINED_CONFIRMATION' WHEN a.decision = 0 THEN 'WEAKENED' ELSE 'REVERSED' END END AS comparison, {r6('CASE WHEN a.horizon = w.horizon THEN a.probability_up - w.probability_up END', 'delta_probability_up')},
    {r6('CASE WHEN a.horizon = w.horizon THEN a.expected_return - w.expected_return END', 'delta_expected_return')}, CASE WHEN a.horizon = w.horizon THEN CASE WHEN a.quality = w.quality THEN 'SAME' ELSE w.quality || '>' || a.quality END END AS quality_change
    FROM watched w LEFT JOIN analysed a USING (key)""",
        "watched",
        "analysed",
    )
)
def k06_watch_states(spark, sf):
    key = lambda h: F.concat_ws("|", "symbol", h.cast("string"))
    rows = records(spark, sf).select(
        F.concat_ws("|", "symbol", F.col("horizon").cast("string"), F.col("dt").cast("string")).alias("item_id"), key(F.when(F.col("symbol").endswith(".DE"), 20).otherwise(F.col("horizon"))).alias("key"), "symbol", "horizon", "dt",
        F.when(~(F.col("symbol").startswith("^") & (F.col("horizon") == 1)), F.col("position")).alias("decision"), "probability_up", "expected_return", F.when(F.abs("expected_return") > 0.01, "HIGH").otherwise("LOW").alias("quality"),
    )
    rows = stored(rows, "watched")
    latest = rows.where("symbol NOT LIKE '%-USD'").groupBy("symbol", "horizon").agg(F.max_by(F.struct("decision", "probability_up", "expected_return", "quality"), "dt").alias("x")).select("symbol", "horizon", "x.*")
    return rounded(X.compared(rows, latest.withColumn("key", key(F.col("horizon")))), ["item_id", "comparison", "quality_change"])


# feed observations, made of the event stream

FEED = """CASE event_type WHEN 'click' THEN 'QUOTE' WHEN 'view' THEN 'BAR' WHEN 'purchase' THEN 'TRADE' ELSE 'OTHER' END AS data_type, CASE WHEN event_id % 3 = 0 THEN '1d' WHEN event_id % 3 = 1 THEN ' ' END AS bar_interval,
CASE WHEN event_id % 4 = 0 THEN 'END_OF_DAY' WHEN event_id % 4 = 1 THEN 'REALTIME' WHEN event_id % 4 = 2 THEN 'DELAYED' ELSE 'SOON' END AS delivery, CASE WHEN user_id % 3 = 0 THEN 'YES' WHEN user_id % 3 = 1 THEN 'NO' ELSE 'MAYBE' END AS capable,
CASE WHEN event_id % 11 = 0 THEN cast('NaN' AS double) WHEN event_id % 13 <> 0 THEN value - 5 END AS delay, CASE WHEN event_id % 5 = 0 THEN 'CLOSED' WHEN event_id % 5 = 1 THEN 'HALF' END AS bar_state,
CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END AS instrument, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'feed' END AS source_name, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'USD' END AS currency, CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1 THEN 'X' END AS venue,
CASE WHEN event_id % 6 = 0 THEN 'RAW' WHEN event_id % 6 = 1 THEN 'NET' ELSE 'ADJUSTED' END AS basis, CASE WHEN event_id % 23 = 0 THEN NULL ELSE ts END AS retrieved, CASE WHEN event_id % 29 = 0 THEN ts - INTERVAL '1' DAY ELSE ts END AS checked"""
#: The same rules said the other way round, what must hold.
HOLDS = {
    "BAR_INTERVAL": "data_type <> 'BAR' OR length(trim(coalesce(bar_interval, ''))) > 0",
    "BAR_STATE": "data_type <> 'BAR' OR coalesce(bar_state IN ('CLOSED', 'IN_PROGRESS', 'UNKNOWN'), false)",
    "CAPABILITY": "capable IN ('YES', 'NO', 'UNKNOWN')",
    "CURRENCY": "length(trim(coalesce(currency, ''))) > 0",
    "DATA_TYPE": "data_type IN ('TRADE', 'QUOTE', 'BAR')",
    "DELAY": "delay IS NULL OR (NOT isnan(delay) AND delay >= 0)",
    "DELIVERY": "delivery IN ('REALTIME', 'DELAYED', 'END_OF_DAY', 'UNKNOWN')",
    "END_OF_DAY_BAR": "delivery <> 'END_OF_DAY' OR data_type = 'BAR'",
    "INSTRUMENT": "length(trim(coalesce(instrument, ''))) > 0",
    "ONLY_BAR": "data_type = 'BAR' OR (bar_interval IS NULL AND bar_state IS NULL)",
    "PRICE_BASIS": "basis IN ('RAW', 'ADJUSTED', 'UNKNOWN')",
    "REALTIME": "delivery <> 'REALTIME' OR capable <> 'NO'",
    "RETRIEVED": "retrieved IS NOT NULL",
    "RETRIEVED_AFTER_CHECK": "retrieved IS NULL OR retrieved <= checked",
    "SOURCE": "length(trim(coalesce(source_name, ''))) > 0",
    "VENUE": "venue IS NULL OR length(trim(venue)) > 0",
}
CHECKS = ", ".join(f"CASE WHEN NOT ({rule}) THEN '{name}' END" for name, rule in HOLDS.items())


@query(f"SELECT event_id, concat_ws(',', {CHECKS}) AS failed FROM (SELECT event_id, {FEED} FROM events)")
def p21_feed_constraints(spark, sf):
    e = B.table(spark, sf, "events").selectExpr("event_id", *_split(FEED))
    return e.select("event_id", F.array_join(X.feed_faults(), ",").alias("failed"))


def _split(text):
    import re

    return [x.strip() for x in re.split(r",\s(?=CASE)", text.replace("\n", " "))]


@query("SELECT event_id, CASE WHEN epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts) >= 0 THEN CAST(floor(epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts)) AS BIGINT) END AS age_s FROM events")
def p22_observed_age(spark, sf):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    age = F.unix_seconds(now) - F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return B.table(spark, sf, "events").select("event_id", F.when(F.col("ts").cast("timestamp") <= now, age).cast("long").alias("age_s"))


@query("SELECT min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, count(DISTINCT CAST(ts AS DATE)) AS n_dates, count(*) FILTER (value < 1) AS n_low FROM events")
def a19_provenance(spark, sf):
    d = F.to_date("ts")
    return B.table(spark, sf, "events").agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.count_distinct(d).alias("n_dates"), F.count_if(F.col("value") < 1).alias("n_low"))


UNIVERSE = "SELECT DISTINCT symbol FROM bars"


@query(sql(f"SELECT symbol, 'UNEXPECTED' AS problem FROM ({UNIVERSE}) WHERE symbol LIKE '^%' UNION ALL SELECT symbol, 'STALE' FROM bars GROUP BY symbol HAVING max(dt) < (SELECT max(dt) FROM bars)", "bars"))
def o03_o04_universe_integrity(spark, sf):
    """Symbols outside the frozen universe, and those whose last bar isn't of the target session."""
    bars = B.brand_bars(spark, sf)
    last = bars.groupBy("symbol").agg(F.max("dt").alias("last"))
    frozen = last.where("symbol NOT LIKE '^%'").select("symbol")
    target = last.agg(F.max("last").alias("target"))  # one row
    odd = last.select("symbol").exceptAll(frozen).select("symbol", F.lit("UNEXPECTED").alias("problem"))
    stale = last.crossJoin(F.broadcast(target)).where(F.col("last") < F.col("target")).select("symbol", F.lit("STALE").alias("problem"))
    return odd.unionByName(stale)


@query(sql("SELECT symbol, min(dt) AS first_dt FROM bars GROUP BY symbol", "bars"))
def o05_o07_union_dedup(spark, sf):
    bars = B.brand_bars(spark, sf)
    parts = [bars.where(c).select("symbol", "dt") for c in ("symbol LIKE '%-USD'", "symbol NOT LIKE '%-USD'", "symbol LIKE '^%'")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return whole.groupBy("symbol").agg(F.min("dt").alias("first_dt"))
