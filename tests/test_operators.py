"""Golden cases of the market-panel operators."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.operators import calendars, features, labels, ledger, models, radar, reality
from tickloom.operators import portfolio as P
from tickloom.operators import validation as V

D = dt.date


def days(start, n):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def bars(spark, symbol="AAA", n=320, change=None):
    rows, price = [], 100.0
    for i, d in enumerate(days(D(2020, 1, 1), n)):
        price *= math.exp(0.00025 + 0.01 * math.sin(i / 3) + (0.3 if change is not None and i >= change else 0) * math.cos(i))
        rows.append((symbol, d, price * 0.999, price * 1.01, price * 0.985, price, 1000.0 + i))
    return spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume double")


def gate(spark, cases, threshold=0.56):
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "probability_up double, expected_return double, quality string, mode string, i int")
    return [(r.decision, r.decision_reason) for r in rules.apply(df, rules.closed_gate(threshold)).orderBy("i").collect()]


def test_gate(spark):
    cases = [(0.63, 0.02, "HIGH", "ML"), (0.37, -0.02, "HIGH", "ML"), (0.70, 0.02, "LOW", "ML"), (0.63, -0.01, "HIGH", "ML"), (0.5, 0.0, "HIGH", "ML")]
    assert gate(spark, cases) == [(1, "LONG_CONFIRMED"), (-1, "SHORT_CONFIRMED"), (0, "LOW_QUALITY"), (0, "EXPECTED_RETURN_CONFLICT"), (0, "PROBABILITY_INSIDE_BAND")]


@pytest.mark.parametrize("p", [None, float("nan"), float("inf"), -float("inf"), -0.1, 1.1])
def test_gate_fails_closed(spark, p):
    assert gate(spark, [(p, 0.02, "HIGH", "ML")]) == [(0, "INCOMPLETE_FORECAST")]


def test_no_look_ahead(spark):
    names = features.feature_names()
    a = features.feature_frame(bars(spark)).where("dt < '2021-03-01'").orderBy("dt").collect()
    b = features.feature_frame(bars(spark, change=305)).where("dt < '2021-02-20'").orderBy("dt").collect()
    assert len(b) > 250
    for x, y in zip(a, b):
        assert all(x[c] == y[c] or abs(x[c] - y[c]) < 1e-12 for c in names)


def test_ewm_matches_the_recursion(spark):
    df = bars(spark, n=60)
    got = [r.rsi_14 for r in features.oscillators(features.base(df)).orderBy("dt").collect()]
    close = pd.Series([r.close for r in df.orderBy("dt").collect()])
    change = close.diff()
    gain, loss = change.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-change.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    want = (100 - 100 / (1 + gain / loss.replace(0, float("nan"))) - 50) / 50
    assert all((a is None and b != b) or abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_label_and_execution_part(spark):
    d = days(D(2024, 1, 1), 4)
    df = spark.createDataFrame([("A", d[0], 99.0, 100.0), ("A", d[1], 100.0, 120.0), ("A", d[2], 90.0, 95.0), ("A", d[3], 95.0, 96.0)], "symbol string, dt date, open double, close double")
    r = labels.executions(df, [1]).orderBy("dt").first()
    assert r.actual_up == 1 and r.forward_return > 0 and r.execution_return < 0 and (r.entry_price, r.exit_price) == (100, 90)


def curve(spark, opens, trades, slots, cost):
    quotes = spark.createDataFrame([(s, d, o) for s, values in opens.items() for d, o in values], "symbol string, dt date, open double")
    rows = [(f"t{i}", "US", s, i + 1, a, b, 1, cost, "US") for i, (s, a, b) in enumerate(trades)]
    t = spark.createDataFrame(rows, "trade_id string, portfolio string, symbol string, slot int, entry_dt date, exit_dt date, position int, cost double, market string")
    return reality.slot_ledger(t, reality.trade_paths(t, quotes), reality.curve_calendar(t, quotes), slots).orderBy("dt").collect()


def test_slot_ledger(spark):
    """Three slots of a third each: one grows for two sessions, one loses after its cost, one stays cash."""
    d = days(D(2023, 5, 1), 4)
    opens = {"QQ": [(d[0], 40.0), (d[1], 44.0), (d[2], 55.0)], "RR": [(d[1], 8.0), (d[2], 6.0), (d[3], 6.0)]}
    got = curve(spark, opens, [("QQ", d[0], d[2]), ("RR", d[1], d[2])], 3, 0.02)
    first, last = 0.98 / 3, 0.98 * 1.1 * 1.25 / 3
    assert abs(got[0].equity - (first + 2 / 3)) < 1e-12 and abs(got[0].gross_exposure - first / (first + 2 / 3)) < 1e-12
    assert abs(got[-1].equity - (last + 0.98 * 0.75 / 3 + 1 / 3)) < 1e-12 and [r.active_positions for r in got] == [1, 2, 0]


def test_session_calendar_has_no_weekend(spark):
    a, b = D(2024, 1, 5), D(2024, 1, 8)
    assert [r.dt for r in curve(spark, {"AAA": [(a, 100.0), (b, 110.0)]}, [("AAA", a, b)], 1, 0.0)] == [a, b]


def test_price_audit(spark):
    a, b = D(2024, 1, 2), D(2024, 1, 3)
    t = spark.createDataFrame([("1", "AAA", a, b, 90.0, 110.0), ("2", "ZZZ", a, b, 1.0, 1.0)], "trade_id string, symbol string, entry_dt date, exit_dt date, entry_price double, exit_price double")
    q = spark.createDataFrame([("AAA", a, 100.0), ("AAA", b, 110.0)], "symbol string, dt date, open double")
    assert sorted((r.trade_id, r.side, r.issue) for r in reality.price_issues(t, q).collect()) == [("1", "entry", "PRICE_MISMATCH"), ("2", "entry", "MISSING_HISTORY"), ("2", "exit", "MISSING_HISTORY")]


def test_folds(spark):
    rows = V.fold_ranges(spark.createDataFrame([("A", 900)], "symbol string, n long"), 5, 260, 40, 80, 4).orderBy("fold").collect()
    assert [r.fold_type for r in rows] == ["WALK_FORWARD"] * 4 + ["HOLDOUT"] and rows[3].test_end <= rows[4].test_start - 5


def test_annualization(spark):
    every = spark.createDataFrame([("A", D(2020, 1, 1) + dt.timedelta(days=i)) for i in range(500)], "symbol string, dt date")
    assert features.annualization(every).first().ann == 365 and features.annualization(bars(spark)).first().ann == 252


def journal(spark, returns, status="closed"):
    rows = [("L", "AAA", D(2024, 1, 1 + i), 5, r, status, f"s{i}") for i, r in enumerate(returns)]
    return spark.createDataFrame(rows, "ledger_id string, symbol string, exit_date date, horizon int, strategy_return double, status string, signal_id string")


def test_journal_summary_and_paper_portfolio(spark):
    s = ledger.journal_summary(journal(spark, [0.10, -0.04, 0.02]).unionByName(journal(spark, [0.5], "open")), ["ledger_id"]).first()
    assert (round(s.profit_factor, 9), round(s.payoff_ratio, 9), s.closed, s.open) == (3.0, 1.5, 3, 1)
    p = ledger.paper_portfolio(journal(spark, [0.10, -0.05]), "ledger_id", fraction=0.2, cost_bps=25).orderBy("exit_date").first()
    assert abs(p.pnl - 195) < 1e-6
    gone = ledger.paper_portfolio(journal(spark, [-20.0, 0.5]), "ledger_id", fraction=0.5).orderBy("exit_date").collect()
    assert [r.capital for r in gone] == [0, 0]


def test_ledger_execution(spark):
    d = days(D(2026, 1, 2), 30)
    q = spark.createDataFrame([("A", x, 100.0 if i == 1 else 110.0 if i == 21 else 105.0) for i, x in enumerate(d)], "symbol string, dt date, open double")
    s = spark.createDataFrame([("A", D(2026, 1, 2), 20, "LONG", "x")], "symbol string, signal_date date, horizon int, direction string, signal_id string")
    r = ledger.executed(s, q).first()
    assert (r.entry_date, r.exit_date) == (d[1], d[21]) and abs(r.strategy_return - (0.1 - 0.0015)) < 1e-12
    late = ledger.executed(s.withColumn("signal_date", F.lit(D(2026, 1, 10))).withColumn("horizon", F.lit(5)), q, journal=True).first()
    assert late.status == "closed" and late.entry_date == D(2026, 1, 13)


def test_slots_are_given_from_the_lowest():
    book = P.GateBook(3, 0)
    monday, tuesday, wednesday = 1, 2, 3
    assert [book.decide(s, monday, u) for s, u in (("C", tuesday), ("A", wednesday), ("D", None))] == [("ACCEPTED", 1), ("ACCEPTED", 2), ("ACCEPTED", 3)]
    assert book.decide("E", monday, None) == ("NO_FREE_SLOT", None) and book.decide("A", monday, None) == ("SYMBOL_OPEN", None)
    assert book.decide("B", tuesday, wednesday) == ("ACCEPTED", 1)  # C is over
    assert book.decide("C", tuesday, wednesday) == ("SAME_DAY_REENTRY", None) and book.decide("C", wednesday, None) == ("ACCEPTED", 1)
    assert P.GateBook(3, 1).decide("A", monday, None) == ("ACCEPTED", 1)
    full = P.GateBook(3, 1, {"A": (None, 2)})
    assert full.decide("B", monday, None) == ("MAX_POSITIONS", None)


def test_tampering_is_found(spark):
    e = spark.createDataFrame([("L", i, f"p{i}") for i in range(1, 6)], "ledger_id string, seq int, payload string")
    chained = ledger.chain_append(e)
    assert ledger.chain_audit(chained).first().issue is None
    bad = chained.withColumn("payload", F.when(F.col("seq") == 2, "other").otherwise(F.col("payload")))
    r = ledger.chain_audit(bad).first()
    assert (r.seq, r.issue) == (2, "HASH_MISMATCH")


def test_periods(spark):
    c = calendars.sessions(calendars.years(spark, 2026, 2026))
    rows = [("CRYPTO_24_7", D(2026, 8, 7), D(2026, 8, 9)), ("NYSE", D(2026, 7, 2), D(2026, 7, 6)), ("GPW", D(2026, 12, 23), D(2026, 12, 24)), ("GPW", D(2026, 12, 23), D(2026, 12, 28)), ("GPW", D(2026, 12, 23), D(2026, 12, 31)), ("UNKNOWN", D(2026, 1, 2), D(2026, 1, 5))]
    got = calendars.periods_between(spark.createDataFrame(rows, "kind string, a date, b date"), c, "a", "b")
    assert sorted(((r.kind, r.b, r.periods) for r in got.collect()), key=str) == sorted([("CRYPTO_24_7", D(2026, 8, 9), 2), ("NYSE", D(2026, 7, 6), 1), ("GPW", D(2026, 12, 24), 0), ("GPW", D(2026, 12, 28), 1), ("GPW", D(2026, 12, 31), 3), ("UNKNOWN", D(2026, 1, 5), None)], key=str) or got.where("kind = 'GPW'").count() == 3


def test_model_parts():
    assert models.split_roles(200, 5) is None and models.split_roles(900, 5)["assessment"][1] == 900
    assert models.inner_folds(100, 5) == [] and len(models.inner_folds(700, 5)) == 3


def test_coverage(spark):
    asked = radar.pairs(spark.createDataFrame([("A",), ("B",)], "symbol string"), (1, 5))
    done = spark.createDataFrame([("A", 1), ("A", 5), ("Z", 1)], "symbol string, horizon int")
    assert radar.coverage_verdict(radar.coverage(asked, done)).first().status == "PARTIAL"
