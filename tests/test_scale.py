"""What takes the place of one task for a whole group: quantiles by rank, selection by candidates, streams by batches, each against a plain loop."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ledger, quantiles, reality
from tickloom.operators import validation as V
from tickloom.streaming import jobs, ordered

START = dt.date(2021, 3, 1)


def day(n):
    return START + dt.timedelta(days=int(n))


@pytest.mark.parametrize("q", [0.5, 0.0, 1.0, 0.237])
def test_quantile_by_narrowing(spark, q):
    rng = np.random.default_rng(5)
    groups = {"flat": np.full(3000, 0.25), "two": np.array([1.0, 4.0]), "one": np.array([-3.0]), "wide": np.exp(rng.normal(0, 40, 5000)) * rng.choice([-1, 1], 5000), "tied": np.where(rng.random(6000) < 0.5, 7.0, rng.normal(7, 1, 6000)), None: rng.normal(0, 1, 2500)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("one", None), ("two", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r.quantile for r in quantiles.exact_quantile(df, ["k"], "v", q, few=50).collect()}
    assert got == {k: pytest.approx(float(np.quantile(v, q)), rel=1e-15, abs=0) for k, v in groups.items()}
    everything = quantiles.exact_quantile(df, [], "v", q, few=50).collect()
    assert [r.quantile for r in everything] == [pytest.approx(float(np.quantile(np.concatenate(list(groups.values())), q)), rel=1e-14)]
    assert quantiles.exact_quantile(df.limit(0), ["k"], "v").count() == 0


def test_grouping_rows_have_the_levels_of_grouping_id(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0), ("a", 2, 5.0)], "x string, y int, v double")
    sets = [["x"], ["y"], []]
    want = {(r.x, r.y, r.level): r.s for r in df.groupingSets([[F.col(k) for k in s] for s in sets], F.col("x"), F.col("y")).agg(F.grouping_id().alias("level"), F.sum("v").alias("s")).collect()}
    got = {(r.x, r.y, r.level): r.s for r in quantiles.grouping_rows(df, sets, ["x", "y"], ["v"]).groupBy("x", "y", "level").agg(F.sum("v").alias("s")).collect()}
    assert got == want


def test_forecasts_from_running_sums(spark):
    rng, price, rows = np.random.default_rng(6), 50.0, []
    for i in range(420):
        price *= float(np.exp(rng.normal(0, 0.02)))
        rows.append(("A", day(i), price * 0.99, price))
    got = {(r.dt, r.horizon): r for r in V.factor_forecast(spark.createDataFrame(rows, "symbol string, dt date, open double, close double")).collect()}
    close = pd.Series([r[3] for r in rows])
    x = np.log(close / close.shift(20))
    for h in (1, 5, 20):
        px, py = x.shift(h), close / close.shift(h) - 1
        for i in (299, 350, 419):
            a, b = px[i - 249 : i + 1], py[i - 249 : i + 1]
            known = a.notna()
            slope = np.polyfit(a[known], b[known], 1)[0]
            er = min(max(b[known].mean() + slope * (x[i] - a[known].mean()), -0.2), 0.2)
            assert abs(got[(day(i), h)].expected_return - er) < 2e-6
            assert abs(got[(day(i), h)].probability_up - 1 / (1 + np.exp(-4 * er / b.std()))) < 2e-6


# selection


def greedy(rows, slots, cap, reentry=False):
    """One portfolio: rows (symbol, entry, exit) in order."""
    held, out = {}, []
    for symbol, entry, exit_ in rows:
        held = {s: x for s, x in held.items() if (x[1] > entry if reentry else x[1] >= entry)}
        if any(x[0] == symbol for x in held.values()):
            out.append(("SYMBOL_OVERLAP", None))
        elif len(held) >= cap:
            out.append(("GLOBAL_POSITION_CAP", None))
        else:
            slot = min(set(range(1, slots + 1)) - set(held))
            held[slot] = (symbol, exit_)
            out.append(("SELECTED", slot))
    return out


SIGNALS = "portfolio string, symbol string, horizon int, dt date, entry_dt date, exit_dt date, probability_up double, expected_return double, position int, ret double"


def signals(rng, n, days, symbols, portfolio="p"):
    out = []
    for i in range(n):
        start = rng.randrange(days)
        out.append((portfolio, f"s{rng.randrange(symbols)}", 5, day(start), day(start + 1), day(start + 1 + rng.choice([0, 0, 1, 4, 30])), round(rng.random(), 2), i / 1e6, 1, 0.01))
    return out


@pytest.mark.parametrize("slots,most,reentry", [(5, None, False), (3, 2, False), (2, None, True), (1, None, False)])
def test_selection_against_a_loop(spark, slots, most, reentry):
    rng = random.Random(slots)
    rows = signals(rng, 700, 40, 9) + signals(rng, 300, 400, 30, "q") + [("empty", "s1", 5, day(1), day(2), day(3), 0.5, 0.1, 0, 0.0)]
    got = reality.selection_audit(spark.createDataFrame(rows, SIGNALS), ["portfolio"], slots, most, reentry=reentry).collect()
    assert len(got) == 1000
    for p in ("p", "q"):
        order = sorted((r for r in got if r.portfolio == p), key=lambda r: (r.entry_dt, r.dt, r.symbol, r.horizon, -r.probability_up, -r.expected_return))
        want = greedy([(r.symbol, r.entry_dt, r.exit_dt) for r in order], slots, slots if most is None else min(most, slots), reentry)
        assert [(r.selection, r.slot) for r in order] == want


def test_selection_of_a_large_portfolio_walks_few_rows(spark):
    n = 200_000
    rows = spark.range(0, n, 1, 16).select(
        F.lit("p").alias("portfolio"), F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string")).alias("symbol"), F.lit(5).alias("horizon"), F.date_add(F.lit(START), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60)).cast("int")).alias("dt"),
        F.lit(0.5).alias("probability_up"), F.col("id").cast("double").alias("expected_return"), F.lit(1).alias("position"), F.lit(0.0).alias("ret"),
    ).withColumns({"entry_dt": F.date_add("dt", 1), "exit_dt": F.date_add("dt", 4)})
    from tickloom.operators import portfolio as P

    placed, place = P.placed(rows, [F.col("symbol"), -F.col("expected_return")], "signals")
    assert P.day_candidates(placed, ["portfolio"], "entry_dt", place, 10, F.lit(False)).count() <= 60 * 10
    got = reality.selection_audit(rows, ["portfolio"], 5).toPandas()
    got = got.sort_values(["entry_dt", "dt", "symbol", "horizon", "probability_up", "expected_return"], ascending=[True, True, True, True, False, False])
    want = greedy(got[["symbol", "entry_dt", "exit_dt"]].itertuples(index=False), 5, 5)
    assert got["selection"].tolist() == [w[0] for w in want] and got["slot"].fillna(0).astype(int).tolist() == [w[1] or 0 for w in want]


def gate_rows(rng, n=400):
    rows = []
    for i in range(n):
        start = rng.randrange(60)
        end = None if rng.random() < 0.01 else day(start + rng.choice([1, 2, 2, 3, 9]))
        rows.append((rng.choice("LM"), f"{i:04d}", f"s{rng.randrange(12)}", day(start), end))
    return rows


GATE = "ledger_id string, signal_id string, symbol string, signal_date date, exit_date date"


def plain_gate(rows, slots=5, most=5):
    held, out = {}, {}
    for _, signal_id, symbol, start, end in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        live = {s: x for s, x in held.items() if x[0] is None or x[0] > start}
        if any(x[1] == symbol and x[0] == start for x in held.values()) or (symbol, start) in out.setdefault("ended", set()):
            said = ("SAME_DAY_REENTRY", None)
        elif any(x[1] == symbol for x in live.values()):
            said = ("SYMBOL_OPEN", None)
        elif len(live) >= slots:
            said = ("NO_FREE_SLOT", None)
        else:
            said = ("ACCEPTED", min(set(range(1, slots + 1)) - set(live)))
            if said[1] in held and held[said[1]][0] == start:
                out["ended"].add((held[said[1]][1], start))  # its slot is taken over, its symbol still waits
            held[said[1]] = (end, symbol)
        out[signal_id] = said
    out.pop("ended", None)
    return out


def test_gate_against_a_loop(spark):
    rows = gate_rows(random.Random(13))
    got = ledger.gate_portfolios(spark.createDataFrame(rows, GATE)).collect()
    want = {k: v for book in "LM" for k, v in plain_gate([r for r in rows if r[0] == book]).items()}
    assert {r.signal_id: (r.decision, r.slot) for r in got} == want and {v[0] for v in want.values()} == {"SAME_DAY_REENTRY", "SYMBOL_OPEN", "NO_FREE_SLOT", "ACCEPTED"}


# streams


def test_gate_as_a_stream_with_late_and_repeated_signals(spark):
    rng = random.Random(14)
    rows = gate_rows(rng, 150)
    early, late = [r for r in rows if r[3] < day(30)], [r for r in rows if r[3] >= day(30)]
    rng.shuffle(early)
    tardy = ("L", "zzz", "s1", day(2), day(9))  # comes when the watermark is far past its day
    frames = [spark.createDataFrame([(dt.datetime.combine(r[3], dt.time()), *r) for r in part], f"ts timestamp, {GATE}") for part in (early[:40], early[40:] + early[:60], late, [*late[:5], tardy])]
    got = jobs.drained_in_parts(frames, lambda s: ordered.gated(s, late="40 days"), "gate").where("ledger_id IS NOT NULL").collect()
    want = {k: v for book in "LM" for k, v in plain_gate([r for r in rows if r[0] == book]).items()}
    assert {r.signal_id: (r.decision, r.slot) for r in got if r.signal_id != "zzz"} == want and len(got) in (len(want), len(want) + 1)
    sharp = jobs.drained_in_parts(frames, lambda s: ordered.gated(s, late="1 day"), "gate").where("signal_id = 'zzz'")
    assert sharp.count() == 0


def test_refresh_changes_nothing_when_a_batch_is_replayed(spark):
    rng = random.Random(15)
    rows = [(f"s{i % 3}", dt.datetime.combine(day(i), dt.time()), rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    parts = [df.where(F.col("ts") < F.lit(day(40))), df.where((F.col("ts") >= F.lit(day(40))) & (F.col("symbol") != "s1"))]

    def scan(bars):
        return bars.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "ts").alias("last"))

    whole = sorted(map(tuple, scan(parts[0].unionByName(parts[1])).collect()))
    assert sorted(map(tuple, jobs.refreshed_scan(parts, scan, "r").collect())) == whole
    assert sorted(map(tuple, jobs.refreshed_scan(parts, scan, "r", replay=True).collect())) == whole


def test_context_of_a_stream_that_comes_out_of_order(spark):
    rng = random.Random(16)
    bars = [(s, i, 100 + rng.random()) for s in ("A", "M") for i in range(30) if s == "A" or i % 3]
    frames = bars[:]
    rng.shuffle(frames)
    make = lambda part: spark.createDataFrame([(dt.datetime.combine(day(i), dt.time()), s, c) for s, i, c in part], "ts timestamp, symbol string, close double")
    names = spark.createDataFrame([("A", "M")], "symbol string, benchmark string")
    got = jobs.drained_in_parts([make(frames[:20]), make(frames[20:])], lambda s: ordered.market_context(s, names, (1, 5), late="60 days"), "context")
    rows = {r.dt: r for r in got.where("symbol = 'A'").collect()}
    market = {i: c for s, i, c in bars if s == "M"}
    last, seen = None, []
    for i in range(30):
        last = market.get(i, last)
        seen.append(last)
        assert rows[day(i)].market_close == last
        want = np.log(seen[i] / seen[i - 5]) if i >= 5 and seen[i - 5] else None
        assert rows[day(i)].market_ret_5 == (pytest.approx(want) if want is not None else None)


# walk-forward with refits


def series(rng, n, d=7):
    x = rng.normal(0, [1, 5, 0.01, 1, 1, 30, 1][:d], (n, d)) + rng.normal(0, 3, d)
    r = 0.01 * (x[:, 0] - x[:, 0].mean()) + rng.normal(0, 0.02, n)
    return x, (r > 0).astype(int), r


def plain_ridge(x, r, alpha):
    low, median, high = np.percentile(x, [25, 50, 75], axis=0)
    z = np.column_stack([np.ones(len(x)), (x - median) / (high - low)])
    b = np.linalg.solve(z.T @ z + np.diag([1e-9, *[alpha] * x.shape[1]]), z.T @ r)
    return lambda new: np.column_stack([np.ones(len(new)), (new - median) / (high - low)]) @ b


def plain_logistic(x, y, c):
    from tickloom.operators import models as M

    scale = M.Scaled(x)
    b = M.logistic(scale(x), y, c)
    return lambda new: 1 / (1 + np.exp(-np.clip(scale(new) @ b, -30, 30)))


def test_fits_on_beginnings_equal_plain_fits():
    from tickloom.operators import walkforward as WF

    x, y, r = series(np.random.default_rng(7), 700)
    s = WF.Beginnings(x, y, r)
    for end in (130, 192, 333, 480, 700):
        assert np.allclose(s.ones[-50:] @ s.ridge(end, 18.0), plain_ridge(x[:end], r[:end], 18.0)(x[-50:]), rtol=1e-8, atol=1e-10)
        assert np.allclose(WF.sigmoid(s.ones[-50:] @ s.logistic(end, 0.35, "a")), plain_logistic(x[:end], y[:end], 0.35)(x[-50:]), rtol=1e-6, atol=1e-8)


def test_walk_forward_against_refits_from_scratch():
    from tickloom.operators import models as M
    from tickloom.operators import walkforward as WF

    x, y, r = series(np.random.default_rng(8), 620)
    names = [f"f{i}" for i in range(7)]
    pdf = pd.DataFrame(x, columns=names).assign(symbol="A", horizon=5, dt=[day(i) for i in range(620)], y=y, forward_return=r)
    got = WF.walk(pdf.sample(frac=1, random_state=1), names, 60)
    assert got["dt"].tolist() == [day(i) for i in range(341, 620)] and got["refit"].tolist() == [(i - 341) // 60 for i in range(341, 620)]
    for k, low in enumerate(range(341, 620, 60)):
        part, known = got[got["refit"] == k], low - 4
        assert (part["known_rows"] == known).all() and (part["known_until"] == day(known - 1)).all()
        last = pdf.iloc[:known]
        roles = M.split_roles(known, 5)
        train = roles["train"][1]
        p_oof, y_oof = [], []
        for end, start, stop in M.inner_folds(train, 5):
            p_oof.append(plain_logistic(x[:end], y[:end], 0.35)(x[start:stop]))
            y_oof.append(y[start:stop])
        core = plain_logistic(x[:train], y[:train], 0.35)
        block = slice(*roles.get("calibration", (0, 0)))
        curve = M._calibration(np.concatenate(p_oof) if p_oof else np.zeros(0), np.concatenate(y_oof) if y_oof else np.zeros(0, int), core(x[block]) if block.stop else np.zeros(0), y[block])
        raw = plain_logistic(x[:known], y[:known], 0.35)(x[low : low + 60])
        want = raw if curve is None else 1 / (1 + np.exp(-(curve[0] + curve[1] * raw)))
        assert np.allclose(part["p"], want, rtol=1e-5, atol=1e-7) and np.allclose(part["m"], plain_ridge(x[:known], r[:known], 18.0)(x[low : low + 60]), rtol=1e-7, atol=1e-9)
        use = slice(*roles["assessment"])
        left = r[use] - plain_ridge(x[:train], r[:train], 18.0)(x[use])
        assert part["sigma"].iloc[0] == pytest.approx(max(left.std(ddof=1), 0.35 * r[use].std(ddof=1)), rel=1e-7) and len(last) == known


def test_walk_forward_knows_no_later_label():
    from tickloom.operators import walkforward as WF

    x, y, r = series(np.random.default_rng(9), 500)
    names = [f"f{i}" for i in range(7)]
    pdf = pd.DataFrame(x, columns=names).assign(symbol="A", horizon=20, dt=[day(i) for i in range(500)], y=y, forward_return=r)
    later = pdf.copy()
    later.loc[later.index >= 400 - 20 + 1, ["y", "forward_return"]] = [0, -1.0]
    a, b = WF.walk(pdf, names, 100), WF.walk(later, names, 100)
    same = a["dt"] < day(401)
    assert same.sum() == 101 and np.array_equal(a[same][["p", "m", "auc"]], b[same][["p", "m", "auc"]])


# extra-trees


def panel(spark, n=3000, d=4):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(float)
    rows = [("up", int(k), x[i].tolist(), float(y[i]), 1.0) for i, k in enumerate(rng.integers(-(2**62), 2**62, n))]
    rows += [("move", r[1], r[2], r[2][2] * 2, 1.0) for r in rows]
    return rows, spark.createDataFrame(rows, "model string, key long, x array<double>, y double, w double").repartition(5)


def test_trees_take_the_best_of_their_cuts(spark):
    from tickloom.operators import trees as T

    rows, df = panel(spark)
    forests = T.grow(df, {"up": 3, "move": 3}, 4, depth=3, leaf=10, seed=5)
    for model, forest in forests.items():
        own = [r for r in rows if r[0] == model]
        keys, x, y = np.array([r[1] for r in own]), np.array([r[2] for r in own]), np.array([r[3] for r in own])
        for t in range(3):
            times = T.drawn(keys, t, 5)
            inside = {1: times > 0}
            assert abs(times.mean() - 1) < 0.1
            for node in range(1, 16):
                at = inside.get(node)
                if at is None:
                    continue
                total = times[at].sum()
                assert forest.value[t, node] == pytest.approx((times[at] * y[at]).sum() / total)
                if node >= 8:
                    assert forest.feature[t, node] == -1
                    continue
                cuts, best, score = T.draw_cuts(x[at].min(0), x[at].max(0), 0.65, (5, t, node)), -1, 1e-12
                for f in range(4):
                    left = at & (x[:, f] <= cuts[f])
                    right = at & ~left
                    if not np.isnan(cuts[f]) and min(times[left].sum(), times[right].sum()) >= 10:
                        error = lambda s: (times[s] * (y[s] - np.average(y[s], weights=times[s])) ** 2).sum()
                        if (gain := error(at) - error(left) - error(right)) > score + 1e-9:
                            best, score = f, gain
                assert forest.feature[t, node] == best
                if best >= 0:
                    assert forest.cut[t, node] == pytest.approx(cuts[best])
                    inside |= {2 * node: at & (x[:, best] <= cuts[best]), 2 * node + 1: at & (x[:, best] > cuts[best])}
    got = T.predict(df.where("model = 'up'"), forests, ["y"], 4).toPandas()
    assert (abs(got["prediction"] - got["y"]) < 0.5).mean() > 0.85


def test_missing_values_are_medians(spark):
    from tickloom.operators import trees as T

    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None), (float("nan"), None), (100.0, None)], "a double, b double")
    got = [r.x for r in T.imputed(df, ["a", "b"], F.coalesce(F.col("a") < 50, F.lit(True))).collect()]
    assert got == [[1.0, 0.0], [3.0, 0.0], [1.0, 0.0], [1.0, 0.0], [100.0, 0.0]]


# ledgers


def test_canonical_text_is_the_json_of_sorted_keys(spark):
    import json

    rows = [("b\"\\x\n", 3, 0.1, day(1)), (None, None, None, None), ("é", -1, -2.5, day(2))]
    df = spark.createDataFrame(rows, "name string, count int, value double, at date")
    fields = {"name": "text", "count": "whole", "value": "number", "at": "date"}
    got = [r.t for r in df.select(ledger.canonical(fields).alias("t")).collect()]
    for text, (name, count, value, at) in zip(got, rows):
        want = {"name": name, "count": count, "value": value, "at": None if at is None else str(at)}
        assert json.loads(text) == want and list(json.loads(text)) == sorted(want) and ": " not in text
    assert '"value":0.100000000000' in got[0]


def test_chain_goes_on_from_its_heads(spark):
    import hashlib

    payload = lambda k, i: f'{{"k":"{k}{i}","previous_hash":"\u0000"}}'
    rows = [(k, i, payload(k, i)) for k in "AB" for i in range(1, 60)] + [("C", i, payload("C", i)) for i in range(40, 50)]
    df = spark.createDataFrame(rows, "ledger_id string, seq int, payload string").repartition(5)
    first = ledger.chain_append(df.where("seq <= 30"))
    whole = first.unionByName(ledger.chain_append(df.where("seq > 30"), ledger.chain_heads(first)))
    got = {(r.ledger_id, r.seq): r for r in whole.collect()}
    for k, low in (("A", 1), ("B", 1), ("C", 40)):
        before = "GENESIS"
        for i in range(low, 60 if low == 1 else 50):
            assert got[k, i].previous_hash == before
            before = hashlib.sha256(payload(k, i).replace("\u0000", before).encode()).hexdigest()
            assert got[k, i].event_hash == before
    for segment in (7, 10_000):
        assert {r.ledger_id: r.issue for r in ledger.chain_audit(whole, segment).collect()} == dict.fromkeys("ABC")
        bent = whole.withColumn("event_hash", F.when((F.col("ledger_id") == "A") & (F.col("seq") == 20), "x").otherwise(F.col("event_hash")))
        gone = whole.where("NOT (ledger_id = 'B' AND seq = 14)")
        assert {(r.ledger_id, r.seq, r.issue) for r in ledger.chain_audit(bent.where("ledger_id = 'A'"), segment).collect()} == {("A", 20, "HASH_MISMATCH")}
        assert {(r.ledger_id, r.seq, r.issue) for r in ledger.chain_audit(gone.where("ledger_id = 'B'"), segment).collect()} == {("B", 15, "BROKEN_LINK")}


def test_numbers_have_no_gaps(spark):
    rng = random.Random(17)
    rows = [(rng.choice("ab"), day(rng.randrange(9)), i) for i in range(200)]
    got = ledger.numbered(spark.createDataFrame(rows, "k string, at date, i int"), ["k"], "at", ["i"]).collect()
    for k in "ab":
        own = sorted((r for r in got if r.k == k), key=lambda r: (r.at, r.i))
        assert [r.seq for r in own] == list(range(1, len(own) + 1))


def test_a_batch_is_taken_whole_or_not_at_all(spark):
    rows = [("one", "s1", "L", day(1), 5), ("one", "s2", "L", day(1), 5), ("two", "s3", "L", day(1), 5), ("two", "s4", "L", day(2), None), ("three", "s1", "L", day(1), 5), ("three", "s5", "L", day(3), 20)]
    df = spark.createDataFrame(rows, "batch_id string, signal_id string, ledger_id string, signal_date date, horizon int")
    box = ledger.Intake(spark, "intake-test", {"HORIZON": F.col("horizon").isin(5, 20)})
    assert {(r.batch_id, r["rows"], r.failed) for r in box.submit(df).collect()} == {("one", 2, ""), ("two", 2, "HORIZON"), ("three", 2, "")}
    for _ in range(2):  # the same batches come again
        assert sorted(r.signal_id for r in box.signals().collect()) == ["s1", "s2", "s5"]
        assert sorted(r.snapshot for r in box.audits().collect()) == [day(1), day(3)]
        box.submit(df.where("batch_id <> 'three'"))
    box.submit(df.where("batch_id = 'two'").withColumn("horizon", F.lit(5)))  # mended
    assert box.signals().count() == 5


def test_watchlist_versions(spark):
    kind = "symbol string, at date, state string"
    one = spark.createDataFrame([("A", day(1), "LONG"), ("A", day(2), "LONG"), ("A", day(4), "SHORT"), ("B", day(3), None), ("C", day(1), "LONG")], kind)
    two = spark.createDataFrame([("A", day(6), None), ("A", day(8), "LONG"), ("B", day(6), "LONG"), ("C", day(9), "LONG")], kind)
    want = {("A", "LONG", day(1), day(4)), ("A", "SHORT", day(4), day(6)), ("A", "LONG", day(8), None), ("B", "LONG", day(6), None), ("C", "LONG", day(1), None)}
    history = None
    for part in (one, one, two, two, one):
        history = ledger.watch_versions(history, part, ["symbol"])
    assert {tuple(r) for r in history.select("symbol", "state", "valid_from", "valid_to").collect()} == want


def test_role_columns_are_the_roles(spark):
    from tickloom.operators import models as M

    for h in (1, 5, 20):
        rows = spark.range(240, 1500, 7).withColumns(M.role_columns(F.col("id"), h)).collect()
        for r in rows:
            roles = M.split_roles(r.id, h)
            if roles is None:
                assert r.train_end is None and r.assessment_start is None
                continue
            assert r.train_end == roles["train"][1] and r.assessment_start == roles["assessment"][0]
            assert (r.calibration_start, r.calibration_end) == roles.get("calibration", (None, None))


def test_a_strict_report_fails_on_prices(spark):
    d = [day(i) for i in range(6)]
    bars = spark.createDataFrame([("A", x, 10.0 + i) for i, x in enumerate(d)], "symbol string, dt date, open double")
    trade = ("t1", "US|5", "US", 5, "A", 1, d[1], d[3], 11.0, 12.5, 1, 0.01, "SELECTED", "A", 0.1, 1, 1, 0.6, 0.01)
    kind = "trade_id string, portfolio string, market string, horizon int, symbol string, slot int, entry_dt date, exit_dt date, entry_price double, exit_price double, position int, cost double, selection string, benchmark string, ret double, actual_up int, execution_up int, probability_up double, expected_return double"
    audit = spark.createDataFrame([trade], kind)
    with pytest.raises(reality.PriceIssues, match="PRICE_MISMATCH: 1, first t1"):
        reality.portfolio_report(audit, audit, bars, 2, strict=True)
    right = audit.withColumn("exit_price", F.lit(13.0))
    assert reality.portfolio_report(right, right, bars, 2, strict=True).first().selected_trades == 1
    assert reality.portfolio_report(audit, audit, bars, 2).first().price_issues == 1


@pytest.mark.parametrize("name", ["f08_report_parts", "p03_decision_state"])
def test_trades_become_bars_once_in_a_query(spark, monkeypatch, name):
    from tickloom.plans import catalog
    from tickloom.sources import bars

    plain, read = bars.trades, []
    monkeypatch.setattr(bars, "trades", lambda *a, **k: read.append(1) or plain(*a, **k))
    found = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(read) == 1 and not any("lineitem" in f for f in found.inputFiles())
