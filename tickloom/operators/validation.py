"""Walk-forward records and their reports.

A record is one decision point: forecast, gate, execution from next open to open, and benchmarks. Reports are conditional
aggregates; group reports come from one pass of grouping sets where measures add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.functions.columns import clip, ratio, series
from tickloom.operators.quantiles import exact_quantile, grouping_rows, same_keys
from tickloom.sources.storage import stored

HORIZONS = (1, 5, 20)
COST = 0.002
FIRST, WINDOW, FOLD_ROWS = 300, 250, 90


def _forecasts(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Trailing one-factor forecasts with the executions of the same rows; at each row only labels that are known there take
    part, by row position. All windows are of one symbol in time order: one shuffle and one sort serve forecasts and executions.

    The moments of the last WINDOW rows are differences of running sums, so that a row costs the same however long the window is;
    values are taken from the symbol's first one, and returns are small: the sums lose few digits."""
    by = series("symbol")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumns({"pos": F.row_number().over(by), "x": F.log(F.col("close") / F.lag("close", 20).over(by)), "entry_dt": F.lead("dt", 1).over(by), "entry_price": F.lead("open", 1).over(by)})
    rows = rows.withColumns(
        {
            f"{name}_{h}": value
            for h in horizons
            for name, value in {
                "px": F.lag("x", h).over(by),
                "py": F.col("close") / F.lag("close", h).over(by) - 1,
                "exit_dt": F.lead("dt", h + 1).over(by),
                "exit_price": F.lead("open", h + 1).over(by),
                "forward": ratio(F.lead("close", h).over(by), "close") - 1,
            }.items()
        }
    )
    sums = {}
    for h in horizons:
        px, py = F.col(f"px_{h}"), F.col(f"py_{h}")
        both = px.isNotNull() & py.isNotNull()
        parts = {"n": both.cast("int"), "x": F.when(both, px), "y": F.when(both, py), "xx": F.when(both, px * px), "xy": F.when(both, px * py), "m": py.isNotNull().cast("int"), "s": py, "ss": py * py}
        sums |= {f"s_{name}_{h}": F.coalesce(F.sum(value).over(running), F.lit(0)) for name, value in parts.items()}
    rows = rows.withColumns(sums)
    rows = rows.withColumns({f"w_{c}": F.col(c) - F.coalesce(F.lag(c, WINDOW).over(by), F.lit(0)) for c in sums})
    fits = {}
    for h in horizons:
        n, x, y, xx, xy, m, s, ss = (F.col(f"w_s_{name}_{h}") for name in ("n", "x", "y", "xx", "xy", "m", "s", "ss"))
        fits |= {f"slope_{h}": ratio(n * xy - x * y, n * xx - x * x), f"mean_x_{h}": ratio(x, n.cast("double")), f"mean_y_{h}": ratio(y, n.cast("double"))}
        fits[f"std_y_{h}"] = F.when(m > 1, F.sqrt(F.greatest(ss - s * s / m, F.lit(0.0)) / (m - 1)))
    rows = rows.withColumns(fits).where(F.col("pos") >= FIRST)
    names = ("slope", "mean_x", "mean_y", "std_y", "exit_dt", "exit_price", "forward")
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{n}_{h}").alias(n) for n in names]) for h in horizons])
    rows = rows.select("symbol", "dt", "pos", "x", "entry_dt", "entry_price", F.inline(each))
    er = clip(F.col("mean_y") + F.col("slope") * (F.col("x") - F.col("mean_x")), -0.2, 0.2)
    return rows.select(
        "symbol",
        "dt",
        "pos",
        "horizon",
        "x",
        F.round(er, 6).alias("expected_return"),
        F.round(1 / (1 + F.exp(-4 * er / F.col("std_y"))), 6).alias("probability_up"),
        F.round(1 / (1 + F.exp(-0.5 * F.col("x") / F.col("std_y"))), 6).alias("linear_probability"),
        "entry_dt",
        "entry_price",
        "exit_dt",
        "exit_price",
        F.col("forward").alias("forward_return"),
        F.when(F.col("forward").isNotNull(), (F.col("forward") > 0).cast("int")).alias("actual_up"),
        (ratio("exit_price", "entry_price") - 1).alias("execution_return"),
    )


def factor_forecast(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    return _forecasts(bars, horizons).select("symbol", "dt", "pos", "horizon", "x", "expected_return", "probability_up", "linear_probability")


def records(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    rows = _forecasts(bars, horizons).where("exit_price IS NOT NULL AND forward_return IS NOT NULL")
    rows = rules.apply(rows.withColumns({"quality": F.lit("HIGH"), "mode": F.lit("ML")}), [rules.CLASS[0], *rules.gate(0.52)])
    linear = F.when(F.col("linear_probability") >= 0.52, 1).when(F.col("linear_probability") <= 0.48, -1).otherwise(0)
    momentum = F.when(F.col("x") > 0, 1).otherwise(-1)
    gross = F.col("decision") * F.col("execution_return")
    return rows.select(
        "symbol",
        F.col("asset_class").alias("market"),
        "horizon",
        "dt",
        "pos",
        F.floor((F.col("pos") - FIRST) / FOLD_ROWS).cast("int").alias("fold"),
        "entry_dt",
        "exit_dt",
        "entry_price",
        "exit_price",
        "probability_up",
        "expected_return",
        F.col("decision").alias("position"),
        "decision_reason",
        gross.alias("gross_return"),
        (gross - F.abs("decision") * COST).alias("ret"),
        F.lit(COST).alias("cost"),
        (F.col("execution_return") - COST).alias("always_long_return"),
        F.col("execution_return").alias("buy_hold_return"),
        (momentum * F.col("execution_return") - COST).alias("momentum_return"),
        (linear * F.col("execution_return") - F.abs(linear) * COST).alias("linear_return"),
        "actual_up",
        (F.col("execution_return") > 0).cast("int").alias("execution_up"),
    )


ACTIVE = "position <> 0"


def active(name: str = "ret") -> Column:
    return F.when(F.expr(ACTIVE), F.col(name))


def profit_factor(x: Column, none_lost: Column | None = None) -> Column:
    """Gains by losses; where nothing was lost, `none_lost` if something was gained, else null."""
    gains, losses = F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))
    value = F.when(losses > 0, F.coalesce(gains, F.lit(0.0)) / losses)
    return value if none_lost is None else F.when(losses > 0, value).when(gains > 0, none_lost)


def measures() -> list[Column]:
    """What adds up; the median of `ret` is a selection of its own."""
    x = active()
    p = clip("probability_up", 1e-4, 1 - 1e-4)
    return [
        F.count("*").alias("observations"),
        F.count(x).alias("trades"),
        F.count_if(F.col("position") == 0).alias("rejected"),
        F.avg(x).alias("mean_return"),
        profit_factor(x, F.lit(float("inf"))).alias("profit_factor"),
        F.avg((x > 0).cast("double")).alias("hit_rate"),
        F.avg(F.pow(F.col("actual_up") - p, 2)).alias("brier"),
        F.avg("always_long_return").alias("always_long"),
        F.avg("buy_hold_return").alias("buy_hold"),
        F.avg("momentum_return").alias("momentum"),
        F.avg("linear_return").alias("linear"),
    ]


def with_median(report: DataFrame, rows: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    """report, a row for each group, with the median of `value` over rows; rows is a stored table."""
    medians = exact_quantile(rows, by, value, name="median_return").withColumnsRenamed({k: f"__m{i}" for i, k in enumerate(by)})
    return report.join(medians, same_keys(by, "__m"), "left").drop(*[f"__m{i}" for i in range(len(by))])


def trade_aggregate(rows: DataFrame) -> DataFrame:
    rows = stored(rows, "records")  # read once a pass of the median
    return with_median(rows.agg(*measures()), rows.where(ACTIVE), [])


def group_report(rows: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """The measures for several groupings in one pass, medians by selection; level tells the grouping, bit by bit over keys."""
    rows = stored(rows, "records")
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    report = grouped.agg(F.grouping_id().alias("level"), *measures())
    return with_median(report, grouping_rows(rows.where(ACTIVE), sets, keys, ["ret"]), [*keys, "level"])


def rejection_reasons(rows: DataFrame) -> DataFrame:
    return rows.where("position = 0").groupBy("market", "decision_reason").agg(F.count("*").alias("n"))


def auc(rows: DataFrame, by: list[str], score: str = "probability_up", label: str = "actual_up") -> DataFrame:
    """Area under the curve, ties averaged: ranks are sums over the distinct scores, so no sort of all rows is needed."""
    counts = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("n1"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n0"))
    value = (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return out.select(*by, F.when((F.col("n1") > 0) & (F.col("n0") > 0), value).otherwise(0.5).alias("auc"))


def cost_stress(rows: DataFrame, multipliers=(1.0, 2.0, 3.0)) -> DataFrame:
    """Returns under multiples of the cost; each active row meets the few multipliers."""
    rows = rows.where(ACTIVE).withColumn("k", F.explode(F.array(*[F.lit(m) for m in multipliers])))
    x = F.col("gross_return") - F.abs("position") * F.col("cost") * F.col("k")
    rows = rows.withColumn("stressed", x)
    rows, s = stored(rows.select("horizon", "k", "stressed"), "stressed"), F.col("stressed")
    report = rows.groupBy("horizon", "k").agg(F.avg(s).alias("mean_return"), profit_factor(s, F.lit(float("inf"))).alias("profit_factor"))
    return with_median(report, rows, ["horizon", "k"], "stressed")


def ranked(rows: DataFrame, by: str, step: float = 1e-4) -> DataFrame:
    """rows with r, the rank by falling return inside a group of any size: returns are cut into bins of `step`, the window over
    a group sees its bins, that over rows one bin, so no task holds a whole group."""
    rows = rows.withColumn("__bin", F.floor(F.col("ret") / step))
    bins = rows.groupBy(by, "__bin").agg(F.count("*").alias("__n"))
    above = F.sum("__n").over(Window.partitionBy(by).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(by, "__bin", F.coalesce(above, F.lit(0)).alias("__above"))
    place = F.row_number().over(Window.partitionBy(by, "__bin").orderBy(F.desc("ret"), "symbol", "dt"))
    return rows.join(bins, [by, "__bin"]).withColumn("r", F.col("__above") + place).drop("__bin", "__above")


def concentration(rows: DataFrame, by: str = "horizon") -> DataFrame:
    """How much of the profit a symbol or the best trades made; ranks are inside a group of the report."""
    act = stored(rows.where(ACTIVE).select(by, "symbol", "dt", "ret"), "active")  # read four times
    symbols = act.groupBy(by, "symbol").agg(F.greatest(F.sum("ret"), F.lit(0.0)).alias("profit"))
    share = symbols.groupBy(by).agg(ratio(F.max("profit"), F.sum("profit")).alias("top_symbol_profit_share"))
    totals = act.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("wins"))  # a row for each group
    placed = ranked(act, by).join(F.broadcast(totals), by)
    top = F.greatest(F.lit(1), F.ceil(F.col("wins") * 0.01))
    out = [ratio(F.sum(F.when((F.col("ret") > 0) & (F.col("r") <= top), F.col("ret"))), F.sum(F.when(F.col("ret") > 0, F.col("ret")))).alias("top_1pct_trade_profit_share")]
    for pct in (1, 5, 10):
        out.append(F.avg(F.when(F.col("r") > F.greatest(F.lit(1), F.ceil(F.col("n") * (pct / 100))), F.col("ret"))).alias(f"return_without_best_{pct}pct"))
    return placed.groupBy(by).agg(*out).join(share, by)


def timeline(rows: DataFrame, by: str = "horizon") -> DataFrame:
    """Daily path: each trade's return spread over its inclusive calendar days, averaged over open positions, gaps 0."""
    act = rows.where(ACTIVE)
    exit_ = F.greatest("entry_dt", "exit_dt")
    pieces = act.select(by, (F.col("ret") / (F.datediff(exit_, "entry_dt") + 1)).alias("piece"), "entry_dt", F.explode(F.sequence("entry_dt", exit_)).alias("dt"))
    days = pieces.groupBy(by, "dt").agg(F.avg("piece").alias("daily"), F.count("*").alias("active"), F.count_if(F.col("dt") == F.col("entry_dt")).alias("entries"))
    span = days.groupBy(by).agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    calendar = span.select(by, F.explode(F.sequence("a", "b")).alias("dt"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("active", "entries")]
    return calendar.join(days, [by, "dt"], "left").select(by, "dt", F.coalesce("daily", F.lit(0.0)).alias("daily"), *zero)


def timeline_risk(days: DataFrame, by: str = "horizon") -> DataFrame:
    w = Window.partitionBy(by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("wealth", F.exp(F.sum(F.log1p("daily")).over(w)))
    rows = rows.withColumn("dd", F.col("wealth") / F.max("wealth").over(w) - 1)
    root = 252**0.5
    return rows.groupBy(by).agg(
        (ratio(F.avg("daily"), F.stddev_samp("daily")) * root).alias("sharpe"),
        (ratio(F.avg("daily"), F.stddev_samp(F.when(F.col("daily") < 0, F.col("daily")))) * root).alias("sortino"),
        F.min("dd").alias("max_drawdown"),
        F.avg((F.col("active") > 0).cast("double")).alias("exposure"),
        F.avg("active").alias("avg_concurrent"),
        (F.sum("entries") / F.count("*")).alias("turnover"),
    )


def non_overlapping(rows: DataFrame) -> DataFrame:
    """Greedy count per symbol and horizon of trades that start after the last one's end: a fold over the symbol's trades."""
    act = rows.where(ACTIVE).groupBy("horizon", "symbol").agg(F.sort_array(F.collect_list(F.struct("entry_dt", "exit_dt"))).alias("t"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("date").alias("last"))

    def step(s: Column, t: Column) -> Column:
        free = s["last"].isNull() | (t["entry_dt"] > s["last"])
        return F.struct(F.when(free, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(free, t["exit_dt"]).otherwise(s["last"]).alias("last"))

    return act.select("horizon", "symbol", F.aggregate("t", start, step)["n"].alias("n"))


def without_best(rows: DataFrame, most: int = 3, by: str = "horizon") -> DataFrame:
    act = stored(rows.where(ACTIVE).select(by, "symbol", "dt", "ret"), "active")  # read twice
    placed = ranked(act, by).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, most + 1)])))
    rows, x = stored(placed.where(F.col("r") > F.col("k")).select(by, "k", "ret"), "placed"), F.col("ret")
    report = rows.groupBy(by, "k").agg(F.count("*").alias("trades"), F.avg(x).alias("mean_return"), F.avg((x > 0).cast("double")).alias("hit_rate"), profit_factor(x).alias("profit_factor"))
    return with_median(report, rows, [by, "k"])


def fold_ranges(lengths: DataFrame, horizon: int, train: int = 252, test: int = 63, holdout: int = 126, most: int | None = 4) -> DataFrame:
    """Chronological folds of each series: lengths has symbol and n; purge gaps keep unknown labels out of training."""
    train, test = max(250, train), max(20, test)
    held = F.lit(holdout >= 20) & (F.col("n") - holdout >= train + horizon + 20)
    start = F.when(held, F.col("n") - holdout)
    end = F.when(held, F.greatest(F.lit(train + horizon), start - horizon)).otherwise(F.col("n"))
    rows = lengths.select("symbol", "n", start.alias("holdout_start"), end.alias("end"))
    first = train + horizon - 1
    rows = rows.withColumn("test_start", F.explode(F.when(F.col("end") > first, F.sequence(F.lit(first), F.col("end").cast("int") - 1, F.lit(test))).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumns({"train_end": F.col("test_start") - horizon + 1, "test_end": F.least(F.col("end"), F.col("test_start") + test)})
    rows = rows.where(F.expr("train_end >= 250 AND test_end - test_start >= 20"))
    w = Window.partitionBy("symbol")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("test_start")) - 1, "m": F.count("*").over(w)})
    if most:
        even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("m") - 1) / max(most - 1, 1)))
        rows = rows.where((F.col("m") <= most) | F.array_contains(even, F.col("i")))
    rows = rows.withColumn("fold", F.row_number().over(w.orderBy("test_start")))
    regular = rows.select("symbol", "fold", "train_end", "test_start", "test_end", F.lit("WALK_FORWARD").alias("fold_type"))
    counts = regular.groupBy("symbol").agg(F.count("*").alias("k"))
    last = lengths.select("symbol", F.col("n"), start.alias("test_start")).where("test_start IS NOT NULL").join(counts, "symbol", "left")
    last = last.select("symbol", (F.coalesce("k", F.lit(0)) + 1).alias("fold"), (F.col("test_start") - horizon + 1).alias("train_end"), "test_start", F.col("n").alias("test_end"), F.lit("HOLDOUT").alias("fold_type"))
    return regular.unionByName(last.where("train_end >= 250"))


#: The distribution function of a Poisson count of mean 1, up to 9.
POISSON = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(10)])


def bootstrap_mean(rows: DataFrame, samples: int, by: str = "horizon", least: int = 20) -> DataFrame:
    """Interval of the mean return by resampling, for groups of `least` rows or more.

    A resample of n rows by index is the sum of rows times how often each is drawn. Draws are Poisson(1) counts from a hash of row
    and sample, made in place: a task sends one (sum, count) for each group and sample, rows are never multiplied.
    """
    kind = rows.schema[by].dataType.simpleString()
    act = rows.where(ACTIVE).select(by, "ret", F.xxhash64("symbol", "dt", by).alias("h"))
    turns = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            kind_there = batch.schema.field(by).type
            keys, ret = np.array(batch.column(by).to_pylist()), batch.column("ret").to_numpy()
            h = batch.column("h").to_numpy().view(np.uint64)
            for key in np.unique(keys).tolist():
                for low in range(0, len(at := np.flatnonzero(keys == key)), 1000):
                    part = at[low : low + 1000]
                    x = h[part][:, None] + turns[None, :]
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    times = np.searchsorted(POISSON, (x >> np.uint64(11)) / float(1 << 53))
                    held = totals.setdefault(key, np.zeros((2, samples)))
                    held += np.stack((ret[part] @ times, times.sum(0)))
        for key, (sums, counts) in totals.items():
            columns = [pa.array([key] * samples, kind_there), pa.array(np.arange(samples), pa.int32()), pa.array(sums), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "b", "s", "n"])

    means = act.mapInArrow(run, f"{by} {kind}, b int, s double, n double").groupBy(by, "b").agg(ratio(F.sum("s"), F.sum("n")).alias("m"))
    enough = act.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(by)
    out = means.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return out.join(enough, by, "left_semi")


def block_bootstrap(rows: DataFrame, block: Column, samples: int, by: str = "horizon") -> DataFrame:
    """As many blocks as there are, drawn with replacement; blocks are summed first, so rows aren't multiplied."""
    blocks = rows.where(ACTIVE).withColumn("block", block).groupBy(by, "block").agg(F.sum("ret").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(by)
    blocks = blocks.withColumns({"i": F.row_number().over(w.orderBy("block")) - 1, "m": F.count("*").over(w)})
    draws = blocks.select(by, "m", "i").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    draws = draws.select(by, "b", F.pmod(F.xxhash64(by, "b", "i"), F.col("m")).alias("i"))
    means = draws.join(blocks.select(by, F.col("i").cast("long").alias("i"), "s", "n"), [by, "i"]).groupBy(by, "b").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return means.groupBy(by).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def fingerprint(bars: DataFrame) -> DataFrame:
    """Order-free fingerprint of each symbol's rows."""
    h = F.xxhash64("symbol", "dt", "open", "high", "low", "close", "volume")
    return bars.groupBy("symbol").agg(F.bit_xor(h).alias("fingerprint"), F.sum(F.pmod(h, F.lit(1 << 20))).alias("checksum"), F.count("*").alias("n_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
