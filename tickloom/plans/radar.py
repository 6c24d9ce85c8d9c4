"""Queries over radar rows: gates, labels, scorecards, rankings, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.functions.columns import r6 as R
from tickloom.operators import radar as X
from tickloom.operators.contract import coverage_contract
from tickloom.plans import prices as _prices  # noqa: F401  its common table expressions are used below
from tickloom.plans.registry import query
from tickloom.plans.sqltext import cte, r6, sql
from tickloom.sources import bars as B
from tickloom.sources.storage import stored

cte("states", "SELECT t.*, r.* EXCLUDE (symbol), horizon FROM tech t JOIN risk r USING (symbol), (SELECT unnest([1, 5, 20]) AS horizon)", "tech", "risk")
cte("fast", f"SELECT * FROM {rules.as_sql('states', rules.FAST)}", "states")
cte("ml", f"SELECT * FROM {rules.as_sql('states', rules.ML)}", "states")

NUMERIC = set(
    "return_1d return_5d return_20d return_60d rsi_14 atr_pct expected_return probability_up lower_return upper_return auc brier risk_reward edge_score momentum_score trend_score risk_control "
    "liquidity_score ml_score setup_score deep_score radar_score score confidence priority annual_volatility max_drawdown horizon_risk rr_score".split()
)
KEY = ["symbol", "horizon"]


def take(df, names):
    return df.select(*[R(n).alias(n) if n in NUMERIC else F.col(n) for n in names])


def took(names):
    return ", ".join(r6(n, n) if n in NUMERIC else n for n in names)


def fast(spark, sf):
    return X.fast_scan(B.brand_bars(spark, sf))


def ml(spark, sf):
    return X.ml_scan(B.brand_bars(spark, sf))


def view(name, source, names, where=""):
    """Registers a projection of a scan, with an optional filter that both engines read alike."""

    def run(spark, sf):
        rows = fast(spark, sf) if source == "fast" else ml(spark, sf)
        return take(rows.where(where) if where else rows, [*KEY, *names])

    run.__name__ = name
    query(sql(f"SELECT {took([*KEY, *names])} FROM {source}" + (f" WHERE {where}" if where else ""), source))(run)


FAST_COLUMNS = (
    "dt close asset_class setup radar_momentum radar_score risk_reward edge_score fast_action mode deep_score setup_score setup_grade momentum_score trend_score risk_control liquidity_score "
    "ml_score thesis probability_up expected_return lower_return upper_return return_1d return_5d return_20d rsi_14 auc brier quality annual_volatility max_drawdown"
).split()
view("m17_fast_scan", "fast", FAST_COLUMNS)
view("m16_ml_rows", "ml", [*[c for c in FAST_COLUMNS if c != "fast_action"], "score", "confidence", "signal_label", "observation", "decision", "decision_reason"])
view("p02_fail_closed_gate", "ml", ["input_issue", "decision", "decision_reason", "decision_label"])
view("p03_decision_state", "ml", ["mode", "decision", "decision_reason", "decision_state"])
view("p04_rankable_rows", "ml", ["deep_score", "mode"], "error_code IS NULL")
view("p05_signal_label", "ml", ["probability_up", "quality", "signal_label"])
view("p06_observation_label", "ml", ["decision", "observation"])
view("p07_momentum_label", "fast", ["return_1d", "return_5d", "return_20d", "radar_momentum"])
view("p08_setup_label", "fast", ["rsi_14", "setup"])
view("p09_asset_class", "fast", ["asset_class"])
view("p10_calendar_kind", "fast", ["calendar_kind"])
view("p12_candidate_filter", "ml", ["probability_up", "expected_return", "decision_reason"], "horizon = 20 AND mode = 'ML' AND quality IN ('HIGH', 'MODERATE') AND decision_reason = 'LONG_CONFIRMED' AND probability_up >= 0.56e0 AND expected_return >= 0")
view("p15_confirmed_and_risk", "ml", ["is_confirmed", "is_risk"], "is_confirmed OR is_risk")
view("p16_guidance", "ml", ["radar_action", "setup_grade", "is_risk", "is_confirmed", "is_watch"])
view("p17_risk_notes", "ml", ["risk_notes"])
view("p18_display", "ml", ["dt", "probability_up", "expected_return", "quality", "decision_label"], "probability_up BETWEEN 0 AND 1")
view("p19_trend_points", "ml", ["trend_points", "trend_state"])
view("c01_radar_score", "fast", ["radar_score"])
view("c02_risk_reward", "ml", ["risk_reward", "edge_score", "radar_action"])
view("c03_setup_intelligence", "ml", ["momentum_score", "trend_score", "risk_control", "liquidity_score", "ml_score", "rr_score", "setup_score", "setup_grade", "thesis"])
view("c04_fast_forecast", "fast", ["horizon_risk", "expected_return", "probability_up", "lower_return", "upper_return"])
view("c05_fast_action", "fast", ["fast_action"])
view("c06_ml_score", "ml", ["score", "confidence", "deep_score"])
view("c07_fast_deep_score", "fast", ["deep_score"])
view("c08_priority", "fast", ["priority"])


@query(sql(f"SELECT symbol, horizon, decision, decision_reason, decision_label FROM {rules.as_sql(rules.as_sql('states', [*rules.COMMON, *rules.FACTOR_FORECAST]), rules.gate(0.56, 0.01))}", "states"))
def p01_directional_gate(spark, sf):
    rows = X.pairs(X.states(B.brand_bars(spark, sf)))
    return rules.apply(rows, [*rules.COMMON, *rules.FACTOR_FORECAST, *rules.gate(0.56, 0.01)]).select(*KEY, "decision", "decision_reason", "decision_label")


#: Broken inputs by symbol, so that every kind of refusal occurs.
BROKEN = [
    {
        "probability_up": "CASE WHEN symbol LIKE '%1.WA' THEN 1.2e0 WHEN symbol LIKE '%2.DE' THEN cast('NaN' AS double) ELSE 0.5e0 + return_60d END",
        "expected_return": "CASE WHEN symbol LIKE '^%' THEN cast('Infinity' AS double) WHEN symbol LIKE '%-USD' THEN NULL ELSE return_5d END",
        "quality": "'HIGH'",
        "mode": "'ML'",
    },
    *rules.closed_gate(),
    *rules.STATE,
]


@query(sql(f"SELECT symbol, max(error_code) AS error_code FROM {rules.as_sql('states', BROKEN)} WHERE error_code IS NOT NULL GROUP BY symbol", "states"))
def p04_radar_errors(spark, sf):
    rows = rules.apply(X.pairs(X.states(B.brand_bars(spark, sf))), BROKEN)
    return rows.where("error_code IS NOT NULL").groupBy("symbol").agg(F.max_by("error_code", "horizon").alias("error_code"))


@query(sql(f"SELECT symbol, horizon, decision, decision_reason AS explicit_reason FROM {rules.as_sql('states', BROKEN)}", "states"))
def p23_explicit_reason(spark, sf):
    return rules.apply(X.pairs(X.states(B.brand_bars(spark, sf))), BROKEN).select(*KEY, "decision", F.col("decision_reason").alias("explicit_reason"))


FALLBACK = "coalesce(nullif(trim(given), ''), nullif(trim(kind), ''), CASE WHEN symbol LIKE '%-USD' THEN 'CRYPTO' END, 'MARKET')"
GIVEN = "CASE WHEN horizon = 1 THEN '  ' WHEN symbol LIKE '^%' THEN NULL ELSE asset_class END"


@query(sql(f"SELECT symbol, horizon, {FALLBACK} AS asset_class FROM (SELECT *, {GIVEN} AS given, CASE WHEN symbol LIKE '%.WA' THEN 'GPW ' END AS kind FROM fast)", "fast"))
def p11_class_fallback(spark, sf):
    rows = fast(spark, sf).withColumns({"given": F.expr(GIVEN), "kind": F.when(F.col("symbol").endswith(".WA"), "GPW ")})
    out = F.coalesce(F.nullif(F.trim("given"), F.lit("")), F.nullif(F.trim("kind"), F.lit("")), F.when(F.col("symbol").endswith("-USD"), "CRYPTO"), F.lit("MARKET"))
    return rows.select(*KEY, out.alias("asset_class"))


@query(sql(f"SELECT symbol, horizon, {r6('coalesce(deep_score, setup_score * 0.72, 0)', 'deep_score')}, {r6('coalesce(edge_score, 0)', 'edge_score')}, 'NONE' AS risk_notes FROM fast", "fast"))
def p14_conform(spark, sf):
    """A frame of an older shape gets what it lacks."""
    from tickloom.sources.shapes import conform

    old = fast(spark, sf).select(*KEY, "setup_score", F.col("deep_score"), "edge_score")
    full = conform(old, {"deep_score": F.col("setup_score") * 0.72, "edge_score": F.lit(0.0), "risk_notes": F.lit("NONE")})
    return take(full, [*KEY, "deep_score", "edge_score", "risk_notes"])


ERRORS = "CASE WHEN lower(message) SIMILAR TO '.*(no data|delisted|possibly).*' THEN CASE WHEN symbol LIKE '%-USD' THEN 'CRYPTO_NO_DATA' ELSE 'PROVIDER_NO_DATA' END ELSE 'FAILED' END"
MESSAGE = "CASE horizon WHEN 1 THEN 'No data found' WHEN 5 THEN 'symbol possibly DELISTED' ELSE 'timeout' END"


@query(sql(f"SELECT symbol, horizon, {ERRORS} AS error_class FROM (SELECT *, {MESSAGE} AS message FROM fast)", "fast"))
def p20_error_class(spark, sf):
    rows = fast(spark, sf).withColumn("message", F.expr(MESSAGE))
    silent = F.lower("message").rlike("no data|delisted|possibly")
    kind = F.when(silent & F.col("symbol").endswith("-USD"), "CRYPTO_NO_DATA").when(silent, "PROVIDER_NO_DATA").otherwise("FAILED")
    return rows.select(*KEY, kind.alias("error_class"))


@query(sql(f"SELECT symbol, horizon, {r6('deep_score', 'deep_score')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY deep_score DESC, setup_score DESC, edge_score DESC, radar_score DESC, risk_control DESC, horizon) AS r FROM ml) WHERE r = 1", "ml"))
def c09_row_leader(spark, sf):
    keys = F.struct("deep_score", "setup_score", "edge_score", "radar_score", "risk_control", (-F.col("horizon")).alias("h"))
    best = ml(spark, sf).groupBy("symbol").agg(F.max_by(F.struct("horizon", "deep_score"), keys).alias("b"))
    return take(best.select("symbol", "b.*"), [*KEY, "deep_score"])


@query(
    sql(
        """SELECT symbol, horizon, decision, quality FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY input_issue IS NULL DESC, CASE WHEN decision <> 0 THEN 1 ELSE 0 END DESC,
    CASE quality WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END DESC, abs(probability_up - 0.5) DESC, abs(expected_return) DESC, CASE horizon WHEN 20 THEN 0 WHEN 5 THEN 1 WHEN 60 THEN 2 ELSE 3 END) AS r FROM ml) WHERE r = 1""",
        "ml",
    )
)
def c10_primary_horizon(spark, sf):
    return X.primary_horizon(ml(spark, sf)).select(*KEY, "decision", "quality")


@query(sql(f"SELECT symbol, horizon, {r6('deep_score', 'deep_score')}, row_number() OVER (PARTITION BY horizon ORDER BY deep_score DESC, symbol) AS position FROM fast", "fast"))
def w07_ranking(spark, sf):
    return take(X.ranking(fast(spark, sf)), [*KEY, "deep_score", "position"])


SHORT = """SELECT symbol, asset_class, priority, seed FROM (SELECT *, __i <= seed_n AS seed FROM (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY priority DESC, symbol) AS __i,
 max(priority) OVER (PARTITION BY asset_class) AS class_top, (SELECT greatest(1, least(4, 12 // count(DISTINCT asset_class))) FROM fast) AS seed_n FROM
 (SELECT symbol, asset_class, priority, row_number() OVER (PARTITION BY symbol ORDER BY priority DESC, horizon) AS r FROM fast) WHERE r = 1))
 ORDER BY seed DESC, CASE WHEN seed THEN class_top END DESC NULLS LAST, CASE WHEN seed THEN asset_class END, priority DESC, symbol LIMIT 12"""


@query(sql(f"SELECT symbol, asset_class, seed, {r6('priority', 'priority')} FROM ({SHORT})", "fast"))
def w08_shortlist(spark, sf):
    return take(X.shortlist(fast(spark, sf), 12), ["symbol", "asset_class", "seed", "priority"])


@query(
    sql(
        f"""SELECT symbol, horizon, {r6('greatest(abs(return_1d), abs(return_5d), abs(return_20d))', 'move')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY greatest(abs(return_1d), abs(return_5d), abs(return_20d)) DESC, horizon) AS r FROM fast)
    WHERE r = 1 ORDER BY greatest(abs(return_1d), abs(return_5d), abs(return_20d)) DESC, symbol LIMIT 5""",
        "fast",
    )
)
def w09_hot_movers(spark, sf):
    rows = fast(spark, sf).withColumn("move", F.greatest(F.abs("return_1d"), F.abs("return_5d"), F.abs("return_20d")))
    return X.leaders(rows, 5, F.desc("move")).select(*KEY, R("move").alias("move"))


@query(sql(f"SELECT symbol, horizon, {r6('setup_score', 'setup_score')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY setup_score DESC, horizon) AS r FROM ml) WHERE r = 1 ORDER BY setup_score DESC, symbol LIMIT 20", "ml"))
def w09_setup_leaders(spark, sf):
    return take(X.leaders(ml(spark, sf), 20, F.desc("setup_score")), [*KEY, "setup_score"])


#: Snapshots of the scan: sound ones, and one with each kind of fault; in SQL as what differs from a sound snapshot.
CASES = ["complete", "partial", "failed", "status", "schema", "total", "stranger", "unlisted", "twice", "lost", "mode", "horizon"]
cte("cases", "SELECT unnest([" + ", ".join(f"'{c}'" for c in CASES) + "]) AS snapshot_id")
cte("universe", "SELECT DISTINCT symbol FROM fast", "fast")
cte("short", "SELECT symbol FROM universe WHERE symbol LIKE '%-USD'", "universe")
cte("gone", "SELECT symbol, horizon FROM (SELECT symbol FROM universe WHERE symbol LIKE '%.WA'), (SELECT 20 AS horizon)", "universe")


@query(
    sql(
        """SELECT snapshot_id, CASE snapshot_id WHEN 'complete' THEN 'COMPLETE' WHEN 'partial' THEN CASE WHEN (SELECT count(*) FROM gone) > 0 THEN 'PARTIAL' ELSE 'INVALID' END WHEN 'failed' THEN 'PARTIAL'
    WHEN 'unlisted' THEN CASE WHEN (SELECT count(*) FROM gone) > 0 THEN 'INVALID' ELSE 'COMPLETE' END WHEN 'mode' THEN CASE WHEN (SELECT count(*) FROM short) > 0 THEN 'INVALID' ELSE 'COMPLETE' END ELSE 'INVALID' END AS state FROM cases""",
        "cases",
        "gone",
        "short",
    )
)
def o02_coverage_contract(spark, sf):
    """The contract on snapshots of the scan that are complete, partial, or broken in one way each."""
    rows = stored(fast(spark, sf).select("symbol", "horizon"), "scan")
    cases = spark.createDataFrame([(c,) for c in CASES], "snapshot_id string")
    of = lambda df: cases.crossJoin(df)  # noqa: E731  a dozen cases of one scan
    universe = rows.select("symbol").distinct()
    symbols, short = of(universe), of(universe.where("symbol LIKE '%-USD'"))
    horizons = of(spark.createDataFrame([(1,), (5,), (20,)], "horizon int"))
    own = horizons.where("NOT (snapshot_id = 'horizon' AND horizon = 20)")
    gone = F.col("symbol").endswith(".WA") & (F.col("horizon") == 20) & F.col("snapshot_id").isin("partial", "unlisted")
    fast_pairs, ml_pairs = symbols.join(horizons, "snapshot_id"), short.join(horizons, "snapshot_id")
    pairs = None
    for mode, df in (("fast", fast_pairs), ("ml", ml_pairs)):
        for kind, part in (("expected", df), ("successful", df.where(~gone)), ("missing", df.where(gone & (F.col("snapshot_id") != "unlisted")))):
            one = part.select("snapshot_id", F.lit(mode).alias("mode"), F.lit(kind).alias("kind"), "symbol", "horizon")
            pairs = one if pairs is None else pairs.unionByName(one)
    first = rows.agg(F.min("symbol").alias("symbol"))
    pairs = pairs.unionByName(first.select(F.lit("twice").alias("snapshot_id"), F.lit("fast").alias("mode"), F.lit("expected").alias("kind"), "symbol", F.lit(1).alias("horizon")))
    records = fast_pairs.where(~gone).join(ml_pairs.select("snapshot_id", "symbol", "horizon"), ["snapshot_id", "symbol", "horizon"], "left_anti").withColumn("mode", F.lit("FAST")).unionByName(ml_pairs.withColumn("mode", F.when(F.col("snapshot_id") == "mode", "GUESS").otherwise("ML")))
    lost = records.join(first.withColumnRenamed("symbol", "__first"), F.col("symbol") == F.col("__first"), "left").where("NOT (snapshot_id = 'lost' AND __first IS NOT NULL AND horizon = 5)").drop("__first")
    lost = lost.unionByName(spark.createDataFrame([("stranger", "nobody", 5, "FAST")], "snapshot_id string, symbol string, horizon int, mode string"))
    total = rows.agg(F.count_distinct("symbol").alias("n"))
    status = F.when(F.col("snapshot_id").isin("partial", "failed"), "partial").when(F.col("snapshot_id") == "status", "done").otherwise("complete")
    heads = cases.crossJoin(total).select("snapshot_id", F.when(F.col("snapshot_id") == "schema", 7).otherwise(8).alias("schema_version"), status.alias("coverage_status"), (F.col("n") + (F.col("snapshot_id") == "total").cast("int")).alias("universe_total"), F.when(F.col("snapshot_id") == "failed", 2).otherwise(0).alias("n_errors"))
    return coverage_contract(heads, symbols, horizons, own, short, pairs, lost)


#: The lists of the radar page; `order`: largest first.
VIEWS = {
    "priority": {"where": "radar_action IN ('PRIORITY', 'WATCHLIST')", "order": ["deep_score", "setup_score", "edge_score", "risk_reward"], "first": 5, "distinct": True},
    "movers": {"where": "radar_action NOT IN ('PRIORITY', 'WATCHLIST')", "order": ["greatest(abs(return_1d), abs(return_5d), abs(return_20d))", "radar_score", "deep_score"], "first": 5, "distinct": True},
    "risk": {"where": "is_risk", "order": ["-edge_score", "-score"], "first": 5, "distinct": True},
    "setups": {"order": ["deep_score", "setup_score", "edge_score", "radar_score"], "first": 25, "distinct": True},
    "momentum": {"where": "horizon = 1", "order": ["radar_score"], "first": 18},
    "reward": {"order": ["edge_score", "deep_score", "setup_score", "risk_reward"], "first": 20, "distinct": True},
    **{f"horizon_{h}": {"where": f"horizon = {h}", "order": ["score"], "first": 12, "prefer": "is_confirmed"} for h in (1, 5, 20)},
}


def view_sql(name, v):
    order = ", ".join([*[f"({o}) DESC NULLS LAST" for o in v["order"]], "symbol", "horizon"])
    rows = f"SELECT * FROM ml WHERE {v.get('where', 'true')}"
    if "prefer" in v:
        rows = f"SELECT * FROM ({rows}) WHERE {v['prefer']} OR NOT EXISTS (SELECT 1 FROM ml WHERE {v.get('where', 'true')} AND {v['prefer']})"
    if v.get("distinct"):
        rows = f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {order}) = 1"
    return f"SELECT '{name}' AS view, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, symbol, horizon FROM ({rows}) QUALIFY place <= {v['first']}"


@query(sql(" UNION ALL ".join(f"({view_sql(n, v)})" for n, v in VIEWS.items()), "ml"))
def w09_views(spark, sf):
    return X.top_views(ml(spark, sf), VIEWS).select("view", "place", *KEY)


POOL = "CASE WHEN is_confirmed THEN 0 WHEN radar_action IN ('PRIORITY', 'WATCHLIST') THEN 1 ELSE 2 END"


@query(sql(f"SELECT symbol, horizon, {POOL} AS pool FROM ml ORDER BY pool, deep_score DESC, setup_score DESC, edge_score DESC, radar_score DESC, risk_control DESC, symbol, horizon LIMIT 1", "ml"))
def w10_radar_leader(spark, sf):
    order = [F.col("pool"), *[F.desc(c) for c in ("deep_score", "setup_score", "edge_score", "radar_score", "risk_control")], "symbol", "horizon"]
    return ml(spark, sf).withColumn("pool", F.expr(POOL)).orderBy(*order).limit(1).select(*KEY, "pool")


view("w11_explore", "ml", ["asset_class", "deep_score"], "horizon = 20 AND asset_class IN ('CRYPTO', 'US', 'GPW') AND radar_momentum <> 'NONE'")

ASKED = "(SELECT symbol, horizon FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest([1, 5, 20, 60]) AS horizon))"


@query(sql(f"SELECT symbol, horizon FROM {ASKED}", "bars"))
def j17_requested_pairs(spark, sf):
    return X.pairs(B.brand_bars(spark, sf).select("symbol").distinct(), (1, 5, 20, 60)).select(*KEY)


@query(sql(f"SELECT a.symbol, a.horizon, CASE WHEN f.symbol IS NULL THEN 'MISSING' ELSE 'SUCCESSFUL' END AS state FROM {ASKED} a LEFT JOIN fast f USING (symbol, horizon)", "fast", "bars"))
def o01_coverage(spark, sf):
    bars = B.brand_bars(spark, sf)
    return X.coverage(X.pairs(bars.select("symbol").distinct(), (1, 5, 20, 60)), X.fast_scan(bars))


@query(sql(f"SELECT count(*) AS expected, count(f.symbol) AS successful, 'PARTIAL' AS status FROM {ASKED} a LEFT JOIN fast f USING (symbol, horizon)", "fast", "bars"))
def o02_coverage_contract(spark, sf):
    bars = B.brand_bars(spark, sf)
    return X.coverage_verdict(X.coverage(X.pairs(bars.select("symbol").distinct(), (1, 5, 20, 60)), X.fast_scan(bars)))


@query(sql(f"SELECT symbol, horizon, mode, {r6('deep_score', 'deep_score')} FROM (SELECT symbol, horizon, mode, deep_score FROM ml WHERE horizon = 20 UNION ALL SELECT symbol, horizon, mode, deep_score FROM fast WHERE horizon <> 20)", "fast", "ml"))
def j16_prefer_ml(spark, sf):
    return take(X.prefer_ml(fast(spark, sf), ml(spark, sf).where("horizon = 20")), [*KEY, "mode", "deep_score"])


@query(sql("SELECT DISTINCT symbol FROM fast WHERE greatest(abs(return_1d), abs(return_5d), abs(return_20d)) > 0.1 AND symbol NOT IN (SELECT symbol FROM ml WHERE radar_action = 'PRIORITY')", "fast", "ml"))
def j13_movers_not_priority(spark, sf):
    movers = fast(spark, sf).where(F.greatest(F.abs("return_1d"), F.abs("return_5d"), F.abs("return_20d")) > 0.1).select("symbol").distinct()
    return movers.join(ml(spark, sf).where("radar_action = 'PRIORITY'"), "symbol", "left_anti")


@query(sql("SELECT mode, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM (SELECT mode, symbol FROM fast UNION ALL SELECT mode, symbol FROM ml WHERE horizon = 20) GROUP BY mode", "fast", "ml"))
def a18_scan_contract(spark, sf):
    both = fast(spark, sf).select("mode", "symbol").unionByName(ml(spark, sf).where("horizon = 20").select("mode", "symbol"))
    return both.groupBy("mode").agg(F.count("*").alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"))


@query(sql(f"SELECT symbol, horizon, {r6('deep_score', 'deep_score')}, (SELECT count(*) || '/75' FROM fast) AS coverage FROM fast", "fast"))
def s09_radar_export(spark, sf):
    rows = fast(spark, sf)
    total = rows.groupBy().agg(F.concat(F.count("*").cast("string"), F.lit("/75")).alias("coverage"))  # one row
    return take(rows.crossJoin(F.broadcast(total)), [*KEY, "deep_score", "coverage"])
