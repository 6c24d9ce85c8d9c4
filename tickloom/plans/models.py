"""Queries over forecast jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import r6 as R
from tickloom.operators import features as X
from tickloom.operators import labels as L
from tickloom.operators import models as M
from tickloom.operators import validation as V
from tickloom.operators import walkforward as WF
from tickloom.plans import radar as _radar  # noqa: F401  its common table expressions are used below
from tickloom.plans.registry import query
from tickloom.plans.sqltext import cte, r6, sql
from tickloom.plans.validation import records
from tickloom.sources import bars as B
from tickloom.sources.storage import stored


def frame(spark, sf, horizons=(1, 5, 20)):
    return labelled(B.brand_bars(spark, sf), horizons).where("y IS NOT NULL AND ma_dist_50 IS NOT NULL")


def labelled(bars, horizons=(1, 5, 20)):
    """Features and labels of all rows by horizon; labels that aren't known yet are null."""
    b = X.base(bars)
    for step in (lambda d: X.returns(d, (5, 20)), lambda d: X.volatility(d, (20,)), lambda d: X.average_distances(d, (50,)), X.drawdowns, lambda d: X.range_positions(d, (60,))):
        b = step(b)
    out = None
    for h in horizons:
        part = L.forward_return(b, h).select("symbol", "dt", *M.FEATURES, "forward_return", (F.col("forward_return") > 0).cast("int").alias("y"), F.lit(h).alias("horizon"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def m02_m03_m06_linear_members(spark, sf):
    return M.linear_members(frame(spark, sf))


@query()
def m10_platt(spark, sf):
    rows = M.linear_members(frame(spark, sf)).select("symbol", "horizon", "role", F.col("p_linear").alias("p"), "y")
    return M.platt(rows, ["symbol", "horizon"])


def panel(spark, sf, horizons=(1, 5, 20)):
    """All features of all rows by horizon, with `train`: whether the label is known before the day that 78 % of the rows precede."""
    bars = stored(B.brand_bars(spark, sf), "bars")
    names = X.feature_names() + X.context_names()
    frame = stored(X.feature_frame(bars, B.benchmark_of).select("symbol", "dt", *names), "features")
    done = L.executions(bars, list(horizons)).where("forward_return IS NOT NULL").select("symbol", "dt", "horizon", "forward_return")
    known = L.known_at(bars, max(horizons)).select("symbol", "dt", "label_dt")
    rows = frame.join(done, ["symbol", "dt"]).join(known, ["symbol", "dt"]).where("label_dt IS NOT NULL")
    cut = rows.agg(F.date_from_unix_date(F.percentile_approx(F.unix_date("dt"), 0.78).cast("int")).alias("cut"))  # one row
    ahead = F.date_add("dt", F.col("horizon") * 2)
    return rows.crossJoin(F.broadcast(cut)).select("symbol", "horizon", "dt", "forward_return", (F.col("forward_return") > 0).cast("int").alias("y"), (ahead < F.col("cut")).alias("train"), *names).where("train OR dt >= cut"), names


#: What the registered queries grow, so that small tables take a minute or two; the operators' own defaults are 180, 160 and 120 trees.
FEW = {"extra": (12, 12), "forest": 12, "rounds": 4}


@query()
def m04_m05_pooled_trees(spark, sf):
    """Predictions of extra-trees, boosting and forest, classifiers and regressors, for all horizons, on all features."""
    rows, names = panel(spark, sf)
    return M.pooled_members(rows, names, (1, 5, 20), **FEW)


@query()
def m08_member_weights(spark, sf):
    """Weights of the real regressors, ridge, forest, boosting and extra-trees, by their errors on the rows past the cut."""
    rows, names = panel(spark, sf)
    rows = stored(rows, "panel")
    pooled = M.pooled_members(rows, names, (1, 5, 20), **FEW)
    ridge = M.pooled_ridge(rows, names)
    all_ = pooled.join(ridge, ["symbol", "horizon", "dt"])
    each = F.array(*[F.struct(F.lit(k).alias("member"), F.col(f"r_{k}").alias("m")) for k in M.REGRESSOR_WEIGHTS])
    weights = M.mae_weights(all_.select("horizon", F.col("forward_return").alias("r"), F.inline(each)), ["horizon"])
    return weights.select("horizon", "member", R("mae").alias("mae"), R("weight").alias("weight"))


@query()
def w17_importances(spark, sf):
    rows, names = panel(spark, sf)
    return M.importances(rows.where("train"), names, trees=24)


MEMBERS = {"linear": "linear_probability", "factor": "probability_up", "coin": "0.5e0"}


def members(spark, sf):
    """Member predictions of records: what the weights are made of."""
    f = V.factor_forecast(B.brand_bars(spark, sf)).select("symbol", "dt", "horizon", "linear_probability")
    rows = records(spark, sf).select("symbol", "dt", "horizon", "probability_up", F.col("actual_up").alias("y"), "expected_return", F.col("buy_hold_return").alias("r")).join(f, ["symbol", "dt", "horizon"])
    each = F.array(*[F.struct(F.lit(k).alias("member"), F.expr(v).alias("p")) for k, v in MEMBERS.items()])
    return rows.select("symbol", "dt", "horizon", "y", "r", "expected_return", F.inline(each))


cte("memb", "SELECT symbol, horizon, dt, actual_up AS y, buy_hold_return AS r, unnest(['linear', 'factor', 'coin']) AS member, unnest([lp, r.probability_up, 0.5::DOUBLE]) AS p FROM records r JOIN (SELECT symbol, dt, horizon, lp FROM fcast) USING (symbol, dt, horizon)", "records", "fcast")
cte(
    "bweights",
    """SELECT horizon, member, brier, CASE WHEN min(n) OVER (PARTITION BY horizon) < 50 THEN CASE member WHEN 'linear' THEN 0.45::DOUBLE WHEN 'factor' THEN 0.35::DOUBLE ELSE 0.2::DOUBLE END ELSE w / sum(w) OVER (PARTITION BY horizon) END AS weight FROM (SELECT *, 0.08 + 0.92 * raw / sum(raw) OVER (PARTITION BY horizon) AS w FROM (SELECT *, exp(-(brier - min(brier) OVER (PARTITION BY horizon)) / 0.012) AS raw
    FROM (SELECT horizon, member, avg(power(y - p, 2)) AS brier, count(*) AS n FROM memb GROUP BY ALL)))""",
    "memb",
)


@query(sql(f"SELECT horizon, member, {r6('brier', 'brier')}, {r6('weight', 'weight')} FROM bweights", "bweights"))
def m07_brier_weights(spark, sf):
    return M.brier_weights(members(spark, sf), ["horizon"]).select("horizon", "member", R("brier").alias("brier"), R("weight").alias("weight"))


@query(
    sql(
        f"""SELECT horizon, member, {r6('mae', 'mae')}, {r6('w / sum(w) OVER (PARTITION BY horizon)', 'weight')} FROM (SELECT *, 0.06 + 0.94 * raw / sum(raw) OVER (PARTITION BY horizon) AS w FROM (SELECT *, exp(-(mae - min(mae) OVER (PARTITION BY horizon)) / scale) AS raw
    FROM (SELECT horizon, member, avg(abs(r - (p - 0.5) * 0.2)) AS mae, greatest(0.0025, 0.2 * stddev_samp(r)) AS scale FROM memb GROUP BY ALL)))""",
        "memb",
    )
)
def m08_mae_weights(spark, sf):
    rows = members(spark, sf).withColumn("m", (F.col("p") - 0.5) * 0.2)
    return M.mae_weights(rows, ["horizon"]).select("horizon", "member", R("mae").alias("mae"), R("weight").alias("weight"))


@query(sql(f"SELECT symbol, dt, horizon, {r6('sum(weight * p) / sum(weight)', 'p')} FROM memb JOIN bweights USING (horizon, member) GROUP BY symbol, dt, horizon", "memb", "bweights"))
def m09_blend(spark, sf):
    rows = members(spark, sf)
    out = M.blend(rows, M.brier_weights(rows, ["horizon"]), ["horizon"], ["symbol", "dt"])
    return out.select("symbol", "dt", "horizon", R("p").alias("p"))


SKILL = "least(greatest((auc - 0.5) / 0.12, 0), 1) * least(greatest((0.265 - brier) / 0.055, 0), 1) * (0.65 + 0.35 * least(greatest((auc - 0.5) / 0.12, 0), 1))"


@query(sql(f"SELECT symbol, horizon, {r6(SKILL, 'skill')}, CASE WHEN auc >= 0.6 AND brier <= 0.24 THEN 'HIGH' WHEN auc >= 0.55 AND brier <= 0.26 THEN 'MODERATE' ELSE 'LOW' END AS quality FROM ml", "ml"))
def m11_skill(spark, sf):
    from tickloom.plans.radar import ml

    return M.skill(ml(spark, sf).drop("quality").withColumn("oof_auc", F.col("auc"))).select("symbol", "horizon", R("skill").alias("skill"), "quality")


SHRUNK = f"(SELECT *, {SKILL} AS skill FROM ml)"


@query(
    sql(
        f"""SELECT symbol, horizon, {r6('least(greatest(0.5 + (probability_up - 0.5) * skill, 0.02), 0.98)', 'probability_up')}, {r6('expected_return * skill', 'expected_return')},
    {r6('expected_return * skill - 1.645 * annual_volatility', 'lower_return')}, {r6('expected_return * skill + 1.645 * annual_volatility', 'upper_return')} FROM {SHRUNK}""",
        "ml",
    )
)
def m12_predict(spark, sf):
    from tickloom.plans.radar import ml

    rows = M.skill(ml(spark, sf).withColumn("oof_auc", F.col("auc")))
    none = F.lit(None).cast("double")
    rows = rows.select("symbol", "horizon", "skill", F.col("probability_up").alias("p"), F.col("expected_return").alias("m"), F.col("annual_volatility").alias("sigma"), none.alias("q05"), none.alias("q95"))
    return M.shrink(rows).select("symbol", "horizon", *[R(c).alias(c) for c in ("probability_up", "expected_return", "lower_return", "upper_return")])


SPLIT = "least(greatest(200, CAST(floor(0.78::DOUBLE * n) AS BIGINT)), n - 60)"


@query(
    sql(
        f"""SELECT symbol, n, horizon, CASE WHEN n >= 250 THEN greatest(100, s - horizon) END AS train_end, CASE WHEN n >= 250 AND n - s >= least_size THEN s END AS calibration_start,
    CASE WHEN n >= 250 AND n - s >= least_size THEN s + (n - s) // 2 END AS calibration_end, CASE WHEN n >= 250 THEN CASE WHEN n - s >= least_size THEN least(s + (n - s) // 2 + horizon, n - 30) ELSE s END END AS assessment_start
    FROM (SELECT symbol, n, horizon, {SPLIT} AS s, greatest(120, 4 * horizon + 40) AS least_size FROM lengths, hs)""",
        "lengths",
        "hs",
    )
)
def m01_chronological_split(spark, sf):
    lengths = B.brand_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    out = None
    for h in V.HORIZONS:
        part = lengths.withColumns({"horizon": F.lit(h), **M.role_columns(F.col("n"), h)})
        out = part if out is None else out.unionByName(part)
    return out


def fitted(bars):
    """Fitted forecasts of each symbol and horizon, drawn to the middle by their skill."""
    rows = M.shrink(M.skill(M.fitted_forecasts(labelled(bars))))
    return rows.select("symbol", "horizon", "probability_up", "expected_return", "lower_return", "upper_return", "auc", "brier", "quality")


@query()
def m16_fitted_scan(spark, sf):
    """Model rows of all symbols from forecasts fitted on their own history."""
    from tickloom.operators import radar as RD

    bars = B.brand_bars(spark, sf)
    rows = RD.model_scan(bars, fitted(bars))
    return rows.select("symbol", "horizon", "quality", "decision_reason", *[R(c).alias(c) for c in ("probability_up", "expected_return", "lower_return", "upper_return", "auc", "brier", "deep_score")])


@query()
def m18_two_stage_radar(spark, sf):
    """Fast rows of all symbols; of these the shortlist, whose bars alone are modelled; merged."""
    from tickloom.operators import radar as RD

    bars = B.brand_bars(spark, sf)
    fast = stored(RD.fast_scan(bars), "fast")
    chosen = stored(RD.shortlist(fast, 12).select("symbol"), "shortlist")  # read by each part of the second stage
    few = bars.join(F.broadcast(chosen), "symbol", "left_semi")
    return RD.prefer_ml(fast, RD.model_scan(few, fitted(few))).select("symbol", "horizon", "mode", R("deep_score").alias("deep_score"))


def refitted(spark, sf, horizons=(1, 5, 20)):
    """All features and labels, and the records of forecasts that are fitted anew every sixty rows."""
    bars = stored(B.brand_bars(spark, sf), "bars")
    names = X.feature_names() + [c for c in X.context_names()]
    frame = X.feature_frame(bars, B.benchmark_of)
    # what has no benchmark has no context: it is modelled by its own features
    frame = frame.withColumns({c: F.when(B.benchmark_of(F.col("symbol")).isNull() | (F.col("symbol") == B.benchmark_of(F.col("symbol"))), F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in X.context_names()})
    rows = stored(WF.labelled(bars, frame, names, horizons), "labelled")
    return WF.records(rows, WF.forecasts(rows, names))


@query()
def m13_refitted_walk_forward(spark, sf):
    """Every decision point of a walk-forward test with refits on all features, no cut at any symbol or horizon."""
    return refitted(spark, sf).drop("fold")


@query()
def a02_refitted_report(spark, sf):
    """The report by market, symbol, horizon and refit of the refitted forecasts."""
    from tickloom.plans.validation import KEYS, SETS, rounded

    return rounded(V.group_report(refitted(spark, sf), SETS, KEYS), [*KEYS, "level", "observations", "trades", "rejected"])
