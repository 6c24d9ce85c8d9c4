"""The radar: scans of all symbols and horizons, shortlist, merge, coverage, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.operators.features import risk_metrics, technical_snapshot

HORIZONS = (1, 5, 20)


def pairs(symbols: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Requested symbols by horizons: a fixed handful of rows for each symbol."""
    return symbols.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))


def states(bars: DataFrame) -> DataFrame:
    """One row per symbol: technical snapshot and risk."""
    return technical_snapshot(bars).join(risk_metrics(bars), "symbol")


def fast_scan(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    return rules.apply(pairs(states(bars), horizons), rules.FAST)


def ml_scan(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Rows with forecasts; the forecast columns come from rules.FACTOR_FORECAST or, fitted, from operators.models."""
    return rules.apply(pairs(states(bars), horizons), rules.ML)


def model_scan(bars: DataFrame, forecasts: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Rows of the pairs that a model gave a forecast; forecasts has symbol, horizon, probability_up, expected_return, lower_return, upper_return, auc, brier, quality."""
    rows = rules.apply(pairs(states(bars), horizons), rules.COMMON)
    given = forecasts.select("symbol", "horizon", "probability_up", "expected_return", "lower_return", "upper_return", "auc", "brier", "quality")
    return rules.apply(rows.join(given, ["symbol", "horizon"]).withColumn("mode", F.lit("ML")), rules.AFTER_FORECAST)


def ranking(rows: DataFrame, key: str = "deep_score") -> DataFrame:
    """position of each row inside its horizon."""
    w = Window.partitionBy("horizon").orderBy(F.desc(key), "symbol")
    return rows.withColumn("position", F.row_number().over(w))


def shortlist(rows: DataFrame, limit: int = 36) -> DataFrame:
    """symbol, place: a few of each class first, classes in order of their best, then the best of the rest.

    The windows see one row per symbol; ranks over all symbols are of a table of instruments, not of bars.
    """
    best = Window.partitionBy("symbol").orderBy(F.desc("priority"), "horizon")
    one = rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("symbol", "asset_class", "priority")
    classes = one.groupBy("asset_class").agg(F.max("priority").alias("class_top"))
    number = classes.agg(F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.lit(limit) / F.count("*")))).alias("__seeds"))  # one row
    inside = Window.partitionBy("asset_class").orderBy(F.desc("priority"), "symbol")
    ranked = one.join(classes, "asset_class").crossJoin(F.broadcast(number))
    ranked = ranked.withColumn("__i", F.row_number().over(inside))
    seeded = F.col("__i") <= F.col("__seeds")
    order = [seeded.desc(), F.when(seeded, F.col("class_top")).desc_nulls_last(), F.when(seeded, F.col("asset_class")), F.desc("priority"), "symbol"]
    top = ranked.withColumn("seed", seeded).orderBy(*order).limit(limit)
    return top.select("symbol", "asset_class", "priority", "seed")


def prefer_ml(fast: DataFrame, ml: DataFrame) -> DataFrame:
    """Each symbol and horizon once, the ML row where there is one."""
    columns = [c for c in fast.columns if c in ml.columns]
    both = fast.select(*columns).unionByName(ml.select(*columns))
    w = Window.partitionBy("symbol", "horizon").orderBy(F.when(F.col("mode") == "ML", 0).otherwise(1))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def coverage(expected: DataFrame, successful: DataFrame) -> DataFrame:
    """symbol, horizon, state of each expected pair; successes that nobody asked for are left out."""
    ok = successful.select("symbol", "horizon").distinct().withColumn("ok", F.lit(True))
    joined = expected.select("symbol", "horizon").distinct().join(ok, ["symbol", "horizon"], "left")
    return joined.select("symbol", "horizon", F.when(F.col("ok"), "SUCCESSFUL").otherwise("MISSING").alias("state"))


def coverage_verdict(covered: DataFrame) -> DataFrame:
    counts = covered.agg(F.count("*").alias("expected"), F.count_if(F.col("state") == "SUCCESSFUL").alias("successful"))
    return counts.withColumn("status", F.when(F.col("expected") == 0, "INVALID").when(F.col("successful") == F.col("expected"), "COMPLETE").otherwise("PARTIAL"))


def leaders(rows: DataFrame, k: int, *order) -> DataFrame:
    """The k best symbols, each with its best row."""
    best = Window.partitionBy("symbol").orderBy(*order, "horizon")
    one = rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    return one.orderBy(*order, "symbol").limit(k)


def primary_horizon(rows: DataFrame) -> DataFrame:
    """One row per symbol: complete, then by verdict, quality, distance from a coin toss, expected move, preferred horizon."""
    verdict = F.when(F.col("decision") != 0, 1).otherwise(0)
    quality = F.when(F.col("quality") == "HIGH", 2).when(F.col("quality") == "MODERATE", 1).otherwise(0)
    preferred = F.when(F.col("horizon") == 20, 0).when(F.col("horizon") == 5, 1).when(F.col("horizon") == 60, 2).otherwise(3)
    w = Window.partitionBy("symbol").orderBy(
        F.col("input_issue").isNull().desc(), verdict.desc(), quality.desc(), F.abs(F.col("probability_up") - 0.5).desc(), F.abs("expected_return").desc(), preferred
    )
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_views(rows: DataFrame, views: dict[str, dict]) -> DataFrame:
    """view, place and the columns of rows: several ranked lists in one pass over the rows.

    views: by name the rows' condition (`where`), numbers of which the largest are first (`order`), how many (`first`), whether a symbol stands once
    (`distinct`), and a condition that some rows are preferred for (`prefer`): where any row meets it, only such rows stay. Ties go to the first symbol
    and horizon. A row goes to the views that it is in as one short record for each; the best of each symbol and the first of each
    view are found inside tasks before anything is sent.
    """
    wide = max(len(v["order"]) for v in views.values())
    last = F.lit(float("-inf"))
    each = []
    for name, v in views.items():
        numbers = [*[F.coalesce(F.expr(o).cast("double"), last) for o in v["order"]], *[F.lit(0.0)] * (wide - len(v["order"]))]
        prefer = F.coalesce(F.expr(v["prefer"]).cast("int"), F.lit(0)) if "prefer" in v else F.lit(0)
        one = F.struct(F.lit(name).alias("view"), F.lit(v["first"]).alias("first"), F.lit(bool(v.get("distinct"))).alias("single"), prefer.alias("preferred"), F.array(*numbers).alias("order"))
        each.append(F.when(F.coalesce(F.expr(v.get("where", "true")), F.lit(False)), one))
    flat = rows.select(*rows.columns, F.explode(F.array_compact(F.array(*each))).alias("v")).select("v.*", *rows.columns)
    rank = [F.desc("preferred"), *[F.col("order")[i].desc() for i in range(wide)], F.col("symbol"), F.col("horizon")]
    own = F.when(F.col("single"), F.concat(F.lit("s"), F.col("symbol"))).otherwise(F.concat_ws("|", F.lit("r"), "symbol", F.col("horizon").cast("string")))
    best = flat.withColumn("__own", own).withColumn("__r", F.row_number().over(Window.partitionBy("view", "__own").orderBy(*rank))).where("__r = 1").drop("__r", "__own")
    most = max(v["first"] for v in views.values())
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("view").orderBy(*rank))).where((F.col("place") <= most) & (F.col("place") <= F.col("first")))
    any_ = F.max("preferred").over(Window.partitionBy("view"))
    return placed.withColumn("__any", any_).where("preferred = __any").select("view", "place", *rows.columns)
