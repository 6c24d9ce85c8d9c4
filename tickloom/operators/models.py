"""Forecast jobs over the panel: one task per symbol and horizon for linear members, pooled ML pipelines for trees.

Weights, blends, skill and quality are aggregations over member predictions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clip
from tickloom.sources.storage import stored

FEATURES = ["ret_5", "ret_20", "ma_dist_50", "vol_20", "drawdown_60", "range_position_60"]
#: Weights of the regressors where too few rows tell them apart.
REGRESSOR_WEIGHTS = {"ridge": 0.40, "forest": 0.25, "boosting": 0.20, "extra_trees": 0.15}
SCHEMA = "symbol string, horizon int, dt date, role string, y int, forward_return double, p_linear double, r_ridge double"


def split_roles(n: int, horizon: int) -> dict | None:
    """Row ranges of one series: core training, calibration (if long enough), assessment; purged by the horizon."""
    if n < 250:
        return None
    split = min(max(200, int(0.78 * n)), n - 60)
    train = max(100, split - horizon)
    if n - split >= max(120, 4 * horizon + 40):
        end = split + (n - split) // 2
        return {"train": (0, train), "calibration": (split, end), "assessment": (min(end + horizon, n - 30), n)}
    return {"train": (0, train), "assessment": (split, n)}


def role_columns(n: Column, horizon: int) -> dict[str, Column]:
    """The same ranges as columns of a table with a row for each series: train_end, calibration_start and _end (null: none), assessment_start; null for short ones."""
    split = F.least(F.greatest(F.lit(200), F.floor(n * F.lit(0.78))), n - 60)
    middle = split + F.floor((n - split) / 2)
    apart = n - split >= max(120, 4 * horizon + 40)
    known = n >= 250
    return {
        "train_end": F.when(known, F.greatest(F.lit(100), split - horizon)),
        "calibration_start": F.when(known & apart, split),
        "calibration_end": F.when(known & apart, middle),
        "assessment_start": F.when(known, F.when(apart, F.least(middle + horizon, n - 30)).otherwise(split)),
    }


def inner_folds(n: int, horizon: int, folds: int = 3) -> list[tuple[int, int, int]]:
    """(train end, start, end) of expanding walk-forward blocks; none if too few rows remain."""
    least = max(180, int(0.45 * n))
    if n - least < max(90, 30 * folds):
        return []
    block = int(np.clip((n - least) // folds, 35, 100))
    starts = np.linspace(least, n - block, folds).astype(int)
    return [(max(120, s - horizon), int(s), int(min(n, s + block))) for s in starts]


class Scaled:
    """Median imputation and robust scaling, learned on training rows."""

    def __init__(self, x: np.ndarray):
        self.median = np.nanmedian(x, axis=0)
        low, high = np.nanpercentile(x, [25, 75], axis=0)
        self.width = np.where(high > low, high - low, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (np.where(np.isnan(x), self.median, x) - self.median) / self.width])


def logistic(x: np.ndarray, y: np.ndarray, c: float, balanced: bool = True, rounds: int = 25, start: np.ndarray | None = None) -> np.ndarray:
    """L2-penalised logistic regression by Newton steps, from `start` if it is given; the intercept is free."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if balanced else np.ones(len(y))
    penalty = np.full(x.shape[1], 1 / c)
    penalty[0] = 1e-9
    b = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def ridge(x: np.ndarray, r: np.ndarray, alpha: float) -> np.ndarray:
    penalty = np.full(x.shape[1], alpha)
    penalty[0] = 1e-9
    return np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ r)


def _members(x, y, r, fit: slice, use: slice) -> tuple[np.ndarray, np.ndarray]:
    scale = Scaled(x[fit])
    a, b = scale(x[fit]), scale(x[use])
    p = 1 / (1 + np.exp(-np.clip(b @ logistic(a, y[fit], 0.35), -30, 30))) if len(set(y[fit])) > 1 else np.full(len(b), y[fit].mean())
    return p, b @ ridge(a, r[fit], 18.0)


def linear_members(frame: DataFrame) -> DataFrame:
    """Out-of-fold and assessment predictions of the linear members; frame has FEATURES, y, forward_return, horizon.

    One task per symbol and horizon: a series of daily rows, and numpy inside.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt").reset_index(drop=True)
        h = int(pdf["horizon"].iloc[0])
        roles = split_roles(len(pdf), h)
        if roles is None or pdf["y"].nunique() < 2:
            return pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])
        x, y, r = pdf[FEATURES].to_numpy(float), pdf["y"].to_numpy(int), pdf["forward_return"].to_numpy(float)
        parts = []
        train = roles["train"][1]
        for end, start, stop in inner_folds(train, h):
            if len(set(y[:end])) > 1 and stop - start >= 25:
                parts.append(("OOF", slice(0, end), slice(start, stop)))
        parts += [(k.upper(), slice(0, train), slice(*roles[k])) for k in ("calibration", "assessment") if k in roles]
        out = []
        for role, fit, use in parts:
            p, m = _members(x, y, r, fit, use)
            out.append(pdf.loc[use.start : use.stop - 1, ["symbol", "horizon", "dt", "y", "forward_return"]].assign(role=role, p_linear=p, r_ridge=m))
        return pd.concat(out)[[c.split()[0] for c in SCHEMA.split(", ")]] if out else pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])

    keep = ["symbol", "horizon", "dt", "y", "forward_return", *FEATURES]
    return frame.select(*keep).groupBy("symbol", "horizon").applyInPandas(run, SCHEMA)


def _vector(column: str):
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.col(column)).alias("features")


def pooled_members(rows: DataFrame, features: list[str], horizons: tuple[int, ...], extra: tuple[int, int] = (180, 160), forest: int = 120, rounds: int = 20) -> DataFrame:
    """Predictions of the tree members of the classifiers and regressors, over all symbols, horizon by horizon, for the rows past each horizon's training rows.

    rows: symbol, horizon, dt, y, forward_return, train (whether a row's label is known before the cut), features; missing features are the training
    rows' medians. extra: trees of the two extra-trees forests; forest: trees of the random forest; rounds: of the boosting, whose rounds follow each other.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    from pyspark.ml.classification import GBTClassifier

    from tickloom.operators import trees as T

    rows = stored(T.imputed(rows, features, F.col("train")).select("symbol", "horizon", "dt", "y", "forward_return", "train", "x", F.xxhash64("symbol", "horizon", "dt").alias("key")), "panel")
    train, rest = rows.where("train"), rows.where("NOT train")
    share = train.groupBy("horizon").agg(F.avg("y").alias("__up"))  # a row for each horizon
    weighted = train.join(share, "horizon").withColumn("w", F.when(F.col("y") == 1, 0.5 / F.col("__up")).otherwise(0.5 / (1 - F.col("__up"))))
    each = F.array(F.struct(F.lit("up").alias("kind"), F.col("y").cast("double").alias("t"), F.col("w").alias("v")), F.struct(F.lit("move").alias("kind"), F.col("forward_return").alias("t"), F.lit(1.0).alias("v")))
    grown = weighted.select("horizon", "key", "x", F.inline(each)).select(F.concat_ws("_", "kind", F.col("horizon").cast("string")).alias("model"), "key", "x", F.col("t").alias("y"), F.col("v").alias("w"))
    forests = T.grow(grown, {f"{k}_{h}": n for k, n in zip(("up", "move"), extra, strict=True) for h in horizons}, len(features))
    keep = ["symbol", "horizon", "dt", "y", "forward_return"]
    asked = rest.withColumn("model", F.explode(F.array(*[F.concat(F.lit(f"{k}_"), F.col("horizon").cast("string")) for k in ("up", "move")])))
    seen = T.predict(asked, forests, keep, len(features))
    out = seen.groupBy(*keep).agg(*[F.max(F.when(F.col("model").startswith(k), F.col("prediction"))).alias(n) for k, n in (("up", "p_extra_trees"), ("move", "r_extra_trees"))])
    fitted = {
        "p_boosting": (GBTClassifier(maxIter=rounds, stepSize=0.04, maxDepth=4, minInstancesPerNode=24, seed=42, labelCol="y"), vector_to_array("probability")[1]),
        "r_boosting": (GBTRegressor(maxIter=rounds, stepSize=0.04, maxDepth=4, minInstancesPerNode=24, seed=42, labelCol="forward_return"), F.col("prediction")),
        "r_forest": (RandomForestRegressor(numTrees=forest, maxDepth=6, minInstancesPerNode=12, featureSubsetStrategy="0.65", seed=42, labelCol="forward_return"), F.col("prediction")),
    }
    more = None
    for h in horizons:
        vectors = [part.where(F.col("horizon") == h).select(*keep, _vector("x")) for part in (train, rest)]
        found = vectors[1]
        for name, (model, value) in fitted.items():
            found = model.fit(vectors[0]).transform(found).withColumn(name, value).drop("prediction", "probability", "rawPrediction")
        more = found.drop("features") if more is None else more.unionByName(found.drop("features"))
    return out.join(more.select("symbol", "horizon", "dt", *fitted), ["symbol", "horizon", "dt"])


def pooled_ridge(rows: DataFrame, features: list[str], alpha: float = 18.0) -> DataFrame:
    """symbol, horizon, dt, r_ridge of the rows past the training rows: a ridge regression over all symbols for each horizon, by Spark's normal equations."""
    from pyspark.ml.feature import RobustScaler
    from pyspark.ml.regression import LinearRegression

    from tickloom.operators import trees as T

    rows = stored(T.imputed(rows, features, F.col("train")).select("symbol", "horizon", "dt", "forward_return", "train", _vector("x")), "panel")
    scaled = RobustScaler(inputCol="features", outputCol="scaled", withCentering=True).fit(rows.where("train")).transform(rows)
    out = None
    for r in rows.where("train").groupBy("horizon").agg(F.count("*").alias("n")).orderBy("horizon").toLocalIterator():  # a row for each horizon
        own = scaled.where(F.col("horizon") == r["horizon"])
        model = LinearRegression(featuresCol="scaled", labelCol="forward_return", predictionCol="r_ridge", regParam=alpha / r["n"], elasticNetParam=0.0, standardization=False, solver="normal").fit(own.where("train"))
        found = model.transform(own.where("NOT train")).select("symbol", "horizon", "dt", "r_ridge")
        out = found if out is None else out.unionByName(found)
    return out


def importances(rows: DataFrame, features: list[str], top: int = 8, trees: int = 60) -> DataFrame:
    """The features that a pooled forest leans on, normalised; missing ones are the training rows' medians."""
    from pyspark.ml.classification import RandomForestClassifier

    from tickloom.operators import trees as T

    data = T.imputed(rows, features, F.lit(True)).select(F.col("y").cast("double").alias("label"), _vector("x"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=5, seed=7).fit(data)
    pairs = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda p: -p[1])[:top]
    return rows.sparkSession.createDataFrame(pairs, "feature string, importance double")


def brier_weights(members: DataFrame, by: list[str]) -> DataFrame:
    """members has member, y, p: softmax of Brier scores with a floor, defaults below 50 rows."""
    scores = members.groupBy(*by, "member").agg(F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("brier"), F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    raw = F.exp(-(F.col("brier") - F.min("brier").over(w)) / 0.012)
    scores = scores.withColumn("raw", raw).withColumn("w", 0.08 + 0.92 * F.col("raw") / F.sum("raw").over(w))
    default = F.when(F.col("member") == "linear", 0.45).when(F.col("member") == "factor", 0.35).otherwise(0.2)
    weight = F.when(F.min("n").over(w) < 50, default).otherwise(F.col("w") / F.sum("w").over(w))
    return scores.select(*by, "member", "brier", weight.alias("weight"))


def mae_weights(members: DataFrame, by: list[str]) -> DataFrame:
    """members has member, r, m: the same for regressions, scaled by the spread of the returns; defaults below 40 rows."""
    scores = members.groupBy(*by, "member").agg(F.avg(F.abs(F.col("r") - F.col("m"))).alias("mae"), F.greatest(F.lit(0.0025), 0.2 * F.stddev_samp("r")).alias("scale"), F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    raw = F.exp(-(F.col("mae") - F.min("mae").over(w)) / F.col("scale"))
    scores = scores.withColumn("raw", raw).withColumn("w", 0.06 + 0.94 * F.col("raw") / F.sum("raw").over(w))
    default = F.coalesce(F.element_at(F.create_map(*[x for k, v in REGRESSOR_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("member")), F.lit(0.0))
    weight = F.when(F.min("n").over(w) < 40, default / F.nullif(F.sum(default).over(w), F.lit(0.0))).otherwise(F.col("w") / F.sum("w").over(w))
    return scores.select(*by, "member", "mae", weight.alias("weight"))


def blend(members: DataFrame, weights: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    rows = members.join(weights.select(*by, "member", "weight"), [*by, "member"])
    total = F.sum("weight")
    p = F.when(total > 0, F.sum(F.col("weight") * F.col("p")) / total).otherwise(F.avg("p"))
    return rows.groupBy(*dict.fromkeys([*by, *key])).agg(p.alias("p"), F.first("y").alias("y"))


def _calibration(p: np.ndarray, y: np.ndarray, p_block: np.ndarray, y_block: np.ndarray) -> tuple[float, float] | None:
    """a, b of a logistic curve over the raw probability: of the out-of-fold rows if they are over 80 and of both classes, else of
    the calibration block if it is, else none."""
    for x, t, enough in ((p, y, 80), (p_block, y_block, 0)):
        if len(t) > enough and len(set(t.tolist())) > 1:
            a, b = logistic(np.column_stack([np.ones(len(x)), x]), t, 0.5, balanced=False)
            return float(a), float(b)
    return None


def platt(rows: DataFrame, by: list[str]) -> DataFrame:
    """a, b of a one-feature logistic calibration per group, null where nothing can be fitted; rows has role (OOF, CALIBRATION), p, y."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by) + ", a double, b double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        oof, block = pdf[pdf["role"] == "OOF"], pdf[pdf["role"] == "CALIBRATION"]
        found = _calibration(*(part[c].to_numpy(t) for part in (oof, block) for c, t in (("p", float), ("y", int))))
        return pd.DataFrame([[*key, *(found or (None, None))]], columns=[*by, "a", "b"])

    return rows.where("role IN ('OOF', 'CALIBRATION')").select(*by, "role", "p", "y").groupBy(*by).applyInPandas(run, schema)


def _auc(y: np.ndarray, p: np.ndarray) -> float:
    """Area under the curve, ties averaged; a half for one class."""
    n1 = int(y.sum())
    if n1 in (0, len(y)):
        return 0.5
    ranks = pd.Series(p).rank().to_numpy()
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


FITTED = "symbol string, horizon int, dt date, p double, m double, auc double, brier double, oof_auc double, sigma double, q05 double, q95 double"


def fitted_forecasts(frame: DataFrame) -> DataFrame:
    """The forecast of each symbol and horizon for its last row, by the linear members: one task for each pair.

    frame has symbol, horizon, dt, FEATURES, y and forward_return, these two null in rows whose label isn't known yet. Out-of-fold rows
    calibrate, the assessment rows give skill and residuals, and the last row is predicted by members fitted on all labelled rows.
    """
    names = [c.split()[0] for c in FITTED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt").reset_index(drop=True)
        known = pdf[pdf["y"].notna()]
        h, n = int(pdf["horizon"].iloc[0]), len(known)
        roles = split_roles(n, h)
        if roles is None or known["y"].nunique() < 2:
            return pd.DataFrame(columns=names)
        x, y, r = known[FEATURES].to_numpy(float), known["y"].to_numpy(int), known["forward_return"].to_numpy(float)
        train = roles["train"][1]
        oof_p, oof_y = [], []
        for end, start, stop in inner_folds(train, h):
            if len(set(y[:end])) > 1 and stop - start >= 25:
                oof_p.append(_members(x, y, r, slice(0, end), slice(start, stop))[0])
                oof_y.append(y[start:stop])
        p_oof, y_oof = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((oof_p, float), (oof_y, int)))
        block = slice(*roles.get("calibration", (0, 0)))
        p_block = _members(x, y, r, slice(0, train), block)[0] if block.stop else np.zeros(0)
        curve = _calibration(p_oof, y_oof, p_block, y[block])

        def calibrated(p):
            return p if curve is None else 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * p, -30, 30)))

        use = slice(*roles["assessment"])
        p_seen, m_seen = _members(x, y, r, slice(0, train), use)
        p_seen, left = np.clip(calibrated(p_seen), 1e-4, 1 - 1e-4), r[use] - m_seen
        every = np.vstack([x, pdf[FEATURES].to_numpy(float)[-1:]])
        p_last, m_last = _members(every, y, r, slice(0, n), slice(n, n + 1))
        low, high = np.quantile(left, [0.05, 0.95])
        row = [pdf["symbol"].iloc[0], h, pdf["dt"].iloc[-1], float(calibrated(p_last)[0]), float(m_last[0]), _auc(y[use], p_seen), float(np.mean((y[use] - p_seen) ** 2)), _auc(y_oof, p_oof) if len(y_oof) else 0.5, float(left.std(ddof=1)), float(low), float(high)]
        return pd.DataFrame([row], columns=names)

    keep = ["symbol", "horizon", "dt", "y", "forward_return", *FEATURES]
    return frame.select(*keep).groupBy("symbol", "horizon").applyInPandas(run, FITTED)


def skill(quality_rows: DataFrame) -> DataFrame:
    """Rows with auc, brier, oof_auc: skill and the quality label."""
    d, c, s = clip((F.col("auc") - 0.5) / 0.12, 0.0, 1.0), clip((0.265 - F.col("brier")) / 0.055, 0.0, 1.0), clip((F.col("oof_auc") - 0.5) / 0.12, 0.0, 1.0)
    label = F.when((F.col("auc") >= 0.6) & (F.col("brier") <= 0.24), "HIGH").when((F.col("auc") >= 0.55) & (F.col("brier") <= 0.26), "MODERATE").otherwise("LOW")
    return quality_rows.withColumns({"skill": d * c * (0.65 + 0.35 * s), "quality": label})


def shrink(rows: DataFrame) -> DataFrame:
    """Probability drawn to a half, return to zero, by skill; an interval from the residuals' quantiles or the spread."""
    p = clip(0.5 + (F.col("p") - 0.5) * F.col("skill"), 0.02, 0.98)
    er = F.col("m") * F.col("skill")
    low, high = er + F.coalesce("q05", -1.645 * F.col("sigma")), er + F.coalesce("q95", 1.645 * F.col("sigma"))
    return rows.withColumns({"probability_up": p, "expected_return": er, "lower_return": F.least(low, high), "upper_return": F.greatest(low, high)})
