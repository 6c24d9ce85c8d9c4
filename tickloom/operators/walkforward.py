"""Walk-forward tests with refits: at every k-th row of a series the forecast is fitted anew on the labels known by then.

A refit needs fits on a dozen beginnings of the series: folds, core rows, all known rows. Sums of products of features and returns are kept
at every few rows and added up in time order, so that a least-squares fit on any beginning is the solution of a small system, whatever its length; scaling is a
change of its coordinates. A row whose label isn't known yet at the refit is beyond the beginning: nothing has to be taken out. The logistic fit has no such
sums: it starts from the coefficients of the refit before, and takes a few Newton steps. A series of daily rows is one task's work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.operators import labels as L
from tickloom.operators import models as M

REFIT, FIRST, SHARE = 60, 300, 0.55
#: Rows between two sums of products.
STEP = 64
OUT = "symbol string, horizon int, dt date, refit int, known_rows int, known_until date, p double, m double, p_linear double, auc double, brier double, oof_auc double, sigma double, q05 double, q95 double"


class Beginnings:
    """Fits on the first rows of one series: x without an intercept, y 0 or 1, r returns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, r: np.ndarray):
        self.x, self.y, self.r = x, y, r
        self.ones = np.column_stack([np.ones(len(x)), x])
        blocks = [np.column_stack([self.ones[i : i + STEP], r[i : i + STEP]]) for i in range(0, len(x) - STEP + 1, STEP)]
        products = [b.T @ b for b in blocks]
        self.sums = np.concatenate([np.zeros((1, x.shape[1] + 2, x.shape[1] + 2)), np.cumsum(products, axis=0)]) if products else np.zeros((1, x.shape[1] + 2, x.shape[1] + 2))
        self.scales: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.warm: dict[str, np.ndarray] = {}

    def scale(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Medians and interquartile ranges of the first rows."""
        if end not in self.scales:
            low, median, high = np.percentile(self.x[:end], [25, 50, 75], axis=0)
            self.scales[end] = median, np.where(high > low, high - low, 1.0)
        return self.scales[end]

    def products(self, end: int) -> np.ndarray:
        """Sums of products of (1, x, r) over the first rows."""
        whole = end // STEP
        rest = np.column_stack([self.ones[whole * STEP : end], self.r[whole * STEP : end]])
        return self.sums[whole] + rest.T @ rest

    def ridge(self, end: int, alpha: float) -> np.ndarray:
        """Coefficients for (1, x) of the ridge regression of r on the scaled features, the intercept free."""
        median, width = self.scale(end)
        d = len(median)
        to = np.eye(d + 1)
        to[0, 1:] = -median / width
        to[np.arange(1, d + 1), np.arange(1, d + 1)] = 1 / width
        g = self.products(end)
        penalty = np.full(d + 1, alpha)
        penalty[0] = 1e-9
        return to @ np.linalg.solve(to.T @ g[:-1, :-1] @ to + np.diag(penalty), to.T @ g[:-1, -1])

    def logistic(self, end: int, c: float, name: str) -> np.ndarray:
        """Coefficients for (1, x) of the logistic fit on the scaled features; name: of the fit that it starts from, and is the next one's start."""
        median, width = self.scale(end)
        start = None
        if name in self.warm:
            b = self.warm[name]
            start = np.concatenate([[b[0] + b[1:] @ median], b[1:] * width])
        b = M.logistic(np.column_stack([np.ones(end), (self.x[:end] - median) / width]), self.y[:end], c, start=start)
        raw = np.concatenate([[b[0] - (b[1:] / width) @ median], b[1:] / width])
        self.warm[name] = raw
        return raw


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def state(s: Beginnings, n: int, horizon: int) -> dict | None:
    """The forecast fitted on the first n rows: coefficients, calibration, and figures of its assessment rows; None if it can't be fitted."""
    y = s.y[:n]
    roles = M.split_roles(n, horizon)
    if roles is None or len(set(y.tolist())) < 2:
        return None
    train = roles["train"][1]
    p_oof, y_oof = [], []
    for k, (end, start, stop) in enumerate(M.inner_folds(train, horizon)):
        if len(set(y[:end].tolist())) > 1 and stop - start >= 25:
            p_oof.append(sigmoid(s.ones[start:stop] @ s.logistic(end, 0.35, f"fold {k}")))
            y_oof.append(y[start:stop])
    p_oof, y_oof = (np.concatenate(v) if v else np.zeros(0) for v in (p_oof, y_oof))
    if len(set(y[:train].tolist())) > 1:
        core = s.logistic(train, 0.35, "core")
    else:
        core = np.zeros(s.ones.shape[1])
        core[0] = 30.0 if y[0] else -30.0
    block = slice(*roles.get("calibration", (0, 0)))
    curve = M._calibration(p_oof, y_oof.astype(int), sigmoid(s.ones[block] @ core), y[block])
    use = slice(*roles["assessment"])
    seen = sigmoid(s.ones[use] @ core)
    seen = np.clip(calibrated(seen, curve), 1e-4, 1 - 1e-4)
    left = s.r[use] - s.ones[use] @ s.ridge(train, 18.0)
    low, high = np.quantile(left, [0.05, 0.95]) if len(left) >= 30 else (None, None)
    return {
        "curve": curve,
        "class": s.logistic(n, 0.35, "all"),
        "value": s.ridge(n, 18.0),
        "auc": M._auc(y[use], seen),
        "brier": float(np.mean((y[use] - seen) ** 2)),
        "oof_auc": M._auc(y_oof.astype(int), p_oof) if len(y_oof) else 0.5,
        "sigma": float(max(left.std(ddof=1), s.r[use].std(ddof=1) * 0.35, 1e-4)),
        "q05": low,
        "q95": high,
    }


def calibrated(p: np.ndarray, curve: tuple[float, float] | None) -> np.ndarray:
    return p if curve is None else sigmoid(curve[0] + curve[1] * p)


def walk(pdf: pd.DataFrame, features: list[str], refit: int) -> pd.DataFrame:
    """One series in time order: forecasts of each row from its start on, by the refit before it."""
    names = [c.split()[0] for c in OUT.split(", ")]
    pdf = pdf.sort_values("dt").reset_index(drop=True)
    n, h = len(pdf), int(pdf["horizon"].iloc[0])
    s = Beginnings(pdf[features].to_numpy(float), pdf["y"].to_numpy(int), pdf["forward_return"].to_numpy(float))
    out, fitted = [], None
    start = max(FIRST, int(SHARE * n))
    for k, low in enumerate(range(start, n, refit)):
        known = low - h + 1  # the newest label that is known after this row's close is h rows back
        if known < 250 or (fresh := state(s, known, h)) is None:
            continue
        fitted = fresh
        rows = s.ones[low : low + refit]
        p = sigmoid(rows @ fitted["class"])
        part = pdf.loc[low : low + refit - 1, ["symbol", "horizon", "dt"]].assign(refit=k, known_rows=known, known_until=pdf["dt"].iloc[known - 1], p=calibrated(p, fitted["curve"]), m=rows @ fitted["value"], p_linear=p)
        out.append(part.assign(**{c: fitted[c] for c in ("auc", "brier", "oof_auc", "sigma", "q05", "q95")}))
    return pd.concat(out)[names] if out else pd.DataFrame(columns=names)


def labelled(bars: DataFrame, frame: DataFrame, features: list[str], horizons=(1, 5, 20)) -> DataFrame:
    """Rows of the feature frame by horizon whose features, label and execution are all known; with entry, exit and execution_return."""
    done = L.executions(bars, list(horizons)).where("forward_return IS NOT NULL AND exit_price IS NOT NULL AND entry_price IS NOT NULL")
    rows = frame.select("symbol", "dt", *features).dropna(subset=features).join(done.drop("close"), ["symbol", "dt"])
    return rows.withColumn("y", (F.col("forward_return") > 0).cast("int"))


def forecasts(rows: DataFrame, features: list[str], refit: int = REFIT) -> DataFrame:
    """probability_up, expected_return, skill, quality of each row of `labelled` from its series' start on, drawn to the middle by skill."""
    keep = ["symbol", "horizon", "dt", "y", "forward_return", *features]
    raw = rows.select(*keep).groupBy("symbol", "horizon").applyInPandas(lambda pdf: walk(pdf, features, refit), OUT)
    return M.shrink(M.skill(raw))


def records(rows: DataFrame, forecast: DataFrame, cost: float = 0.0015, threshold: float = 0.56) -> DataFrame:
    """Every decision point with its gate, execution and benchmarks, in the columns of the reports; rows has ret_20."""
    own = forecast.select("symbol", "horizon", "dt", "refit", "known_until", "probability_up", "expected_return", "skill", "quality", "p_linear", "auc", "brier")
    rows = rows.join(own, ["symbol", "horizon", "dt"]).withColumn("mode", F.lit("ML"))
    rows = rules.apply(rows, [rules.CLASS[0], *rules.gate(threshold)])
    linear = F.when(F.col("p_linear") >= threshold, 1).when(F.col("p_linear") <= 1 - threshold, -1).otherwise(0)
    momentum, move = F.when(F.col("ret_20") > 0, 1).otherwise(-1), F.col("execution_return")
    gross = F.col("decision") * move
    return rows.select(
        "symbol", F.col("asset_class").alias("market"), "horizon", "dt", "refit", "known_until", F.col("refit").alias("fold"), "entry_dt", "exit_dt", "entry_price", "exit_price",
        "probability_up", "expected_return", "skill", "quality", "auc", "brier", F.col("decision").alias("position"), "decision_reason",
        gross.alias("gross_return"), (gross - F.abs("decision") * cost).alias("ret"), F.lit(cost).alias("cost"),
        (move - cost).alias("always_long_return"), move.alias("buy_hold_return"), (momentum * move - cost).alias("momentum_return"), (linear * move - F.abs(linear) * cost).alias("linear_return"),
        F.col("y").alias("actual_up"), (move > 0).cast("int").alias("execution_up"),
    )
