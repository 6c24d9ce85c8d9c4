"""Decision rules and scorecards as named SQL expressions in layers; a layer may use the columns of those before it.

The texts are plain SQL that Catalyst compiles into one projection per layer; thresholds are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layers = list[dict[str, str]]


def apply(df: DataFrame, layers: Layers) -> DataFrame:
    for layer in layers:
        df = df.withColumns({name: F.expr(text) for name, text in layer.items()})
    return df


def as_sql(source: str, layers: Layers) -> str:
    """The same projection as nested selects."""
    for layer in layers:
        source = f"(SELECT *, {', '.join(f'{text} AS {name}' for name, text in layer.items())} FROM {source})"
    return source


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def score(x: str) -> str:
    return clip(f"coalesce({x}, 0e0)", "0e0", "100e0")


CLASS: Layers = [
    {
        "asset_class": "CASE WHEN symbol LIKE '%-USD' THEN 'CRYPTO' WHEN symbol LIKE '%.WA' THEN 'GPW' WHEN symbol LIKE '%.%' THEN 'ETF_EUROPE' WHEN symbol LIKE '^%' THEN 'INDEX' ELSE 'US' END",
        "crypto": "symbol LIKE '%-USD'",
        "calendar_kind": "CASE WHEN symbol LIKE '%-USD' THEN 'CRYPTO_24_7' WHEN symbol LIKE '%.WA' THEN 'GPW' WHEN symbol LIKE '%.%' THEN 'UNKNOWN' ELSE 'NYSE' END",
    },
    {
        "hot_1d": "CASE WHEN crypto THEN 0.08e0 ELSE 0.025e0 END",
        "hot_5d": "CASE WHEN crypto THEN 0.18e0 ELSE 0.06e0 END",
        "hot_20d": "CASE WHEN crypto THEN 0.35e0 ELSE 0.12e0 END",
    },
]

MOMENTUM: Layers = [
    {
        "radar_momentum": """CASE WHEN return_1d <= -hot_1d OR return_5d <= -hot_5d OR return_20d <= -hot_20d THEN 'PANIC_RISK'
            WHEN return_1d >= hot_1d OR return_5d >= hot_5d OR return_20d >= hot_20d THEN 'MOMENTUM_GEM'
            WHEN near_20d_high AND return_20d > CASE WHEN crypto THEN 0.08e0 ELSE 0.04e0 END AND rsi_14 BETWEEN 45 AND 82 THEN 'BREAKOUT_WATCH'
            WHEN return_5d > CASE WHEN crypto THEN 0.08e0 ELSE 0.03e0 END AND return_20d > CASE WHEN crypto THEN 0.06e0 ELSE 0.025e0 END THEN 'MOMENTUM_WATCH' ELSE 'NONE' END""",
        "radar_score": """return_1d * 300 + return_5d * 180 + return_20d * 80 + return_60d * 18
            + CASE WHEN above_sma_50 THEN 1.2e0 ELSE -0.4e0 END + CASE WHEN above_sma_200 THEN 0.8e0 ELSE 0e0 END + CASE WHEN near_20d_high THEN 1.1e0 ELSE 0e0 END
            - greatest(0e0, coalesce(rsi_14, 50e0) - 82) * 0.08e0 - least(3e0, annual_volatility) * CASE WHEN crypto THEN 0.8e0 ELSE 1.1e0 END""",
    }
]

#: The cheap directional proxy of the first pass; it says of itself that it is of low quality.
FAST_FORECAST: Layers = [
    {
        "horizon_risk": "greatest(annual_volatility * sqrt(greatest(horizon, 1) / CASE WHEN crypto THEN 365e0 ELSE 252e0 END), 0.006e0)",
        "trend_bias": "CASE WHEN above_sma_50 THEN 0.012e0 ELSE -0.004e0 END + CASE WHEN above_sma_200 THEN 0.01e0 ELSE 0e0 END + CASE WHEN near_20d_high THEN 0.008e0 ELSE 0e0 END",
        "cap": "CASE WHEN crypto THEN 0.22e0 ELSE 0.1e0 END",
    },
    {
        "raw_expected": """CASE WHEN horizon <= 1 THEN return_1d * 0.28e0 + return_5d * 0.06e0 + trend_bias * 0.2e0
            WHEN horizon <= 5 THEN return_5d * 0.24e0 + return_20d * 0.07e0 + trend_bias * 0.45e0
            ELSE return_20d * 0.18e0 + return_60d * 0.05e0 + trend_bias * 0.75e0 END"""
    },
    {"expected_return": "least(greatest(raw_expected, -cap), cap)"},
    {
        "probability_up": clip(f"1 / (1 + exp(-0.55e0 * {clip('expected_return / horizon_risk', '-8e0', '8e0')}))", "0.25e0", "0.75e0"),
        "band": "greatest(horizon_risk * 1.75e0, abs(expected_return) * 1.7e0, 0.012e0)",
    },
    {"lower_return": "expected_return - band", "upper_return": "expected_return + band", "auc": "0.5e0", "brier": "0.25e0", "quality": "'LOW_FAST'", "mode": "'FAST'"},
]

#: A closed-form stand-in for fitted forecasts, so that the rules after it can be held against another engine.
FACTOR_FORECAST: Layers = [
    {
        "expected_return": f"{clip('return_20d * 0.3e0 + return_5d * 0.2e0', '-0.2e0', '0.2e0')} * sqrt(horizon / 20e0)",
        "probability_up": clip("0.5e0 + return_60d * 0.9e0 - return_1d * 0.4e0", "0.02e0", "0.98e0"),
        "auc": clip("0.5e0 + abs(return_20d) * 0.8e0", "0.4e0", "0.75e0"),
        "brier": clip("0.26e0 - abs(return_60d) * 0.1e0", "0.2e0", "0.3e0"),
        "mode": "'ML'",
    },
    {
        "lower_return": "expected_return - 1.645e0 * annual_volatility * sqrt(horizon / 252e0)",
        "upper_return": "expected_return + 1.645e0 * annual_volatility * sqrt(horizon / 252e0)",
        "quality": "CASE WHEN auc >= 0.6e0 AND brier <= 0.24e0 THEN 'HIGH' WHEN auc >= 0.55e0 AND brier <= 0.26e0 THEN 'MODERATE' ELSE 'LOW' END",
    },
]

RISK_REWARD: Layers = [
    {
        "downside": "greatest(abs(least(lower_return, 0e0)), annual_volatility / 16, 0.005e0)",
        "upside": "greatest(upper_return, expected_return, 0e0)",
        "auc_quality": clip("(auc - 0.5e0) / 0.12e0", "0e0", "1e0"),
        "brier_quality": clip("(0.27e0 - brier) / 0.06e0", "0e0", "1e0"),
        "trend_quality": "CASE WHEN above_sma_50 THEN 0.45e0 ELSE -0.15e0 END + CASE WHEN above_sma_200 THEN 0.35e0 ELSE 0e0 END + CASE WHEN near_20d_high THEN 0.25e0 ELSE 0e0 END",
    },
    {"risk_reward": "upside / downside"},
    {"edge_score": "expected_return * 120 + (probability_up - 0.5e0) * 90 + least(risk_reward, 4e0) * 0.9e0 + auc_quality * brier_quality * 2.4e0 + trend_quality - least(annual_volatility, 3e0) * 0.35e0"},
    {
        "radar_action": """CASE WHEN quality LIKE 'LOW%' THEN 'OBSERVE_NO_EDGE' WHEN edge_score >= 4.5e0 AND expected_return > 0 THEN 'PRIORITY'
            WHEN edge_score >= 2.5e0 AND expected_return > 0 THEN 'WATCHLIST' WHEN expected_return < 0 OR probability_up < 0.45e0 THEN 'RISK_AVOID' ELSE 'NEUTRAL' END"""
    },
]

SETUP: Layers = [
    {
        "momentum_score": score(
            "45 + return_1d / hot_1d * 10 + return_5d / hot_5d * 18 + return_20d / hot_20d * 18 + return_60d / greatest(hot_20d * 1.8e0, 0.01e0) * 8 + least(relative_volume_20, 2.5e0) * 5 + momentum_acceleration / hot_5d * 10 - greatest(0e0, (coalesce(rsi_14, 50e0) - 78) / 22) * 18"
        ),
        "trend_score": score(
            "30 + CASE WHEN above_sma_50 THEN 22 ELSE -8 END + CASE WHEN above_sma_200 THEN 20 ELSE -4 END + CASE WHEN near_20d_high THEN 12 ELSE 0 END + CASE WHEN near_60d_high THEN 10 ELSE 0 END + (range_position_60 - 0.5e0) * 26 + least(greatest(return_20d, -hot_20d), hot_20d) / hot_20d * 10"
        ),
        "risk_control": score(
            "86 - least(annual_volatility, 3e0) * CASE WHEN crypto THEN 30 ELSE 55 END - least(abs(max_drawdown), 0.9e0) * 32 - least(atr_pct, 0.18e0) * CASE WHEN crypto THEN 110 ELSE 170 END - greatest(0e0, coalesce(rsi_14, 50e0) - 82) * 0.65e0"
        ),
        "liquidity_score": score("(log10(greatest(coalesce(avg_dollar_volume_20, 0e0), 1e0)) - CASE WHEN crypto THEN 5.2e0 ELSE 5.6e0 END) * 25"),
        "ml_score": score("auc_quality * brier_quality * 62 + greatest(0e0, probability_up - 0.5e0) * 120 + greatest(0e0, expected_return) * 180"),
        "rr_score": score("least(risk_reward, 4e0) / 4 * 100"),
    },
    {"setup_score": score("momentum_score * 0.23e0 + trend_score * 0.2e0 + risk_control * 0.18e0 + ml_score * 0.22e0 + liquidity_score * 0.07e0 + rr_score * 0.1e0")},
    {
        "setup_grade": "CASE WHEN setup_score >= 72 AND ml_score >= 45 AND risk_control >= 45 THEN 'A' WHEN setup_score >= 62 AND risk_control >= 35 THEN 'B' WHEN momentum_score >= 72 AND risk_control >= 30 THEN 'M' WHEN risk_control < 28 THEN 'R' ELSE 'C' END",
        "reason_1": "CASE WHEN momentum_score >= 70 THEN 'strong momentum' WHEN return_5d > 0 AND return_20d > 0 THEN 'positive impulse' END",
        "reason_2": "CASE WHEN trend_score >= 70 THEN 'trend supports' WHEN near_20d_high THEN 'near 20d breakout' END",
        "reason_3": "CASE WHEN ml_score >= 55 THEN 'model confirms' WHEN quality LIKE 'LOW%' THEN 'model without edge' END",
        "reason_4": "CASE WHEN relative_volume_20 >= 0.35e0 THEN 'volume above normal' END",
        "reason_5": "CASE WHEN risk_control < 35 THEN 'high risk' END",
    },
    {
        "thesis": "coalesce(nullif(concat_ws(' + ', reason_1, reason_2, reason_3, reason_4, CASE WHEN reason_1 IS NULL OR reason_2 IS NULL OR reason_3 IS NULL OR reason_4 IS NULL THEN reason_5 END), ''), 'no dominant factor')",
        "setup": """CASE WHEN near_20d_high AND return_20d > 0 AND rsi_14 BETWEEN 45 AND 78 THEN 'BREAKOUT' WHEN above_sma_50 AND above_sma_200 AND return_20d > 0 THEN 'TREND'
            WHEN return_5d > 0 AND return_20d < 0 AND horizon <= 5 THEN 'SHORT_REBOUND' WHEN rsi_14 >= 78 THEN 'OVERHEATED' WHEN rsi_14 <= 32 THEN 'OVERSOLD' ELSE 'NEUTRAL' END""",
    },
]

FAST_ROW: Layers = [
    {
        "fast_action": """CASE WHEN radar_momentum = 'PANIC_RISK' OR risk_control < 28 OR expected_return < -0.025e0 THEN 'RISK_AVOID' WHEN setup_score >= 64 THEN 'FAST_SHORTLIST'
            WHEN radar_momentum IN ('MOMENTUM_GEM', 'BREAKOUT_WATCH', 'MOMENTUM_WATCH') THEN 'MOMENTUM_CHECK' ELSE 'OBSERVE' END""",
        "deep_score": f"setup_score * 0.72e0 + {score('50 + radar_score * 6')} * 0.28e0",
    },
]

ML_ROW: Layers = [
    {
        "confidence_quality": clip("(auc - 0.45e0) / 0.2e0", "0e0", "1e0"),
        "momentum_bonus": f"{clip('return_20d', '-0.08e0', '0.12e0')} * 25 + CASE WHEN above_sma_50 THEN 0.75e0 ELSE -0.35e0 END + CASE WHEN near_20d_high THEN 0.55e0 ELSE 0e0 END",
    },
    {
        "score": "(probability_up - 0.5e0) * 210 * confidence_quality + expected_return * 90 + momentum_bonus - least(1.5e0, annual_volatility) * CASE WHEN crypto THEN 8 ELSE 10 END",
        "confidence": "abs(probability_up - 0.5e0) * 2 * confidence_quality",
        "deep_score": "setup_score * 0.75e0 + greatest(edge_score, 0e0) * 4",
        "signal_label": "CASE WHEN quality LIKE 'LOW%' THEN 'NO_EDGE' WHEN probability_up >= 0.62e0 THEN 'STRONG_UP' WHEN probability_up >= 0.54e0 THEN 'UP' WHEN probability_up <= 0.38e0 THEN 'STRONG_DOWN' WHEN probability_up <= 0.46e0 THEN 'DOWN' ELSE 'NEUTRAL' END",
    },
]


def gate(threshold: float = 0.55, least: float = 0.0) -> Layers:
    """Quality first, then probability, then conflicts of the expected return, then its size."""
    t, m = f"{threshold!r}e0", f"{least!r}e0"
    return [
        {
            "decision_reason": f"""CASE WHEN quality LIKE 'LOW%' THEN 'LOW_QUALITY'
            WHEN {clip('probability_up', '0e0', '1e0')} >= {t} THEN CASE WHEN expected_return < 0 THEN 'EXPECTED_RETURN_CONFLICT' WHEN expected_return < {m} THEN 'EXPECTED_RETURN_TOO_SMALL' ELSE 'LONG_CONFIRMED' END
            WHEN {clip('probability_up', '0e0', '1e0')} <= 1 - {t} THEN CASE WHEN expected_return > 0 THEN 'EXPECTED_RETURN_CONFLICT' WHEN abs(expected_return) < {m} THEN 'EXPECTED_RETURN_TOO_SMALL' ELSE 'SHORT_CONFIRMED' END
            ELSE 'PROBABILITY_INSIDE_BAND' END"""
        },
        {
            "decision": "CASE decision_reason WHEN 'LONG_CONFIRMED' THEN 1 WHEN 'SHORT_CONFIRMED' THEN -1 ELSE 0 END",
            "decision_label": "CASE decision_reason WHEN 'LONG_CONFIRMED' THEN 'LONG' WHEN 'SHORT_CONFIRMED' THEN 'SHORT' WHEN 'LOW_QUALITY' THEN 'NO_SIGNAL' ELSE 'OBSERVE' END",
        },
    ]


_BAD = "({0} IS NULL OR isnan({0}) OR abs({0}) = cast('Infinity' AS double))"


def closed_gate(threshold: float = 0.55) -> Layers:
    """The gate, failing closed: incomplete forecasts never look neutral."""
    open_ = gate(threshold)
    issue = f"CASE WHEN {_BAD.format('expected_return')} THEN 'EXPECTED_RETURN' WHEN {_BAD.format('probability_up')} OR NOT probability_up BETWEEN 0 AND 1 THEN 'PROBABILITY' END"
    reason = f"CASE WHEN input_issue IS NOT NULL THEN 'INCOMPLETE_FORECAST' ELSE {open_[0]['decision_reason']} END"
    return [{"input_issue": issue}, {"decision_reason": reason}, open_[1]]


STATE: Layers = [
    {
        "decision_state": """CASE WHEN mode IS NULL OR mode <> 'ML' THEN 'INVALID' WHEN decision = 1 AND decision_reason = 'LONG_CONFIRMED' THEN 'LONG' WHEN decision = -1 AND decision_reason = 'SHORT_CONFIRMED' THEN 'SHORT'
            WHEN decision = 0 AND decision_reason IN ('EXPECTED_RETURN_CONFLICT', 'EXPECTED_RETURN_TOO_SMALL', 'INCOMPLETE_FORECAST', 'LOW_QUALITY', 'PROBABILITY_INSIDE_BAND') THEN 'NEUTRAL' ELSE 'INVALID' END""",
        "observation": """CASE WHEN decision = 0 AND quality LIKE 'LOW%' THEN 'NO_SIGNAL' WHEN decision = 1 AND probability_up >= 0.62e0 THEN 'STRONG_UP_CANDIDATE' WHEN decision = 1 THEN 'UP_CANDIDATE'
            WHEN decision = -1 AND probability_up <= 0.38e0 THEN 'STRONG_DOWN_RISK' WHEN decision = -1 THEN 'DOWN_RISK' ELSE 'OBSERVE' END""",
        "error_code": "CASE WHEN mode = 'ML' AND input_issue IS NOT NULL THEN concat('RADAR_ML_INVALID_', input_issue) END",
    }
]

#: The order in which the second pass looks at symbols, of rows of the first.
PRIORITY: Layers = [{"priority": f"deep_score * 0.52e0 + setup_score * 0.3e0 + {clip('radar_score', '-5e0', '15e0')} * 2.2e0 + {clip('edge_score', '-5e0', '10e0')} * 3 + {clip('risk_control', '0e0', '100e0')} * 0.08e0"}]

NOTES: Layers = [
    {
        "risk_notes": """concat_ws('; ', CASE WHEN rsi_14 >= 72 THEN 'RSI_HIGH' WHEN rsi_14 <= 30 THEN 'RSI_LOW' END, CASE WHEN risk_reward < 1 THEN 'RISK_REWARD' END, CASE WHEN risk_control < 45 THEN 'RISK_CONTROL' END,
            CASE WHEN max_drawdown <= -0.3e0 THEN 'DRAWDOWN' END, CASE WHEN mode <> 'ML' THEN 'NOT_ML' END, CASE WHEN quality LIKE 'LOW%' THEN 'LOW_QUALITY' END)""",
        "trend_points": "CASE WHEN return_20d > 0 THEN 1 ELSE 0 END + CASE WHEN rsi_14 >= 50 THEN 1 ELSE 0 END + CASE WHEN above_sma_50 THEN 1 ELSE 0 END + CASE WHEN above_sma_200 THEN 1 ELSE 0 END",
        "is_confirmed": "mode = 'ML' AND decision_state = 'LONG'",
        "is_risk": "(mode = 'ML' AND decision_state = 'SHORT') OR radar_action LIKE 'RISK%' OR radar_momentum = 'PANIC_RISK'",
        "is_watch": "radar_action IN ('PRIORITY', 'WATCHLIST') OR setup_grade IN ('A', 'B')",
    },
    {"trend_state": "CASE WHEN trend_points >= 3 THEN 'POSITIVE' WHEN trend_points <= 1 THEN 'NEGATIVE' ELSE 'MIXED' END"},
]

COMMON = [*CLASS, *MOMENTUM]
FAST = [*COMMON, *FAST_FORECAST, *RISK_REWARD, *SETUP, *FAST_ROW]
FAST = [*FAST, *PRIORITY]
#: What follows a forecast, wherever it comes from.
AFTER_FORECAST = [*RISK_REWARD, *SETUP, *ML_ROW, *closed_gate(), *STATE, *NOTES]
ML = [*COMMON, *FACTOR_FORECAST, *AFTER_FORECAST]
