"""Output rounding shared by the registered queries and their oracle SQL.

Two engines sum in different orders, so results are compared after rounding.
Means of 2-decimal prices have at most 5 exact decimals, so 6 decimals never
sits on a rounding tie; values that carry a square root or an exponential
scan are rounded at a magnitude-safe position instead.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, functions as F

DEFAULT_DECIMALS = 6
# (pattern, decimals): first match wins.
RULES = [
    ("ema_*", 4), ("macd*", 4), ("bb_upper", 4), ("bb_lower", 4), ("*_std", 4),
    ("volatility_5d", 4), ("volatility_20d", 4), ("predicted_value", 4),
    ("lower_ci", 4), ("upper_ci", 4), ("rmse", 4), ("mse", 2), ("forecast_*", 4),
    ("bb_width", 8), ("bb_position", 8), ("bollinger_position", 8),
    ("volatility_20", 8), ("volatility_50", 8), ("*return*", 8), ("*ratio*", 8),
    ("roc_*", 8), ("r2", 8), ("rsi*", 6), ("*_pct", 6), ("*_percent", 6),
]


def decimals_for(name: str) -> int:
    for pat, d in RULES:
        if fnmatch.fnmatch(name, pat):
            return d
    return DEFAULT_DECIMALS


def round_doubles(df: DataFrame, overrides: dict | None = None) -> DataFrame:
    overrides = overrides or {}
    out = []
    for name, typ in df.dtypes:
        if typ in ("double", "float"):
            d = overrides.get(name, decimals_for(name))
            out.append(F.round(F.col(name), d).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def sql_round(expr: str, name: str, overrides: dict | None = None) -> str:
    """DuckDB rounding with Spark's semantics: HALF_UP on the shortest decimal
    text of the double (DuckDB's own round works on the binary value)."""
    d = (overrides or {}).get(name, decimals_for(name))
    dec = f"CAST(CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18))"
    return f"(CAST(round({dec}, {d}) AS DOUBLE) + 0.0) AS {name}"
