"""Technical indicators per symbol by date, all in one window plan.

Every rolling expression shares one partitioning ``(symbol, _ck)`` and one
order ``_rn`` (see ``sequence``), so a whole indicator set costs one exchange
and one sort; dependent indicators (Bollinger, RSI, volatility of returns) are
a second ``select`` over the same distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickforge import schema as S
from tickforge.functions.columns import full_avg, full_std, safe_div
from tickforge.operators import sequence as seq
from tickforge.operators.ewm import ewm_columns, ewm_halo

TECHNICAL_COLUMNS = (
    ["daily_return", "log_return"]
    + [c for n in S.MA_WINDOWS for c in (f"ma_{n}", f"ma_{n}_ratio")]
    + [f"ema_{s}" for s in S.EMA_SPANS]
    + ["macd", "macd_signal", "macd_histogram",
       "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position",
       "rsi", "volatility_20", "volatility_50", "volume_ma_20", "volume_ratio"]
    + [c for n in S.MOMENTUM_PERIODS for c in (f"momentum_{n}", f"roc_{n}")]
    + ["hl_ratio", "oc_ratio"])

MODEL_FEATURES = (
    ["close", "open", "high", "low", "volume",
     "return_1d", "return_5d", "return_20d",
     "ma_5", "ma_10", "ma_20", "ma_50",
     "close_to_ma5", "close_to_ma20", "ma5_to_ma20",
     "volatility_5d", "volatility_20d", "volume_ma_5", "volume_ratio",
     "high_low_ratio", "close_open_ratio", "rsi_14"]
    + [c for k in S.MODEL_LAGS for c in (f"close_lag_{k}", f"volume_lag_{k}")])


def _lag(c: str, n: int, w) -> F.Column:
    return F.lag(c, n).over(w)


def daily_return(c="close", w=None):
    return safe_div(F.col(c), _lag(c, 1, w)) - 1


def log_return(c="close", w=None):
    return F.ln(safe_div(F.col(c), _lag(c, 1, w)))


def rsi_expr(close: str, w, period: int = S.RSI_PERIOD):
    """Simple-mean RSI. The first row's change counts as 0, so the value starts
    at row ``period``; no losses and some gain give 100, no change gives null."""
    delta = F.col(close) - F.lag(close, 1).over(w)
    gain = F.coalesce(F.when(delta > 0, delta), F.lit(0.0))
    loss = F.coalesce(F.when(delta < 0, -delta), F.lit(0.0))
    frame = w.rowsBetween(-(period - 1), 0)
    full = F.count(F.lit(1)).over(frame) == period
    g = F.avg(gain).over(frame)
    lo = F.avg(loss).over(frame)
    value = (F.when(lo == 0, F.when(g > 0, F.lit(100.0)))
             .otherwise(100 - 100 / (1 + g / lo)))
    return F.when(full & F.col(close).isNotNull(), value)


def add_rolling(s: DataFrame, key: str = "symbol") -> DataFrame:
    """Returns, SMAs, Bollinger, RSI, volatility, volume, momentum, ranges on a
    chunked frame (``sequence.chunked`` with at least 199 halo rows)."""
    w = seq.window(key)
    level1 = [daily_return("close", w).alias("daily_return"),
              log_return("close", w).alias("log_return")]
    for n in S.MA_WINDOWS:
        level1.append(full_avg("close", w, n).alias(f"ma_{n}"))
    level1.append(full_std("close", w, S.BOLLINGER_WINDOW).alias("_bb_std"))
    level1.append(rsi_expr("close", w).alias("rsi"))
    level1.append(full_avg("volume", w, 20).alias("volume_ma_20"))
    for n in S.MOMENTUM_PERIODS:
        prev = _lag("close", n, w)
        level1.append((F.col("close") - prev).alias(f"momentum_{n}"))
        level1.append((safe_div(F.col("close") - prev, prev) * 100).alias(f"roc_{n}"))
    x = s.select("*", *level1)
    k = S.BOLLINGER_K
    upper = F.col("ma_20") + F.col("_bb_std") * k
    lower = F.col("ma_20") - F.col("_bb_std") * k
    level2 = [safe_div("close", f"ma_{n}").alias(f"ma_{n}_ratio") for n in S.MA_WINDOWS]
    level2 += [F.col("ma_20").alias("bb_middle"), upper.alias("bb_upper"),
               lower.alias("bb_lower"),
               safe_div(upper - lower, F.col("ma_20")).alias("bb_width"),
               safe_div(F.col("close") - lower, upper - lower).alias("bb_position"),
               full_std("daily_return", w, 20).alias("volatility_20"),
               full_std("daily_return", w, 50).alias("volatility_50"),
               safe_div("volume", "volume_ma_20").alias("volume_ratio"),
               safe_div(F.col("high") - F.col("low"), F.col("close")).alias("hl_ratio"),
               safe_div(F.col("close") - F.col("open"), F.col("open")).alias("oc_ratio")]
    return x.select("*", *level2).drop("_bb_std")


def rolling_indicators(df: DataFrame, key: str = "symbol",
                       chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Returns, SMAs, Bollinger, RSI, volatility, volume, momentum, ranges."""
    s = seq.chunked(df, key, "date", back=max(S.MA_WINDOWS) - 1, chunk_rows=chunk_rows)
    return seq.drop_halo(add_rolling(s, key))


MACD_HALO = ewm_halo(max(S.EMA_SPANS), S.MACD_SIGNAL_SPAN)


def add_macd(df: DataFrame, key: str = "symbol", price: str = "close") -> DataFrame:
    """ema_12, ema_26, macd, macd_signal, macd_histogram on a chunked frame
    carrying at least ``MACD_HALO`` halo rows."""
    fast, slow = S.EMA_SPANS
    x = ewm_columns(df, [(price, fast, f"ema_{fast}"), (price, slow, f"ema_{slow}")], key)
    x = x.withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    x = ewm_columns(x, [("macd", S.MACD_SIGNAL_SPAN, "macd_signal")], key)
    return x.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def technical_features(df: DataFrame, key: str = "symbol",
                       chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """All 35 technical indicators, one partitioning."""
    base = list(df.columns)
    s = seq.chunked(df, key, "date", back=max(MACD_HALO, max(S.MA_WINDOWS) - 1),
                    chunk_rows=chunk_rows)
    # EMAs first, while rows are narrow: their range frames buffer whole rows.
    x = add_rolling(add_macd(s, key, "close"), key)
    return seq.drop_halo(x).select(*base, *TECHNICAL_COLUMNS)


def macd(df: DataFrame, key: str = "symbol",
         chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Bars plus ema_12, ema_26, macd, macd_signal, macd_histogram."""
    base = list(df.columns)
    s = seq.chunked(df, key, "date", back=MACD_HALO, chunk_rows=chunk_rows)
    x = seq.drop_halo(add_macd(s, key, "close"))
    return x.select(*base, "ema_12", "ema_26", "macd", "macd_signal", "macd_histogram")


def ema(df: DataFrame, column: str = "close", span: float = 12, out: str | None = None,
        key: str = "symbol", chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    base = list(df.columns)
    out = out or f"ema_{int(span) if float(span).is_integer() else span}"
    s = seq.chunked(df, key, "date", back=ewm_halo(span), chunk_rows=chunk_rows)
    return seq.drop_halo(ewm_columns(s, [(column, span, out)], key)).select(*base, out)


def model_features(df: DataFrame, key: str = "symbol",
                   chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """The 32 model features, ``target`` = next close, and the symbol."""
    back = max(max(S.MODEL_LAGS), 50 - 1, 20)
    s = seq.chunked(df, key, "date", back=back, fwd=1, chunk_rows=chunk_rows)
    w = seq.window(key)
    lag = {n: _lag("close", n, w) for n in (1, 5, 20)}
    cols = [F.col("close"), F.col("open"), F.col("high"), F.col("low"), F.col("volume"),
            (safe_div(F.col("close"), lag[1]) - 1).alias("return_1d"),
            (safe_div(F.col("close"), lag[5]) - 1).alias("return_5d"),
            (safe_div(F.col("close"), lag[20]) - 1).alias("return_20d")]
    for n in (5, 10, 20, 50):
        cols.append(full_avg("close", w, n).alias(f"ma_{n}"))
    cols += [full_std("close", w, 5).alias("volatility_5d"),
             full_std("close", w, 20).alias("volatility_20d"),
             full_avg("volume", w, 5).alias("volume_ma_5"),
             safe_div("high", "low").alias("high_low_ratio"),
             safe_div("close", "open").alias("close_open_ratio"),
             rsi_expr("close", w).alias("rsi_14")]
    for k in S.MODEL_LAGS:
        cols.append(_lag("close", k, w).alias(f"close_lag_{k}"))
        cols.append(_lag("volume", k, w).alias(f"volume_lag_{k}"))
    cols.append(F.lead("close", 1).over(w).alias("target"))
    x = s.select(key, "date", seq.HALO, *cols)
    x = x.select("*", safe_div("close", "ma_5").alias("close_to_ma5"),
                 safe_div("close", "ma_20").alias("close_to_ma20"),
                 safe_div("ma_5", "ma_20").alias("ma5_to_ma20"),
                 safe_div("volume", "volume_ma_5").alias("volume_ratio"))
    x = x.filter(~F.col(seq.HALO))
    return x.select(key, "date", *MODEL_FEATURES, "target")


def min_history_filter(df: DataFrame, n: int = S.MIN_HISTORY, key: str = "symbol"
                       ) -> DataFrame:
    """Drop symbols with fewer than ``n`` rows (counted by a partial aggregate)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return df.join(counts.select(key), key, "left_semi")
