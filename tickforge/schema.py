"""Schemas and fixed vocabularies of the bar data model."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ("symbol", "date")
PRICE_COLS = ("open", "high", "low", "close")
OHLCV = ("open", "high", "low", "close", "volume")
BAR_COLS = ("symbol", "date") + OHLCV

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

# --- fixed values (kept as given for identical behaviour) ----------------
# Column synonyms, first match wins, in this order.
SYNONYMS = {
    "date": ["date", "datetime", "timestamp", "time"],
    "symbol": ["symbol", "ticker", "stock", "name"],
    "open": ["open", "opening_price", "opening"],
    "high": ["high", "highest", "high_price"],
    "low": ["low", "lowest", "low_price"],
    "close": ["close", "closing_price", "closing", "last"],
    "volume": ["volume", "vol", "quantity", "traded_quantity"],
}
# File stems in a symbol directory that are not symbols.
NON_SYMBOL_STEMS = ["stock_metadata", "NIFTY50_all"]
# Hard-coded sector sets of the market page.
SECTOR_SETS = {
    "Banking": ["HDFCBANK", "ICICIBANK", "SBIN", "AXISBANK", "KOTAKBANK"],
    "IT": ["TCS", "INFY", "WIPRO", "HCLTECH", "TECHM"],
    "Auto": ["MARUTI", "TATAMOTORS", "BAJAJ-AUTO", "EICHERMOT", "HEROMOTOCO"],
}
# Symbol renamed between the metadata file and the symbol list.
SYMBOL_ALIASES = {"M&M": "MM"}
# Exchange suffixes accepted as already qualified.
EXCHANGE_SUFFIXES = [".NS", ".BO"]
DEFAULT_EXCHANGE_SUFFIX = ".NS"
# Trailing periods understood by the period slice.
PERIODS = ["1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "5y", "10y", "ytd", "max"]
# Bar intervals accepted by the resampler.
INTERVALS = ["1m", "2m", "5m", "15m", "30m", "60m", "90m", "1h", "1d", "5d",
             "1wk", "1mo", "3mo"]
# Feature windows.
MA_WINDOWS = [5, 10, 20, 50, 200]
EMA_SPANS = [12, 26]
MACD_SIGNAL_SPAN = 9
MOMENTUM_PERIODS = [5, 10, 20]
RSI_PERIOD = 14
BOLLINGER_WINDOW = 20
BOLLINGER_K = 2
MODEL_LAGS = [1, 2, 3, 5, 10]
LOOKBACK = 60
MIN_HISTORY = LOOKBACK + 50
FRESH_DAYS = 7
# Signal thresholds.
RSI_OVERBOUGHT = 70
RSI_OVERSOLD = 30
BB_UPPER_SIGNAL = 0.8
BB_LOWER_SIGNAL = 0.2
OUTLIER_IQR_K = 3
OUTLIER_Z = 3
TRAIN_FRACTION = 0.8
