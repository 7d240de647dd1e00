"""Per-symbol summaries: returns, volatility, extremes, latest bar, signals.

Per-symbol "first"/"last" values use ``min_by``/``max_by`` aggregates (partial
aggregation before the shuffle); "last N rows" uses the distributed position
from ``sequence.with_position``, never a window over a whole symbol.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickforge import schema as S
from tickforge.functions.columns import pct, safe_div, signal_when
from tickforge.operators import sequence as seq
from tickforge.operators.features import daily_return


def date_range(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.groupBy(key).agg(F.min("date").alias("start_date"),
                               F.max("date").alias("end_date"))


def price_stats(df: DataFrame, key: str = "symbol", column: str = "close") -> DataFrame:
    return df.groupBy(key).agg(F.avg(column).alias("close_mean"),
                               F.stddev_samp(column).alias("close_std"),
                               F.min(column).alias("close_min"),
                               F.max(column).alias("close_max"))


def data_summary(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows, date range, missing counts (map), close statistics, column count."""
    cols = [c for c in df.columns if c != key]
    missing = F.create_map(*[x for c in cols for x in
                             (F.lit(c), F.count_if(F.col(c).isNull()))])
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_rows"), F.min("date").alias("start_date"),
        F.max("date").alias("end_date"), missing.alias("missing_values"),
        F.avg("close").alias("close_mean"), F.stddev_samp("close").alias("close_std"),
        F.min("close").alias("close_min"), F.max("close").alias("close_max"),
        F.lit(len(df.columns)).alias("n_columns"))


def total_return(df: DataFrame, key: str = "symbol") -> DataFrame:
    first = F.min_by("close", "date")
    last = F.max_by("close", "date")
    return df.groupBy(key).agg(first.alias("first_close"), last.alias("last_close")) \
        .withColumn("total_return_pct", pct("last_close", "first_close"))


def with_daily_return(df: DataFrame, key: str = "symbol",
                      chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    s = seq.chunked(df, key, "date", back=1, chunk_rows=chunk_rows)
    x = s.select("*", daily_return("close", seq.window(key)).alias("daily_return"))
    return seq.drop_halo(x)


def volatility(df: DataFrame, key: str = "symbol",
               chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """std(daily return) * 100 per symbol."""
    x = df if "daily_return" in df.columns else with_daily_return(df, key, chunk_rows)
    return x.groupBy(key).agg((F.stddev_samp("daily_return") * 100).alias("volatility_pct"))


def price_extremes(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.groupBy(key).agg(F.max("high").alias("highest_price"),
                               F.min("low").alias("lowest_price"),
                               F.avg("volume").cast("long").alias("average_volume"))


def price_range_pct(df: DataFrame, key: str = "symbol") -> DataFrame:
    x = price_extremes(df, key)
    rng = F.col("highest_price") - F.col("lowest_price")
    return x.select(key, "highest_price", "lowest_price", rng.alias("price_range"),
                    (safe_div(rng, F.col("lowest_price")) * 100).alias("price_range_pct"))


def latest_bar(df: DataFrame, key: str = "symbol") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "date").alias("_l")) \
        .select(key, "_l.*")


def latest_quote(df: DataFrame, key: str = "symbol",
                 chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Current price, previous close, open, day high/low and volume."""
    s = seq.chunked(df, key, "date", back=1, chunk_rows=chunk_rows)
    x = seq.drop_halo(s.select("*", F.lag("close").over(seq.window(key)).alias("_prev")))
    last = F.max_by(F.struct("date", "close", "_prev", "open", "high", "low", "volume"),
                    "date")
    return x.groupBy(key).agg(last.alias("_l")).select(
        key, F.col("_l.date").alias("date"), F.col("_l.close").alias("current_price"),
        F.col("_l._prev").alias("previous_close"), F.col("_l.open").alias("open"),
        F.col("_l.high").alias("day_high"), F.col("_l.low").alias("day_low"),
        F.col("_l.volume").alias("volume"))


def tail_n(df: DataFrame, n: int = 100, key: str = "symbol") -> DataFrame:
    """Last ``n`` rows of every symbol (top-k per group by position)."""
    s = seq.with_position(df, key, "date")
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return seq.join_on_key(s, counts, [key], "inner").filter(F.col(seq.RN) >= F.col("_n") - n).select(*df.columns)


def recent_return(df: DataFrame, n: int = 20, key: str = "symbol") -> DataFrame:
    """Return over the last ``n`` rows ((n-1) steps), in percent."""
    t = tail_n(df, n, key)
    return t.groupBy(key).agg(F.min_by("close", "date").alias("_f"),
                              F.max_by("close", "date").alias("_l")) \
        .select(key, pct("_l", "_f").alias("recent_return_pct"))


def duplicate_count(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows whose (symbol, date) occurred before."""
    return df.groupBy(key).agg(
        (F.count(F.lit(1)) - F.count_distinct("date")).alias("duplicates"))


def trend_signal(value: str, level: str) -> F.Column:
    return (F.when(F.col(level).isNull(), F.lit("N/A"))
            .when(F.col(value) > F.col(level), F.lit("Above")).otherwise(F.lit("Below")))


def rsi_signal(c: str = "rsi") -> F.Column:
    return signal_when(c, S.RSI_OVERBOUGHT, S.RSI_OVERSOLD, "Overbought", "Oversold",
                       "Neutral")


def bollinger_signal(c: str = "bb_position") -> F.Column:
    return signal_when(c, S.BB_UPPER_SIGNAL, S.BB_LOWER_SIGNAL, "Near Upper Band",
                       "Near Lower Band", "Mid-Range")


def trend_signals(features: DataFrame, key: str = "symbol") -> DataFrame:
    last = latest_bar(features.select(key, "date", "close", "ma_20", "ma_50"), key)
    return last.select(key, "ma_20", "ma_50",
                       trend_signal("close", "ma_20").alias("current_vs_ma20"),
                       trend_signal("close", "ma_50").alias("current_vs_ma50"))


def _last_indicators(bars: DataFrame, names: list[str], key: str, chunk_rows: int, full: bool
                     ) -> tuple[DataFrame, DataFrame]:
    """(symbol, _l): the newest bar's indicators, and the tail they came from.

    An indicator of the newest bar reads the longest window and what the
    exponential averages have not forgotten, not the whole history.
    """
    from tickforge.operators.features import MACD_HALO, rolling_indicators, technical_features
    from tickforge.session import cut_lineage
    reach = MACD_HALO + max(S.MA_WINDOWS) if full else max(S.MA_WINDOWS)
    tail = cut_lineage(tail_n(bars, reach, key))
    f = technical_features(tail, key, chunk_rows) if full else rolling_indicators(tail, key, chunk_rows)
    return f.groupBy(key).agg(F.max_by(F.struct(*names), "date").alias("_l")), tail


def analyze_symbols(bars: DataFrame, preprocess: bool = True, key: str = "symbol",
                    chunk_rows: int = seq.DEFAULT_CHUNK_ROWS, materialize: bool = True
                    ) -> DataFrame:
    """One analysis row per symbol, for all symbols in one job.

    Returns, volatility and extremes read every bar; the indicators, of which
    only the newest values are reported, are computed on the tail of each symbol.
    """
    from tickforge.operators.clean import full_pipeline
    from tickforge.session import cut_lineage
    x = full_pipeline(bars, add_features=False, key=key, chunk_rows=chunk_rows,
                      materialize=materialize) if preprocess else bars
    x = x.select(key, "date", "open", "high", "low", "close", "volume")
    x = cut_lineage(x) if materialize else x
    last_cols = ["close", "ma_20", "ma_50"] + (
        ["rsi", "macd", "macd_signal", "macd_histogram", "bb_position"] if preprocess else [])
    last, tail = _last_indicators(x, last_cols, key, chunk_rows, preprocess)
    summary = with_daily_return(x, key, chunk_rows).groupBy(key).agg(
        F.min_by("close", "date").alias("_first_close"),
        F.max("date").alias("latest_date"), F.min("date").alias("start_date"),
        F.count(F.lit(1)).alias("total_records"),
        (F.stddev_samp("daily_return") * 100).alias("_vol"),
        F.max("high").alias("highest_price"), F.min("low").alias("lowest_price"),
        F.avg("volume").cast("long").alias("average_volume"))
    recent = recent_return(tail.select(key, "date", "close"), 20, key)
    out = seq.join_on_key(seq.join_on_key(summary, last, [key]), recent, [key])
    cols = [key, F.col("_l.close").alias("latest_price"), "latest_date", "total_records",
            "start_date", F.col("latest_date").alias("end_date"),
            F.round(pct("_l.close", "_first_close"), 2).alias("total_return_percent"),
            F.round("recent_return_pct", 2).alias("recent_20d_return_percent"),
            F.round("_vol", 2).alias("volatility_percent"),
            "highest_price", "lowest_price", "average_volume",
            F.col("_l.ma_20").alias("ma_20"), F.col("_l.ma_50").alias("ma_50"),
            trend_signal("_l.close", "_l.ma_20").alias("current_vs_ma20"),
            trend_signal("_l.close", "_l.ma_50").alias("current_vs_ma50")]
    if preprocess:
        cols += [F.col("_l.rsi").alias("rsi"), rsi_signal("_l.rsi").alias("rsi_signal"),
                 F.col("_l.macd").alias("macd"), F.col("_l.macd_signal").alias("macd_signal"),
                 F.col("_l.macd_histogram").alias("macd_histogram"),
                 F.col("_l.bb_position").alias("bollinger_position"),
                 bollinger_signal("_l.bb_position").alias("bollinger_signal")]
    return out.select(*cols)


def freshness(df: DataFrame, as_of, key: str = "symbol", fresh_days: int = S.FRESH_DAYS
              ) -> DataFrame:
    """Whole days since the last bar (floor of elapsed time), fresh flag, count."""
    as_of_col = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, F.Column) \
        else as_of
    x = df.groupBy(key).agg(F.max("date").alias("last_date"),
                            F.count(F.lit(1)).alias("record_count"))
    # elapsed seconds on the wall-clock values: independent of the session zone
    secs = F.timestamp_diff("SECOND", F.col("last_date"), as_of_col)
    days = F.floor(secs / 86400).cast("long")
    return x.select(key, "last_date", "record_count", days.alias("days_old"),
                    (days <= fresh_days).alias("is_fresh"))


def pipeline_audit(raw: DataFrame, key: str = "symbol",
                   chunk_rows: int = seq.DEFAULT_CHUNK_ROWS, counters: dict | None = None) -> DataFrame:
    """Per symbol and step: (symbol, step, metric, value) of the full pipeline;
    dates are days since 1970.

    A dict given as ``counters`` gets the totals of the whole run (rows and nulls
    after cleaning, after the outliers and with all features), observed while the
    steps' tables are written, so they cost no scan.
    """
    from tickforge.operators.clean import clean_bars, iqr_fences, outlier_counts, outliers_iqr
    from tickforge.operators.features import TECHNICAL_COLUMNS, technical_features
    from tickforge.session import cut_lineage
    value_cols = [c for c in raw.columns if c not in (key,)]
    price_cols = [c for c in S.BAR_COLS if c != key]

    def nulls(df, cols):
        return reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in cols])

    def totals(rows, empty, columns):
        return {rows: F.count(F.lit(1)), empty: nulls(None, columns)}

    clean = cut_lineage(clean_bars(raw, key, chunk_rows=chunk_rows), counters,
                        totals("remaining_rows", "remaining_nulls", price_cols))
    s1 = raw.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.lit(float(len(raw.columns))).alias("columns"),
        nulls(raw, value_cols).cast("double").alias("null_values"),
        (F.count(F.lit(1)) - F.count_distinct("date")).cast("double").alias("duplicates"))
    s2 = clean.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("remaining_rows"),
        nulls(clean, price_cols).cast("double").alias("remaining_nulls"))
    s12 = s1.join(s2, key, "left").select(
        key, "rows", "columns", "null_values", "duplicates", "remaining_rows",
        "remaining_nulls",
        (F.col("rows") - F.coalesce(F.col("remaining_rows"), F.lit(0.0))).alias("removed_rows"),
        (F.col("null_values") - F.coalesce(F.col("remaining_nulls"), F.lit(0.0))).alias("filled_nulls"))
    fences = cut_lineage(iqr_fences(clean, key=key))
    s3 = outlier_counts(clean, key=key, fences=fences)
    cleaned = cut_lineage(outliers_iqr(clean, key=key, fences=fences), counters,
                          totals("rows_after_outliers", "nulls_after_outliers", price_cols))
    feats = cut_lineage(technical_features(cleaned, key, chunk_rows), counters,
                        totals("feature_rows", "final_nulls", [*price_cols, *TECHNICAL_COLUMNS]))
    s4 = feats.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("feature_rows"),
        nulls(feats, [*price_cols, *TECHNICAL_COLUMNS]).cast("double").alias("final_nulls"),
        F.avg("close").alias("close_mean"), F.stddev_samp("close").alias("close_std"),
        F.min("close").alias("close_min"), F.max("close").alias("close_max"),
        F.unix_date(F.min("date").cast("date")).cast("double").alias("first_day"),
        F.unix_date(F.max("date").cast("date")).cast("double").alias("last_day"))

    def melt(df, step, metrics):
        return df.select(key, F.lit(step).alias("step"), F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics])).alias("_m")).select(key, "step", "_m.metric", "_m.value")

    parts = [
        melt(s12, "1. Data Validation", ["rows", "columns", "null_values", "duplicates"]),
        melt(s12, "2. Data Cleaning", ["removed_rows", "filled_nulls", "remaining_rows", "remaining_nulls"]),
        melt(s3, "3. Outlier Handling", [f"outliers_{c}" for c in S.PRICE_COLS]
             + ["outliers_total"]),
        melt(s4.withColumn("features_added", F.lit(float(len(TECHNICAL_COLUMNS)))),
             "4. Feature Engineering", ["features_added", "feature_rows"]),
        melt(s4, "5. Normalization", ["close_mean", "close_std", "close_min", "close_max"]),
        melt(s4.withColumn("quality_excellent",
                           (F.col("final_nulls") == 0).cast("double")),
             "6. Final Quality", ["final_nulls", "quality_excellent", "first_day", "last_day"]),
    ]
    return reduce(DataFrame.unionByName, parts)
