"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)``, reads the test tables (or bars Spark derives
from them) in full, and returns a DataFrame whose doubles are rounded by the
policy shared with the oracle SQL (``rounding``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge import schema as S
from tickforge.operators import analytics as A
from tickforge.operators import clean as C
from tickforge.operators import evaluate as E
from tickforge.operators import features as FE
from tickforge.operators import forecast as FC
from tickforge.operators import market as M
from tickforge.operators import merge as MG
from tickforge.plans.rounding import round_doubles
from tickforge.session import scratch_path
from tickforge.sources import bars as B
from tickforge.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str, rounding: dict | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), rounding)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def nation(spark, d):
    return fx.bars_nation(spark, d)


def dirty(spark, d):
    return fx.quotes_dirty(spark, d)


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _scratch(spark, d, name):
    tag = hashlib.sha1(d.encode()).hexdigest()[:10]
    return scratch_path(spark, f"{name}-{tag}")


# --- 2.1 scans / sources ---------------------------------------------------

@query("resample_bars")
def q_resample_bars(spark, d):
    """Ticks (events) -> hourly bars per event type."""
    return fx.bars_event(spark, d)


@query("resample_weekly")
def q_resample_weekly(spark, d):
    """Daily nation bars -> weekly bars (Monday start)."""
    return B.resample_bars(nation(spark, d), "1wk")


@query("resample_monthly")
def q_resample_monthly(spark, d):
    return B.resample_bars(nation(spark, d), "3mo")


@query("scan_bars_csv")
def q_scan_bars_csv(spark, d):
    """Bars written as CSV per symbol folder, read back by the multi-file scan."""
    path = _scratch(spark, d, "bars-csv")
    MG.sort_bars(nation(spark, d)).write.mode("overwrite").partitionBy("symbol") \
        .option("header", True).csv(path)
    return B.scan_bars_csv(spark, path).select(*S.BAR_COLS)


@query("scan_single_symbol")
def q_scan_single_symbol(spark, d):
    path = _scratch(spark, d, "bars-csv-single")
    nation(spark, d).write.mode("overwrite").partitionBy("symbol") \
        .option("header", True).csv(path)
    return B.scan_single_symbol(spark, path, "NATION_7")


@query("scan_csv_validated")
def q_scan_csv_validated(spark, d):
    """Files with two column orders and name sets, NaN text, a header-only file and
    a file that is no symbol, scanned by header and validated."""
    root = _fresh(spark, "bars-csv-mixed")
    text = [F.col(c).cast("string").alias(c) for c in ("date", "open", "high", "low", "close")]
    bars = nation(spark, d).select("symbol", *text, F.when(F.dayofmonth("date") == 13, "NaN").otherwise(
        F.col("volume").cast("string")).alias("volume"))
    odd = F.length("symbol") % 2 == 1
    other = bars.where(odd).select("symbol", F.col("close").alias("Close "), F.col("date").alias("Timestamp"),
                                   F.col("low").alias("LOW"), F.col("volume").alias("Quantity"),
                                   F.col("open").alias("opening"), F.col("high").alias("High"))
    rest = bars.where(~odd).unionByName(bars.limit(0))
    info = bars.select(F.lit("stock_metadata").alias("symbol"), F.col("close").alias("date"),
                       F.lit("x").alias("industry")).limit(3)
    for part in (info, other, rest):
        part.write.mode("append").partitionBy("symbol").option("header", True).csv(root)
    bars.limit(0).drop("symbol").coalesce(1).write.option("header", True).csv(root + "/symbol=EMPTY")
    return B.scan_csv_validated(spark, root)[0].select(*S.BAR_COLS)


@query("validate_partition")
def q_validate_partition(spark, d):
    """Dirty quotes with null keys and exact re-deliveries: every row is either
    a bar or a reject, counted per symbol and outcome."""
    q = dirty(spark, d)
    again = q.where("ingest_seq % 7 = 0")
    lost = q.where("ingest_seq % 11 = 0").withColumns({
        "symbol": F.when(F.col("ingest_seq") % 2 == 0, F.col("symbol")),
        "date": F.when(F.col("ingest_seq") % 3 == 0, F.col("date"))})
    good, bad = C.validate(q.unionByName(again).unionByName(lost))
    both = good.withColumn("reject_reason", F.lit("kept")).unionByName(bad)
    return both.groupBy("symbol", "reject_reason").agg(F.count("*").alias("n"))


@query("union_symbols")
def q_union_symbols(spark, d):
    return B.union_symbols(nation(spark, d),
                           fx.bars_priority(spark, d).withColumn("series", F.lit("EQ")))


@query("list_symbols")
def q_list_symbols(spark, d):
    return B.list_symbols(B.union_symbols(nation(spark, d), fx.bars_priority(spark, d)))


def _sources(spark, d):
    o = fx.table(spark, d, "orders")
    open_feed = fx._bars(o.filter(F.col("o_orderstatus") == "O"), "o_orderpriority",
                         F.col("o_orderdate"), "o_totalprice", "o_orderkey")
    return [("feed_open", open_feed), ("feed_all", fx.bars_priority(spark, d)),
            ("feed_nation", nation(spark, d))]


@query("source_failover")
def q_source_failover(spark, d):
    return B.source_failover(_sources(spark, d))


@query("source_health")
def q_source_health(spark, d):
    return B.source_health(_sources(spark, d), spark)


@query("symbol_normalise")
def q_symbol_normalise(spark, d):
    syms = B.union_symbols(nation(spark, d), fx.bars_priority(spark, d)).select("symbol") \
        .distinct()
    return syms.select("symbol", B.normalise_symbol("symbol").alias("normalised"),
                       B.strip_suffix(B.normalise_symbol("symbol")).alias("base_symbol"))


@query("known_symbols")
def q_known_symbols(spark, d):
    bars = B.union_symbols(nation(spark, d), fx.bars_priority(spark, d))
    return B.known_symbols(bars, fx.symbol_dimension(spark, d))


@query("unknown_symbols")
def q_unknown_symbols(spark, d):
    bars = B.union_symbols(nation(spark, d), fx.bars_priority(spark, d))
    return B.unknown_symbols(bars, fx.symbol_dimension(spark, d))


@query("period_slice")
def q_period_slice(spark, d):
    return B.period_slice(nation(spark, d), "1y")


@query("period_range")
def q_period_range(spark, d):
    return B.period_slice(nation(spark, d), None, "1995-01-01", "1996-07-01")


# --- 2.2 validation / cleaning ---------------------------------------------

def raw_quotes(spark, d):
    """Quotes as a CSV would give them: odd names, strings."""
    q = dirty(spark, d)
    return q.select(F.col("symbol").alias(" Ticker "), F.col("date").cast("string").alias("Timestamp"),
                    F.col("open").cast("string").alias("Opening"),
                    F.col("high").cast("string").alias("HIGHEST"),
                    F.col("low").cast("string").alias("low_price"),
                    F.col("close").cast("string").alias("Last"),
                    F.col("volume").cast("string").alias("Vol"),
                    F.col("ingest_seq"))


@query("standardise_columns")
def q_standardise(spark, d):
    q = dirty(spark, d)
    return C.standardise_columns(q.select(
        F.col("symbol").alias(" Ticker "), F.col("date").alias("Timestamp"),
        F.col("open").alias("Opening"), F.col("high").alias("HIGHEST"),
        F.col("low").alias("low_price"), F.col("close").alias("Last"),
        F.col("volume").alias("Vol"), "ingest_seq"))


@query("map_synonyms")
def q_map_synonyms(spark, d):
    return C.cast_types(C.map_synonyms(C.standardise_columns(raw_quotes(spark, d))))


@query("default_symbol")
def q_default_symbol(spark, d):
    x = C.map_synonyms(C.standardise_columns(raw_quotes(spark, d).drop(" Ticker ")))
    return C.cast_types(C.default_symbol(x))


@query("cast_types")
def q_cast_types(spark, d):
    x = C.map_synonyms(C.standardise_columns(raw_quotes(spark, d)))
    return C.cast_types(x)


@query("null_report")
def q_null_report(spark, d):
    return C.null_report(dirty(spark, d))


@query("filter_price_relationships")
def q_filter_price(spark, d):
    return C.filter_price_relationships(dirty(spark, d))


@query("check_negative_volume")
def q_negative_volume(spark, d):
    q = dirty(spark, d)
    return C.check_negative_volume(q.withColumn("volume", F.col("volume") - 500))


@query("dedup_keep_last")
def q_dedup_keep_last(spark, d):
    return C.dedup_keep_last(dirty(spark, d))


@query("dedup_full_row")
def q_dedup_full_row(spark, d):
    q = dirty(spark, d).drop("ingest_seq")
    return C.dedup_full_row(q.unionByName(q.filter(F.col("volume") < 100)))


@query("drop_null_critical")
def q_drop_null(spark, d):
    return C.drop_null_critical(dirty(spark, d))


@query("filter_positive_close")
def q_pos_close(spark, d):
    return C.filter_positive_close(dirty(spark, d))


@query("filter_positive_ohlc")
def q_pos_ohlc(spark, d):
    return C.filter_positive_ohlc(dirty(spark, d))


@query("fill_prices")
def q_fill_prices(spark, d):
    return C.fill_prices(C.dedup_keep_last(dirty(spark, d)).drop("ingest_seq"))


@query("fill_volume_median")
def q_fill_volume(spark, d):
    return C.fill_volume_median(dirty(spark, d))


@query("repair_ohlc")
def q_repair(spark, d):
    return C.repair_ohlc(dirty(spark, d))


@query("clean_bars")
def q_clean_bars(spark, d):
    return C.clean_bars(dirty(spark, d))


@query("clean_spark_bars")
def q_clean_spark_bars(spark, d):
    return C.clean_spark_bars(raw_quotes(spark, d).select(
        F.col(" Ticker ").alias("Symbol"), F.col("Timestamp").alias("Date"),
        F.col("Opening").alias("Open"), F.col("HIGHEST").alias("High"),
        F.col("low_price").alias("Low"), F.col("Last").alias("Close"),
        F.col("Vol").alias("Volume")))


@query("validate_bars")
def q_validate(spark, d):
    return C.validate_bars(raw_quotes(spark, d))


@query("validate_rejects")
def q_validate_rejects(spark, d):
    return C.validate(raw_quotes(spark, d))[1]


@query("outliers_iqr")
def q_outliers_iqr(spark, d):
    return C.outliers_iqr(C.clean_bars(dirty(spark, d)))


@query("outliers_zscore")
def q_outliers_z(spark, d):
    return C.outliers_zscore(C.clean_bars(dirty(spark, d)))


@query("outlier_counts")
def q_outlier_counts(spark, d):
    return C.outlier_counts(C.clean_bars(dirty(spark, d)))


# Clipped prices give these means up to 10 exact decimals; at 2 decimals an
# exact tie needs 6+ trailing digits "50..0" (~1e-6), far above the float noise.
FINE_MEANS = {"ma_5": 1, "ma_10": 1, "ma_20": 2, "ma_50": 2, "ma_200": 2, "bb_middle": 2}


@query("full_pipeline", FINE_MEANS)
def q_full_pipeline(spark, d):
    return C.full_pipeline(dirty(spark, d))


# --- 2.3 indicators ----------------------------------------------------------

def _feature_cols(cols):
    def q(spark, d):
        return FE.technical_features(nation(spark, d)).select(*S.BAR_COLS, *cols)
    return q


for _name, _cols in {
        "daily_return": ["daily_return"], "log_return": ["log_return"],
        "moving_average": [f"ma_{n}" for n in S.MA_WINDOWS],
        "ma_ratio": [f"ma_{n}_ratio" for n in S.MA_WINDOWS],
        "bollinger": ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position"],
        "rsi": ["rsi"], "volatility_return": ["volatility_20", "volatility_50"],
        "volume_ma_ratio": ["volume_ma_20", "volume_ratio"],
        "momentum": [f"momentum_{n}" for n in S.MOMENTUM_PERIODS],
        "roc": [f"roc_{n}" for n in S.MOMENTUM_PERIODS],
        "range_ratios": ["hl_ratio", "oc_ratio"]}.items():
    def _mk(cols):
        def q(spark, d):
            return FE.rolling_indicators(nation(spark, d)).select(*S.BAR_COLS, *cols)
        return q
    query(_name)(_mk(_cols))


@query("ema")
def q_ema(spark, d):
    return FE.ema(nation(spark, d), "close", 12, "ema_12")


@query("macd")
def q_macd(spark, d):
    return FE.macd(nation(spark, d))


@query("technical_features")
def q_technical_features(spark, d):
    return FE.technical_features(nation(spark, d))


def _model_cols(cols):
    def q(spark, d):
        return FE.model_features(nation(spark, d)).select("symbol", "date", *cols)
    return q


for _name, _cols in {
        "pct_change_n": ["return_1d", "return_5d", "return_20d"],
        "ma_cross_ratios": ["close_to_ma5", "close_to_ma20", "ma5_to_ma20"],
        "price_volatility": ["volatility_5d", "volatility_20d"],
        "lag_features": [f"{c}_lag_{k}" for k in S.MODEL_LAGS for c in ("close", "volume")],
        "next_close_target": ["close", "target"]}.items():
    query(_name)(_model_cols(_cols))


@query("model_features")
def q_model_features(spark, d):
    return FE.model_features(nation(spark, d))


@query("min_history_filter")
def q_min_history(spark, d):
    return FE.min_history_filter(nation(spark, d), S.MIN_HISTORY)


# --- 2.4 summaries -------------------------------------------------------------

@query("date_range")
def q_date_range(spark, d):
    return A.date_range(nation(spark, d))


@query("data_summary")
def q_data_summary(spark, d):
    return A.data_summary(dirty(spark, d)).withColumn(
        "missing_values", F.to_json("missing_values"))


@query("price_stats")
def q_price_stats(spark, d):
    return A.price_stats(nation(spark, d))


@query("total_return")
def q_total_return(spark, d):
    return A.total_return(nation(spark, d))


@query("recent_return")
def q_recent_return(spark, d):
    return A.recent_return(nation(spark, d), 20)


@query("volatility")
def q_volatility(spark, d):
    return A.volatility(nation(spark, d))


@query("price_extremes")
def q_price_extremes(spark, d):
    return A.price_extremes(nation(spark, d))


@query("price_range_pct")
def q_price_range(spark, d):
    return A.price_range_pct(nation(spark, d))


@query("latest_bar")
def q_latest_bar(spark, d):
    return A.latest_bar(nation(spark, d))


@query("latest_quote")
def q_latest_quote(spark, d):
    return A.latest_quote(nation(spark, d))


@query("tail_n")
def q_tail_n(spark, d):
    return A.tail_n(nation(spark, d), 100)


@query("trend_signals")
def q_trend(spark, d):
    return A.trend_signals(FE.rolling_indicators(nation(spark, d)))


@query("rsi_signal")
def q_rsi_signal(spark, d):
    f = FE.rolling_indicators(nation(spark, d)).select("symbol", "date", "rsi")
    return f.select("symbol", "date", "rsi", A.rsi_signal("rsi").alias("rsi_signal"))


@query("bollinger_signal")
def q_bb_signal(spark, d):
    f = FE.rolling_indicators(nation(spark, d)).select("symbol", "date", "bb_position")
    return f.select("symbol", "date", "bb_position",
                    A.bollinger_signal("bb_position").alias("bollinger_signal"))


@query("analyze_symbols")
def q_analyze(spark, d):
    return A.analyze_symbols(nation(spark, d), preprocess=True)


@query("analyze_symbols_raw")
def q_analyze_raw(spark, d):
    return A.analyze_symbols(nation(spark, d), preprocess=False)


@query("freshness")
def q_freshness(spark, d):
    return A.freshness(nation(spark, d), "1998-08-10 12:00:00")


@query("pipeline_audit")
def q_audit(spark, d):
    return A.pipeline_audit(dirty(spark, d).drop("ingest_seq"))


@query("pipeline_counters")
def q_counters(spark, d):
    """Totals of the run, observed while its tables are written."""
    counters = {}
    A.pipeline_audit(dirty(spark, d).drop("ingest_seq"), counters=counters)
    names = ["remaining_rows", "remaining_nulls", "feature_rows", "final_nulls"]
    return spark.createDataFrame([(c, int(counters[c])) for c in names], "counter string, value long")


@query("duplicate_count")
def q_dups(spark, d):
    return A.duplicate_count(dirty(spark, d))


# --- 2.5 joins, 2.6 sort / top-k, 2.7 market ----------------------------------

@query("sector_join")
def q_sector_join(spark, d):
    return M.sector_join(A.total_return(nation(spark, d)), fx.sectors(spark, d))


@query("industry_join")
def q_industry_join(spark, d):
    return M.industry_join(A.latest_bar(nation(spark, d)), fx.symbol_dimension(spark, d))


@query("merge_bars")
def q_merge(spark, d):
    n = nation(spark, d)
    existing = n.filter(F.col("date") < "1997-01-01")
    new = n.filter(F.col("date") >= "1996-07-01").withColumn("close", F.col("close") + 1)
    return MG.merge_bars(existing, new)


@query("upsert_bars")
def q_upsert(spark, d):
    """The same batch merged into a stored bar table, of which it touches a part."""
    n, path = nation(spark, d), _fresh(spark, "bar-table")
    MG.write_bar_table(n.filter(F.col("date") < "1997-01-01"), path)
    MG.upsert_bars(spark, path, n.filter(F.col("date") >= "1996-07-01").withColumn("close", F.col("close") + 1))
    return MG.read_bar_table(spark, path, n.schema)


@query("sort_bars")
def q_sort(spark, d):
    return MG.sort_bars(nation(spark, d))


def drift30(spark, d):
    return FC.drift_forecast(nation(spark, d), 30)


@query("drift_forecast")
def q_drift(spark, d):
    return drift30(spark, d)


@query("forecast_spine")
def q_spine(spark, d):
    last = nation(spark, d).groupBy("symbol").agg(F.max("date").alias("last_date"))
    return FC.forecast_spine(last, 30)


@query("predicted_change")
def q_pred_change(spark, d):
    return M.predicted_change(drift30(spark, d), nation(spark, d))


@query("confidence_label")
def q_confidence(spark, d):
    ch = M.predicted_change(drift30(spark, d), nation(spark, d))
    return ch.select("symbol", "days", M.confidence_label("days").alias("confidence"))


@query("top_gainers")
def q_gainers(spark, d):
    return M.top_movers(M.predicted_change(drift30(spark, d), nation(spark, d)))[0]


@query("top_losers")
def q_losers(spark, d):
    return M.top_movers(M.predicted_change(drift30(spark, d), nation(spark, d)))[1]


@query("sector_performance")
def q_sector_perf(spark, d):
    ch = M.predicted_change(drift30(spark, d), nation(spark, d))
    return M.sector_performance(ch, fx.sectors(spark, d))


@query("market_sentiment")
def q_sentiment(spark, d):
    return M.market_sentiment(M.predicted_change(drift30(spark, d), nation(spark, d)))


@query("market_analysis")
def q_market(spark, d):
    """Per symbol: predicted change, confidence, sector (the market view rows)."""
    res = M.market_analysis(drift30(spark, d), nation(spark, d), fx.sectors(spark, d))
    return res["changes"].join(fx.sectors(spark, d), "symbol", "left")


# --- 2.8 evaluation ------------------------------------------------------------

def pairs(spark, d):
    """Drift fitted on the first 80 % of each symbol, scored on the rest."""
    n = nation(spark, d)
    sp = FC.temporal_split(n)
    train = sp.filter("is_train").drop("is_train")
    fit = FC.drift_fit(train)
    test = sp.filter(~F.col("is_train")).select("symbol", "date", F.col("close").alias("actual"))
    from tickforge.operators import sequence as seq
    t = seq.with_position(test, "symbol", "date")
    j = t.join(fit.select("symbol", "last_close", "drift"), "symbol")
    return j.select("symbol", "date", "actual",
                    (F.col("last_close") + (F.col(seq.RN) + 1) * F.col("drift")).alias("predicted"))


@query("align_actual_forecast")
def q_align(spark, d):
    return pairs(spark, d)


@query("regression_metrics")
def q_reg_metrics(spark, d):
    return E.regression_metrics(pairs(spark, d))


@query("mape")
def q_mape(spark, d):
    return E.mape(pairs(spark, d))


@query("direction_metrics")
def q_direction(spark, d):
    return E.direction_metrics(pairs(spark, d))


@query("classification_metrics")
def q_classification(spark, d):
    return E.classification_metrics(E.direction_metrics(pairs(spark, d)))


@query("accuracy_vs_price")
def q_accuracy(spark, d):
    return E.accuracy_vs_price(pairs(spark, d))


@query("temporal_split")
def q_temporal_split(spark, d):
    return FC.temporal_split(nation(spark, d))


@query("random_split")
def q_random_split(spark, d):
    return FC.random_split(nation(spark, d))


@query("stationarity", {"gamma": 8, "adf_stat": 6})
def q_stationarity(spark, d):
    return FC.stationarity(nation(spark, d))


@query("ar_forecast")
def q_ar(spark, d):
    return FC.ar_forecast(nation(spark, d), 30, d=1)


@query("ar_fit", {"phi": 6, "c": 2, "sigma2": -6, "aic": 4, "bic": 4})
def q_ar_fit(spark, d):
    return FC.ar_fit(nation(spark, d), d=0)


@query("best_model")
def q_best_model(spark, d):
    """Best of ARIMA(p, d, q) and seasonal-trend per symbol (the defaults)."""
    return E.best_model(FC.evaluate_models(nation(spark, d)), "rmse")


@query("best_model_drift_ar")
def q_best_model_drift_ar(spark, d):
    return E.best_model(FC.evaluate_models(nation(spark, d), ("drift", "ar")), "rmse")


@query("select_and_forecast")
def q_select(spark, d):
    """The best of the default models per symbol, refit and forecast."""
    return FC.select_and_forecast(nation(spark, d), 30)


@query("select_and_forecast_drift_ar")
def q_select_drift_ar(spark, d):
    return FC.select_and_forecast(nation(spark, d), 30, ("drift", "ar"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


# --- 2.10 sinks (write, then read back) ---------------------------------------

from tickforge.sources import sinks as SK  # noqa: E402


@query("write_bars")
def q_write_bars(spark, d):
    path = SK.write_bars(nation(spark, d), _fresh(spark, "bars-parquet"))
    return spark.read.parquet(path).select(*S.BAR_COLS)


@query("write_csv")
def q_write_csv(spark, d):
    path = SK.write_csv(nation(spark, d), _fresh(spark, "bars-plain-csv"))
    return spark.read.schema(S.BAR_SCHEMA).option("header", True).csv(path)


@query("write_metrics")
def q_write_metrics(spark, d):
    path = SK.write_metrics(E.regression_metrics(pairs(spark, d)), _fresh(spark, "metrics-json"))
    return spark.read.schema("symbol string, n long, rmse double, mae double, mse double, "
                             "r2 double").json(path)


# --- 2.11 streaming ---------------------------------------------------------------

from tickforge.streaming import ingest as ST  # noqa: E402


def _land(df: DataFrame, path: str, files: int, order: str) -> str:
    """Write a table as several files, in order, like batches landing."""
    df.repartitionByRange(files, order).write.mode("overwrite").parquet(path)
    return path


@query("stream_ingest")
def q_stream_ingest(spark, d):
    """Dirty quotes landing as files -> validated keep-last table."""
    root = _fresh(spark, "stream-ingest")
    q = dirty(spark, d)
    src = _land(q, root + "/in", 4, "ingest_seq")
    return ST.stream_ingest(spark, src, root + "/out", q.schema, max_files_per_trigger=1)


@query("stream_resample")
def q_stream_resample(spark, d):
    """Event ticks landing as files -> hourly bars (equals the batch bars)."""
    root = _fresh(spark, "stream-resample")
    ev = fx.table(spark, d, "events")
    src = _land(ev, root + "/in", 4, "ts")
    return ST.stream_resample(spark, src, root + "/out", ev.schema, max_files_per_trigger=1)


def _land_in_order(df: DataFrame, path: str, column: str, cuts: list[str]) -> str:
    """Files that land one after the other, cut at the given values."""
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = df.where((F.lit(True) if lo is None else F.col(column) >= lo) & (F.lit(True) if hi is None else F.col(column) < hi))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _closed(spark, d):
    """Events landing by week, then those of the first day again: too late."""
    root, ev = _fresh(spark, "stream-closed"), fx.table(spark, d, "events")
    src = _land_in_order(ev, root + "/in", "ts", ["2024-01-08", "2024-01-15", "2024-01-22"])
    ev.where("ts < '2024-01-02'").coalesce(1).write.mode("append").parquet(src)
    return ST.stream_resample_closed(spark, src, root + "/out", ev.schema, max_files_per_trigger=1)


@query("stream_resample_closed")
def q_stream_closed(spark, d):
    """Windows that the watermark has passed, each emitted once."""
    return _closed(spark, d)[0]


@query("stream_late_rows")
def q_stream_late(spark, d):
    """The ticks that came after their window had been emitted."""
    return _closed(spark, d)[1].select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")


@query("stream_ingest_redelivery")
def q_stream_redelivery(spark, d):
    """Dirty quotes landing twice; the second delivery is not written again."""
    root, q = _fresh(spark, "stream-again"), dirty(spark, d)
    src = _land(q, root + "/in", 4, "ingest_seq")
    q.where("ingest_seq % 3 = 0").coalesce(1).write.mode("append").parquet(src)
    return ST.stream_ingest(spark, src, root + "/out", q.schema, max_files_per_trigger=1, redelivery="1 day")


# --- 2.9 models ---------------------------------------------------------------------

from tickforge.operators import ml as ML  # noqa: E402


#: Folder of the trained model by session and tables.
_TRAINED: dict[tuple[str, str], str] = {}


def _gbt(spark, d) -> ML.Trained:
    """The model of these tables: trained once a session, saved with its test
    predictions in the shared folder and loaded by every query that uses it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRAINED:
        path = _fresh(spark, "gbt")
        trained = ML.gbt_train(FE.model_features(nation(spark, d)))
        ML.model_save(trained.model, path, trained.curve)
        trained.predictions.write.parquet(path + "/predictions")
        _TRAINED[key] = path
    path = _TRAINED[key]
    model, meta = ML.model_load(path)
    return ML.Trained(model, spark.read.parquet(path + "/predictions"), meta["curve"])


@query("prepare_for_modeling")
def q_prepare(spark, d):
    return ML.prepare_for_modeling(FE.model_features(nation(spark, d)))


@query("standard_scale")
def q_standard_scale(spark, d):
    x = ML.prepare_for_modeling(FE.model_features(nation(spark, d)))
    sp = FC.temporal_split(x)
    tr, te = ML.standard_scale(sp.filter("is_train"), sp.filter(~F.col("is_train")))
    arr = ML.scaled_array(te.select("symbol", "date", "scaled"))
    return arr.select("symbol", "date", *[F.col("scaled")[i].alias(f"z_{c}")
                                          for i, c in enumerate(FE.MODEL_FEATURES)])


@query("gbt_training_rows", {"label": 8})
def q_gbt_rows(spark, d):
    """What the trees learn from: one row a bar, its label and its part."""
    return ML.training_rows(FE.model_features(nation(spark, d))).select("symbol", "date", "actual", "label", "part")


@query("gbt_train")
def q_gbt_train(spark, d):
    return _gbt(spark, d).predictions


@query("gbt_validation_curve")
def q_gbt_curve(spark, d):
    """Error on the validation rows after every round, and which rounds are kept."""
    return ML.validation_curve(spark, _gbt(spark, d))


@query("gbt_forecast")
def q_gbt_forecast(spark, d):
    return ML.gbt_forecast(_gbt(spark, d).model, FE.model_features(nation(spark, d)), 30)


@query("gbt_forecast_spine")
def q_gbt_forecast_spine(spark, d):
    """Rows and dates of a saved and reloaded model's forecast; values are finite."""
    f = ML.gbt_forecast(_gbt(spark, d).model, FE.model_features(nation(spark, d)), 30)
    return f.select("symbol", "forecast_step", "date", (F.abs("predicted_value") < 1e12).alias("is_finite"))


@query("feature_importance")
def q_importance(spark, d):
    return ML.feature_importance(spark, _gbt(spark, d).model)


@query("top_features")
def q_top_features(spark, d):
    return ML.feature_importance(spark, _gbt(spark, d).model).limit(10)


@query("model_save_load")
def q_model_save_load(spark, d):
    trained = _gbt(spark, d)
    model, _ = ML.model_load(ML.model_save(trained.model, _fresh(spark, "gbt-model"), trained.curve))
    return ML.gbt_forecast(model, FE.model_features(nation(spark, d)), 30)


@query("gbt_metrics")
def q_gbt_metrics(spark, d):
    return E.regression_metrics(_gbt(spark, d).predictions)


def _end_to_end(bars, models):
    analysis = A.analyze_symbols(bars).select("symbol", "latest_price", "total_return_percent",
                                             "volatility_percent", "rsi_signal")
    return FC.select_and_forecast(bars, 30, models).join(analysis, "symbol")


@query("end_to_end")
def q_end_to_end(spark, d):
    """load -> preprocess -> analyse -> forecast with the default models, one row per
    symbol and step."""
    return _end_to_end(nation(spark, d), FC.DEFAULT_MODELS)


@query("end_to_end_drift_ar")
def q_end_to_end_drift_ar(spark, d):
    return _end_to_end(nation(spark, d), ("drift", "ar"))


@query("seasonal_trend_forecast")
def q_seasonal(spark, d):
    from tickforge.operators.seasonal import seasonal_trend_forecast
    return seasonal_trend_forecast(nation(spark, d), 30)


@query("model_params_save_load", {"phi": 6, "c": 2, "sigma2": -6, "aic": 4, "bic": 4})
def q_params_save_load(spark, d):
    """AR parameters written as a Parquet table and read back."""
    path = FC.save_params(FC.ar_fit(nation(spark, d), d=0), _fresh(spark, "ar-params"))
    return FC.load_params(spark, path)


@query("ar_order_select")
def q_ar_select(spark, d):
    from tickforge.operators.arima import arima_fit
    return arima_fit(nation(spark, d), max_q=0, d=1).select(
        "symbol", "p", "d", F.to_json("phi").alias("phi"), "c", "sigma2", "aic", "bic", "n_obs")


@query("arp_forecast")
def q_arp(spark, d):
    from tickforge.operators.arima import arima_forecast
    return arima_forecast(nation(spark, d), 30, max_q=0, d=1)


@query("arima_forecast")
def q_arima(spark, d):
    """ARIMA(p, d, q), every order chosen per symbol."""
    from tickforge.operators.arima import arima_forecast
    return arima_forecast(nation(spark, d), 30)


@query("arima_metrics")
def q_arima_metrics(spark, d):
    """Orders and in-sample errors, through the stored parameter table."""
    from tickforge.operators.arima import arima_fit
    path = FC.save_params(arima_fit(nation(spark, d)), _fresh(spark, "arima-params"))
    return FC.load_params(spark, path).select("symbol", "p", "d", "q", "aic", "bic", "n_obs", "rmse", "mae", "mape")


@query("adf_test")
def q_adf(spark, d):
    from tickforge.operators.arima import adf
    return adf(nation(spark, d))


@query("seasonal_metrics")
def q_seasonal_metrics(spark, d):
    from tickforge.operators.seasonal import seasonal_fit, seasonal_metrics
    n = nation(spark, d)
    return seasonal_metrics(n, seasonal_fit(n))


@query("select_and_forecast_all")
def q_select_all(spark, d):
    """Best of ARIMA(p, d, q) and seasonal-trend per symbol (the defaults)."""
    return FC.select_and_forecast(nation(spark, d), 30)


@query("sector_sets")
def q_sector_sets(spark, d):
    """The fixed sector sets joined to the symbols, renamed symbols mapped."""
    dim = M.sector_dimension(spark)
    renamed = spark.createDataFrame(list(S.SYMBOL_ALIASES.items()), "symbol string, alias string")
    n = nation(spark, d).select("symbol").distinct().withColumn("sector", F.lit("(none)"))
    known = dim.unionByName(n).join(renamed, "symbol", "left")
    return known.groupBy("sector").agg(F.count("*").alias("symbols"), F.count("alias").alias("renamed"))
