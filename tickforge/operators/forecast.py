"""Per-symbol forecasting for all symbols in one job.

Models are fitted from aggregate moments (``regr_*`` aggregates combine
partially before the shuffle), so a symbol's history is never gathered in one
task; forecasts are a per-symbol recursion over ``sequence(1, days)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickforge import schema as S
from tickforge.operators import sequence as seq
from tickforge.operators.evaluate import best_model, regression_metrics

Z95 = 1.959963984540054


def _days(days) -> F.Column:
    """An int horizon, or the name of a per-symbol horizon column."""
    return F.col(days) if isinstance(days, str) else F.lit(days)


def with_horizon(fit: DataFrame, horizon: DataFrame | None, key: str) -> DataFrame:
    """Attach a per-symbol ``_days`` column (symbols without one are dropped)."""
    if horizon is None:
        return fit
    return seq.join_on_key(fit, horizon.select(key, F.col("days").alias("_days")), [key], "inner")


def forecast_spine(last: DataFrame, days) -> DataFrame:
    """Next ``days`` calendar days after each symbol's ``last_date``; ``days``
    is an int or the name of a per-symbol column."""
    x = last.select("*", F.explode(F.sequence(F.lit(1), _days(days))).alias("forecast_step"))
    return x.withColumn("date", F.date_add(F.col("last_date"), F.col("forecast_step"))
                        .cast("timestamp_ntz")) \
            .withColumn("date_text", F.date_format("date", "yyyy-MM-dd"))


def temporal_split(df: DataFrame, fraction: float = S.TRAIN_FRACTION, key: str = "symbol"
                   ) -> DataFrame:
    """Flag the first ``floor(fraction * n)`` rows of every symbol as train."""
    s = seq.with_position(df, key, "date")
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    x = seq.join_on_key(s, n, [key], "inner")
    return x.withColumn("is_train", F.col(seq.RN) < F.floor(F.col("_n") * fraction)) \
            .drop(seq.RN, "_n")


def random_split(df: DataFrame, fraction: float = S.TRAIN_FRACTION, seed: int = 42,
                 key=S.KEY) -> DataFrame:
    """Hash split on the row key, stable under repartitioning and retries
    (leaks time; opt-in). Bucket = first 32 bits of md5(key text | seed) mod 100."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("is_train", h < int(round(fraction * 100)))


def _with_diff(df: DataFrame, key: str, value: str = "close") -> DataFrame:
    s = seq.chunked(df.select(key, "date", value), key, "date", back=2)
    w = seq.window(key)
    d = F.col(value) - F.lag(value, 1).over(w)
    d1 = F.lag(value, 1).over(w) - F.lag(value, 2).over(w)
    return seq.drop_halo(s.select("*", d.alias("_d"), d1.alias("_d1"),
                                  F.lag(value, 1).over(w).alias("_y1")))


def drift_fit(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Random walk with drift: slope (last-first)/(n-1), sigma of the steps."""
    d = _with_diff(df, key)
    return d.groupBy(key).agg(
        F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"),
        F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"),
        F.stddev_samp("_d").alias("sigma")).withColumn(
        "drift", F.try_divide(F.col("last_close") - F.col("first_close"), F.col("n") - 1))


def drift_forecast(df: DataFrame, days: int = 30, key: str = "symbol",
                   horizon: DataFrame | None = None) -> DataFrame:
    """last + h * drift, with a 95 % interval of sigma * sqrt(h)."""
    fit = with_horizon(drift_fit(df, key), horizon, key)
    sp = forecast_spine(fit, "_days" if horizon is not None else days)
    h = F.col("forecast_step")
    pred = F.col("last_close") + h * F.col("drift")
    half = F.lit(Z95) * F.col("sigma") * F.sqrt(h)
    return sp.select(key, h.cast("int").alias("forecast_step"), "date",
                     pred.alias("predicted_value"), (pred - half).alias("lower_ci"),
                     (pred + half).alias("upper_ci"), F.lit("drift").alias("model_used"))


def ar_fit(df: DataFrame, d: int = 1, key: str = "symbol") -> DataFrame:
    """ARI(1, d) by least squares: z_t = c + phi * z_(t-1), z = d-th difference.

    Normal equations reduce to ``regr_slope``/``regr_intercept`` aggregates.
    """
    x = _with_diff(df, key)
    z, z1 = (("_d", "_d1") if d == 1 else ("close", "_y1"))
    fit = x.groupBy(key).agg(
        F.regr_slope(z, z1).alias("phi"), F.regr_intercept(z, z1).alias("c"),
        F.regr_count(z, z1).alias("n_obs"), F.regr_sxx(z, z1).alias("_sxx"),
        F.regr_syy(z, z1).alias("_syy"), F.regr_sxy(z, z1).alias("_sxy"),
        F.max_by("close", "date").alias("last_close"),
        F.max_by(z, "date").alias("last_z"), F.max("date").alias("last_date"))
    ssr = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    sigma2 = F.try_divide(ssr, F.col("n_obs") - 2)
    k = 3  # c, phi, sigma
    n = F.col("n_obs")
    return fit.select(key, "phi", "c", "n_obs", "last_close", "last_z", "last_date",
                      F.lit(d).alias("d"), sigma2.alias("sigma2"),
                      (n * F.ln(F.try_divide(ssr, n)) + 2 * k).alias("aic"),
                      (n * F.ln(F.try_divide(ssr, n)) + k * F.ln(n)).alias("bic"))


def ar_forecast(df: DataFrame, days: int = 30, d: int = 1, key: str = "symbol",
                horizon: DataFrame | None = None) -> DataFrame:
    """ARI(1, d) forecast, d 0 or 1, with a 95 % interval: closed form per step.

    z(h) = m + phi^h (z - m) with m = c / (1 - phi); its sum and the variance of
    the shocks are geometric sums. phi within 1e-6 of 1 takes their limits.
    """
    if d not in (0, 1):
        raise ValueError(f"ARI(1, d) knows d = 0 and 1, not {d}; arima_forecast takes more")
    fit = with_horizon(ar_fit(df, d, key), horizon, key)
    sp = forecast_spine(fit, "_days" if horizon is not None else days)
    h, z, y = F.col("forecast_step").cast("double"), F.col("last_z"), F.col("last_close")
    c, phi = F.col("c"), F.col("phi")
    unit = F.abs(1 - phi) < 1e-6
    q, ph = 1 - phi, F.pow(phi, h)
    mean = c / q
    geo, geo2 = (1 - ph) / q, (1 - ph * ph) / (1 - phi * phi)
    if d == 1:
        pred = F.when(unit, y + h * z + c * h * (h + 1) / 2).otherwise(y + h * mean + (z - mean) * phi * geo)
        spread = F.when(unit, h * (h + 1) * (2 * h + 1) / 6).otherwise(
            (h - 2 * phi * geo + phi * phi * geo2) / (q * q))
    else:
        pred = F.when(unit, z + h * c).otherwise(mean + ph * (z - mean))
        spread = F.when(unit, h).otherwise(geo2)
    # without a slope (constant or too short) the last close goes on
    pred = F.coalesce(pred, y)
    half = F.lit(Z95) * F.sqrt(F.col("sigma2") * spread)
    return sp.select(key, F.col("forecast_step").cast("int").alias("forecast_step"), "date",
                     pred.alias("predicted_value"), (pred - half).alias("lower_ci"),
                     (pred + half).alias("upper_ci"), F.lit("ar").alias("model_used"))


# MacKinnon asymptotic 5 % critical value, constant and no trend.
ADF_CRITICAL_5PCT = -2.8621


def stationarity(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Dickey-Fuller (lag 0, constant): t statistic of y_(t-1) in a regression
    of the change on the previous level; stationary if below the 5 % value."""
    x = _with_diff(df, key)
    g = x.groupBy(key).agg(
        F.regr_slope("_d", "_y1").alias("gamma"), F.regr_count("_d", "_y1").alias("n_obs"),
        F.regr_sxx("_d", "_y1").alias("_sxx"), F.regr_syy("_d", "_y1").alias("_syy"),
        F.regr_sxy("_d", "_y1").alias("_sxy"))
    ssr = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    se = F.sqrt(F.try_divide(F.try_divide(ssr, F.col("n_obs") - 2), F.col("_sxx")))
    t = F.try_divide(F.col("gamma"), se)
    return g.select(key, "n_obs", "gamma", t.alias("adf_stat"),
                    (t < ADF_CRITICAL_5PCT).alias("is_stationary"))


def _seasonal(df, days=30, key="symbol", horizon=None):
    from tickforge.operators.seasonal import seasonal_trend_forecast
    return seasonal_trend_forecast(df, days, key, horizon=horizon)


def _arima(df, days=30, key="symbol", horizon=None):
    from tickforge.operators.arima import arima_forecast
    return arima_forecast(df, days, key, horizon).withColumn("model_used", F.lit("arima"))


MODELS = {"drift": drift_forecast, "ar": ar_forecast, "seasonal_trend": _seasonal, "arima": _arima}
DEFAULT_MODELS = ("arima", "seasonal_trend")


def evaluate_models(df: DataFrame, models=DEFAULT_MODELS, key: str = "symbol"
                    ) -> DataFrame:
    """Fit every model on the first 80 % of each symbol, score the rest.

    Pairs are joined on (symbol, forecast_step) = position after the split.
    """
    from tickforge.session import cut_lineage
    sp = cut_lineage(temporal_split(df, key=key))
    train = sp.filter("is_train").drop("is_train")
    test = seq.with_position(sp.filter(~F.col("is_train")).drop("is_train"), key, "date")
    test = test.select(key, "date", F.col("close").alias("actual"),
                       (F.col(seq.RN) + 1).cast("int").alias("forecast_step"))
    horizon = test.groupBy(key).agg(F.max("forecast_step").alias("days"))
    out = []
    for m in models:
        f = MODELS[m](train, key=key, horizon=horizon)
        pairs = test.join(f.select(key, "forecast_step", "predicted_value"),
                          [key, "forecast_step"]).withColumnRenamed("predicted_value",
                                                                     "predicted")
        out.append(regression_metrics(pairs, by=(key,)).withColumn("model_name", F.lit(m)))
    return reduce(lambda a, b: a.unionByName(b), out)


def select_and_forecast(df: DataFrame, days: int = 30, models=DEFAULT_MODELS,
                        key: str = "symbol") -> DataFrame:
    """Best model per symbol by test RMSE, refit on all rows, forecast ``days``.

    A symbol that no model could score (too short to split) takes the first one.
    Each model is refit only on the symbols that it won.
    """
    from tickforge.session import cut_lineage
    df = cut_lineage(df)
    best = best_model(evaluate_models(df, models, key), "rmse", by=(key,)).select(key, "best_model")
    chosen = cut_lineage(seq.join_on_key(df.select(key).distinct(), best, [key]).select(
        key, F.coalesce("best_model", F.lit(models[0])).alias("_model")))
    tagged = seq.join_on_key(df, chosen, [key], "inner")
    parts = [MODELS[m](tagged.where(F.col("_model") == m).drop("_model"), days=days, key=key) for m in models]
    return reduce(lambda a, b: a.unionByName(b), parts)


def save_params(params: DataFrame, path: str) -> str:
    """Persist fitted per-symbol model parameters as a Parquet table."""
    params.write.mode("overwrite").parquet(path)
    return path


def load_params(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
