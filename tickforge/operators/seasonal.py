"""Seasonal-trend forecast: piecewise-linear trend plus weekly and yearly terms.

Every symbol has 25 changepoints over the first 80 % of its span, three weekly
and ten yearly Fourier pairs. The moments X'X and X'y are summed per batch in
numpy, then by (symbol, entry) with partial aggregation, so a long symbol is
summed in many tasks; one system per symbol is solved in numpy. Coefficients
have normal priors: changepoint scale 0.05 (variance of the Laplace prior of
that scale), seasonality scale 10, trend scale 5, on closes divided by their
largest size. A symbol whose bars share one date keeps its mean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickforge.operators import sequence as seq
from tickforge.operators.forecast import Z95, forecast_spine, with_horizon

N_CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
WEEKLY_ORDER, YEARLY_ORDER = 3, 10
CHANGEPOINT_SCALE, SEASON_SCALE, TREND_SCALE = 0.05, 10.0, 5.0


def basis(t: np.ndarray, day: np.ndarray, cps: int, weekly: int, yearly: int) -> np.ndarray:
    """Design matrix: 1, t, hinges at the changepoints, Fourier pairs."""
    columns = [np.ones_like(t), t]
    columns += [np.maximum(t - CHANGEPOINT_RANGE * k / (cps + 1), 0.0) for k in range(1, cps + 1)]
    for period, order in ((7.0, weekly), (365.25, yearly)):
        for n in range(1, order + 1):
            angle = day * (2 * math.pi * n / period)
            columns += [np.sin(angle), np.cos(angle)]
    return np.stack(columns, axis=1)


def _clock(df: DataFrame) -> DataFrame:
    """``_t``: place in the symbol's span (0 to 1, beyond it in a forecast); ``_day``."""
    seconds = F.unix_timestamp(F.col("date").cast("timestamp"))
    start = F.unix_timestamp(F.col("_t0").cast("timestamp"))
    return df.select("*", F.coalesce(F.try_divide(seconds - start, F.col("_span")), F.lit(0.0)).alias("_t"),
                     (seconds / 86400.0).alias("_day"))


def _solve(m: np.ndarray, p: int, cps: int, season: int) -> tuple[list[float], float]:
    """Coefficients and noise of one symbol from its moments."""
    a = np.zeros((p + 1, p + 1))
    a[np.triu_indices(p + 1)] = m
    a = a + np.triu(a, 1).T
    n, xx, xy, yy = a[0, 0], a[:p, :p], a[:p, p], a[p, p]
    scale = np.concatenate([[TREND_SCALE] * 2, [math.sqrt(2) * CHANGEPOINT_SCALE] * cps, [SEASON_SCALE] * season])
    noise = max(yy / n - (xy[0] / n) ** 2, 1e-12)
    for _ in range(3):  # the weight of the priors follows the noise
        w = np.linalg.solve(xx + np.diag(noise / scale ** 2), xy)
        noise = max((yy - 2 * w @ xy + w @ xx @ w) / max(n - 2, 1), 1e-12)
    return w.tolist(), math.sqrt(noise)


def seasonal_fit(df: DataFrame, key: str = "symbol", cps: int = N_CHANGEPOINTS, weekly: int = WEEKLY_ORDER,
                 yearly: int = YEARLY_ORDER) -> DataFrame:
    """One row per symbol: coefficients, noise, span, scale and last date."""
    bars = df.where(F.col("close").isNotNull() & F.col("date").isNotNull()).select(key, "date", "close")
    seconds = F.unix_timestamp(F.col("date").cast("timestamp"))
    span = bars.groupBy(key).agg(
        F.min("date").alias("_t0"), F.max("date").alias("last_date"),
        (F.max(seconds) - F.min(seconds)).cast("double").alias("_span"),
        F.greatest(F.max(F.abs("close")), F.lit(1e-12)).alias("_size"))
    season = 2 * (weekly + yearly)
    p = 2 + cps + season
    upper = np.triu_indices(p + 1)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for symbol, part in batch.groupby("symbol", dropna=False):
                x = np.column_stack([basis(part["t"].to_numpy(), part["day"].to_numpy(), cps, weekly, yearly),
                                     part["y"].to_numpy()])
                out.append((None if pd.isna(symbol) else symbol, (x.T @ x)[upper].tolist()))
            yield pd.DataFrame(out, columns=["symbol", "m"])

    placed = _clock(seq.join_on_key(bars, span, [key], "inner")).select(
        F.col(key).alias("symbol"), F.col("_t").alias("t"), F.col("_day").alias("day"),
        (F.col("close") / F.col("_size")).alias("y"))
    entries = placed.mapInPandas(moments, "symbol string, m array<double>").select("symbol", F.posexplode("m").alias("i", "v"))
    sums = entries.groupBy("symbol", "i").agg(F.sum("v").alias("v"))
    whole = sums.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m")).select(
        "symbol", F.col("m.v").alias("m"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(symbol, *_solve(np.asarray(m, float), p, cps, season)) for symbol, m in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["symbol", "coef", "noise"])

    coef = whole.mapInPandas(solve, "symbol string, coef array<double>, noise double").withColumnRenamed("symbol", key)
    return seq.join_on_key(span, coef, [key], "inner").withColumn("shape", F.array(F.lit(cps), F.lit(weekly), F.lit(yearly)))


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        said = np.empty(len(batch))
        for symbol, rows in batch.reset_index(drop=True).groupby("symbol", dropna=False):
            cps, weekly, yearly = (int(v) for v in rows["shape"].iloc[0])
            x = basis(rows["t"].to_numpy(), rows["day"].to_numpy(), cps, weekly, yearly)
            said[rows.index] = x @ np.asarray(rows["coef"].iloc[0], float) * rows["size"].iloc[0]
        yield batch.assign(said=said)[["symbol", "step", "date", "actual", "half", "said"]]


def _project(rows: DataFrame, key: str) -> DataFrame:
    x = _clock(rows).select(F.col(key).alias("symbol"), "step", "date", "actual", F.col("_t").alias("t"),
                            F.col("_day").alias("day"), "coef", "shape", F.col("_size").alias("size"),
                            (F.lit(Z95) * F.col("noise") * F.col("_size")).alias("half"))
    return x.mapInPandas(_fitted, "symbol string, step int, date timestamp_ntz, actual double, half double, said double")


def seasonal_metrics(df: DataFrame, fit: DataFrame, key: str = "symbol") -> DataFrame:
    """In-sample (symbol, n, rmse, mae, mape)."""
    bars = df.where(F.col("close").isNotNull()).select(key, F.col("date").cast("timestamp_ntz").alias("date"),
                                                       F.col("close").alias("actual"), F.lit(0).alias("step"))
    error = F.col("actual") - F.col("said")
    return _project(seq.join_on_key(bars, fit, [key], "inner"), key).groupBy(F.col("symbol").alias(key)).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(F.try_divide(error, F.col("actual")))) * 100).alias("mape"))


def seasonal_trend_forecast(df: DataFrame, days: int = 30, key: str = "symbol", cps: int = N_CHANGEPOINTS,
                            weekly: int = WEEKLY_ORDER, yearly: int = YEARLY_ORDER,
                            horizon: DataFrame | None = None, fit: DataFrame | None = None) -> DataFrame:
    """Forecast of every symbol with a 95 % interval; ``fit`` may come from storage."""
    fit = seasonal_fit(df, key, cps, weekly, yearly) if fit is None else fit
    spine = forecast_spine(with_horizon(fit, horizon, key), "_days" if horizon is not None else days)
    rows = spine.select("*", F.col("forecast_step").cast("int").alias("step"), F.lit(None).cast("double").alias("actual"))
    return _project(rows, key).select(
        F.col("symbol").alias(key), F.col("step").alias("forecast_step"), "date", F.col("said").alias("predicted_value"),
        (F.col("said") - F.col("half")).alias("lower_ci"), (F.col("said") + F.col("half")).alias("upper_ci"),
        F.lit("seasonal_trend").alias("model_used"))
