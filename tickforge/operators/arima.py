"""ARIMA(p, d, q) per symbol, all symbols in one job, fitted from moments.

The order of differencing comes from unit-root tests; the rest is the
Hannan-Rissanen method: a long autoregression gives residuals, then the series
is regressed on its own lags and on lagged residuals. Both regressions need
only sums of products, one partially aggregated ``groupBy(symbol)`` each, so a
long symbol is summed in many tasks. One small moment matrix per symbol reaches
numpy, where every order (p, q) is solved on the same sample and the lowest AIC
is kept. Models with moving-average terms are then refined to the least conditional
sum of squares (`arima_css`). A symbol without a usable fit (constant, or too short) keeps a row: the
default order (1, 1, 1) without an effect of lags, so its mean step goes on; in a
search that the caller has narrowed, (0, d, 0). Levels are centred before products are
summed. Null closes are left out; a null symbol is a symbol.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickforge.operators import arima_css as css, sequence as seq
from tickforge.operators.forecast import Z95, with_horizon
from tickforge.operators.moments import matrix, solve
from tickforge.session import cut_lineage

MAX_P, MAX_Q, LONG_P, MAX_D, ADF_LAGS = 5, 5, 10, 2, 8
#: MacKinnon's (1994) response surface of the unit-root statistic with
#: constant: range, break, and the normal quantile's polynomial below and above it.
ADF_MIN, ADF_BREAK, ADF_MAX = -18.83, -1.61, 2.74
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(t: float) -> float:
    """Probability of a unit-root statistic this low."""
    if t <= ADF_MIN:
        return 0.0
    if t >= ADF_MAX:
        return 1.0
    z = sum(c * t ** i for i, c in enumerate(ADF_LOW if t <= ADF_BREAK else ADF_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _difference(w, d: int):
    """The d-th difference of close: signed binomial sums of its lags."""
    terms = [F.col("close") if k == 0 else F.lag("close", k).over(w) for k in range(d + 1)]
    return sum(((-1) ** k * math.comb(d, k) * t for k, t in enumerate(terms)), F.lit(0.0))


def _bars(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col("close").isNotNull()).select(key, "date", "close")


def _moments(x: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, m): the sums of products of all column pairs, row by row."""
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    return x.groupBy(key).agg(F.array(*sums).alias("m"), F.count(F.lit(1)).alias("n"))


def adf(df: DataFrame, key: str = "symbol", d: int = 0, max_lags: int = ADF_LAGS) -> DataFrame:
    """Augmented Dickey-Fuller test of the d-th difference, constant, lag by AIC:
    (symbol, n_obs, used_lag, adf_stat, p_value, is_stationary)."""
    bars = _bars(df, key)
    centre = bars.groupBy(key).agg((F.avg("close") if d == 0 else F.lit(0.0)).alias("_mean"))
    s = seq.chunked(seq.join_on_key(bars, centre, [key], "inner"), key, "date", back=max_lags + d + 2)
    w = seq.window(key)
    x = s.select("*", (_difference(w, d) - F.col("_mean")).alias("_y"))
    x = x.select("*", F.lag("_y", 1).over(w).alias("_y1"))
    x = x.select("*", (F.col("_y") - F.col("_y1")).alias("_dy"))
    lags = [f"_dy{i}" for i in range(1, max_lags + 1)]
    x = x.select("*", *[F.lag("_dy", i).over(w).alias(c) for i, c in enumerate(lags, 1)])
    x = seq.drop_halo(x).dropna(subset=["_dy", "_y1", *lags]).withColumn("_one", F.lit(1.0))
    columns = ["_one", "_y1", *lags, "_dy"]
    k = len(columns)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for symbol, m, n in batch.itertuples(index=False):
                a, best = matrix(m, k), None
                for lag in range(max_lags + 1):
                    use = slice(0, 2 + lag)
                    b = solve(a[use, use], a[use, -1])
                    if b is None or n <= 3 + lag:
                        continue
                    ssr = float(a[-1, -1] - 2 * b @ a[use, -1] + b @ a[use, use] @ b)
                    if ssr <= 0:
                        continue
                    aic = n * math.log(ssr / n) + 2 * (lag + 2)
                    if best is None or aic < best[0]:
                        error = math.sqrt(ssr / (n - 2 - lag) * np.linalg.inv(a[use, use])[1, 1])
                        best = (aic, lag, float(b[1] / error))
                if best is None:
                    out.append((symbol, n, None, None, None, None))
                else:
                    p = adf_p_value(best[2])
                    out.append((symbol, n, best[1], best[2], p, p < 0.05))
            yield pd.DataFrame(out, columns=["symbol", "n_obs", "used_lag", "adf_stat", "p_value", "is_stationary"])

    done = _moments(x, key, columns).select(key, "m", "n").mapInPandas(
        test, "symbol string, n_obs long, used_lag int, adf_stat double, p_value double, is_stationary boolean")
    return done.withColumnRenamed("symbol", key)


def difference_order(df: DataFrame, key: str = "symbol") -> DataFrame:
    """(symbol, d): 0 if the level is stationary, else 1 if the change is, else 2;
    1 where the test has no answer."""
    level = adf(df, key, 0).select(key, F.col("is_stationary").alias("_s0"))
    change = adf(df, key, 1).select(key, F.col("is_stationary").alias("_s1"))
    every = df.select(key).distinct()
    x = seq.join_on_key(seq.join_on_key(every, level, [key]), change, [key])
    return x.select(key, F.when(F.col("_s0"), 0).when(F.col("_s1") | F.col("_s1").isNull(), 1).otherwise(2).alias("d"))


def _roots_ok(coef: np.ndarray) -> bool:
    """Is 1 - c1 B - c2 B^2 ... free of roots on or inside the unit circle?"""
    return not len(coef) or float(np.abs(np.roots(np.concatenate([[1.0], -coef]))).max()) < 0.999


def _series(df: DataFrame, orders: DataFrame, key: str, back: int) -> DataFrame:
    """Chunked bars with ``_z``: the difference of each symbol's order, levels centred."""
    bars = _bars(df, key)
    centre = bars.groupBy(key).agg(F.avg("close").alias("_mean"))
    with_order = seq.join_on_key(seq.join_on_key(bars, orders.select(key, "d"), [key], "inner"), centre, [key], "inner")
    s = seq.chunked(with_order, key, "date", back=back + MAX_D)
    w = seq.window(key)
    z = F.when(F.col("d") == 0, F.col("close") - F.col("_mean"))
    for d in range(1, MAX_D + 1):
        z = z.when(F.col("d") == d, _difference(w, d))
    return s.select("*", z.alias("_z"), (F.col("close") - F.lag("close", 1).over(w)).alias("_step"))


def _lags(x: DataFrame, column: str, n: int, key: str) -> tuple[DataFrame, list[str]]:
    names = [f"{column}{i}" for i in range(1, n + 1)]
    return x.select("*", *[F.lag(column, i).over(seq.window(key)).alias(c) for i, c in enumerate(names, 1)]), names


def arima_fit(df: DataFrame, key: str = "symbol", max_p: int = MAX_P, max_q: int = MAX_Q, d: int | None = None,
              long_p: int = LONG_P, refine: int = css.ROUNDS) -> DataFrame:
    """One row per symbol: p, d, q, phi, theta, c, sigma2, aic, bic, n_obs, in-sample
    rmse, mae and mape, and the state a forecast starts from.

    ``refine``: most rounds of Gauss-Newton after the order is chosen; 0 keeps the
    Hannan-Rissanen estimates. ``d`` None: chosen per symbol by unit-root tests; otherwise 0, 1 or 2.
    """
    if d is not None and not 0 <= d <= MAX_D:
        raise ValueError(f"d must be 0, 1 or 2, not {d}")
    df = cut_lineage(_bars(df, key))
    orders = cut_lineage(difference_order(df, key)) if d is None else df.select(key).distinct().withColumn("d", F.lit(d))
    s = _series(df, orders, key, 2 * long_p + max_q)
    x, z_long = _lags(s, "_z", max(long_p, max_p), key)
    x = x.withColumn("_one", F.lit(1.0))
    first = ["_one", *z_long[:long_p], "_z"]

    def long_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for symbol, m, _ in batch.itertuples(index=False):
                a = matrix(m, len(first))
                b = solve(a[:-1, :-1], a[:-1, -1])
                out.append((symbol, None if b is None else b.tolist()))
            yield pd.DataFrame(out, columns=["symbol", "_long"])

    whole = seq.drop_halo(x).dropna(subset=first)
    long = _moments(whole, key, first).select(key, "m", "n").mapInPandas(
        long_fit, "symbol string, _long array<double>").withColumnRenamed("symbol", key)
    x = seq.join_on_key(x, long, [key])
    fitted = sum((F.col("_long")[i] * F.col(c) for i, c in enumerate(first[:-1])), F.lit(0.0))
    x = x.withColumn("_e", F.col("_z") - fitted)
    x, e_lags = _lags(x, "_e", max_q, key)
    z_lags = z_long[:max_p]
    x = cut_lineage(seq.drop_halo(x, keep_position=True).select(key, seq.RN, "date", "close", "d", "_mean", "_step", "_one", "_z", "_e", *z_lags, *e_lags))
    second = ["_one", *z_lags, *e_lags, "_z"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for symbol, m, n in batch.itertuples(index=False):
                a, best = matrix(m, len(second)), None
                for p in range(max_p + 1):
                    for q in range(max_q + 1):
                        use = [0, *range(1, p + 1), *range(1 + max_p, 1 + max_p + q)]
                        b, k = solve(a[np.ix_(use, use)], a[use, -1]), p + q + 2
                        if b is None or n <= k + 1 or not (_roots_ok(b[1:p + 1]) and _roots_ok(-b[p + 1:])):
                            continue
                        ssr = float(a[-1, -1] - 2 * b @ a[use, -1] + b @ a[np.ix_(use, use)] @ b)
                        if ssr <= 1e-14 * max(a[-1, -1], 1e-300):
                            continue
                        aic = n * math.log(ssr / n) + 2 * k
                        if best is None or aic < best[0]:
                            best = (aic, n * math.log(ssr / n) + k * math.log(n), p, q, b, ssr / (n - k + 1))
                if best is not None:
                    aic, bic, p, q, b, s2 = best
                    out.append((symbol, p, q, float(b[0]), b[1:p + 1].tolist(), b[p + 1:].tolist(), s2, aic, bic, n))
            yield pd.DataFrame(out, columns=["symbol", "p", "q", "c", "phi", "theta", "sigma2", "aic", "bic", "n_obs"])

    chosen = _moments(x.dropna(subset=second), key, second).select(key, "m", "n").mapInPandas(
        choose, "symbol string, p int, q int, c double, phi array<double>, theta array<double>, sigma2 double, "
                "aic double, bic double, n_obs long").withColumnRenamed("symbol", key)
    ends = x.groupBy(key).agg(
        F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"),
        F.max_by("_step", "date").alias("last_step"), F.first("_mean").alias("_mean"), F.first("d").alias("d"),
        F.avg("_z").alias("_drift"), F.var_samp("_z").alias("_var"), F.count(F.lit(1)).alias("_n"),
        F.avg("_step").alias("_mean_step"), F.var_samp("_step").alias("_step_var"),
        F.max_by(F.array("_z", *z_lags[:-1]), "date").alias("last_z"),
        F.max_by(F.array("_e", *e_lags[:-1]) if max_q else F.array().cast("array<double>"), "date").alias("last_e"))
    fit = cut_lineage(seq.join_on_key(ends, chosen, [key]))
    none = F.array().cast("array<double>")
    default = (max_p, max_q) == (MAX_P, MAX_Q) and d in (None, 1)
    failed, zero = F.col("p").isNull(), F.array(F.lit(0.0)) if default else none
    order = lambda c: F.coalesce(c, F.lit(1 if default else 0)).alias(c)
    step, spread = ("_mean_step", "_step_var") if default else ("_drift", "_var")
    fit = fit.select(
        key, order("p"), (F.when(failed, 1).otherwise(F.col("d")) if default else F.col("d")).alias("d"), order("q"),
        F.coalesce("phi", zero).alias("phi"), F.coalesce("theta", zero).alias("theta"),
        F.coalesce("c", step, F.lit(0.0)).alias("c"), F.coalesce("sigma2", spread).alias("sigma2"), "aic", "bic",
        F.coalesce("n_obs", "_n").alias("n_obs"), "last_date", "last_close",
        F.coalesce("last_step", F.lit(0.0)).alias("last_step"), "_mean",
        F.transform("last_z", lambda v: F.coalesce(v, F.lit(0.0))).alias("last_z"),
        F.transform("last_e", lambda v: F.coalesce(v, F.lit(0.0))).alias("last_e"))
    fit = seq.join_on_key(fit, _in_sample(x, fit, z_lags, e_lags, key), [key])
    if not (refine and max_q):
        return fit
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in second])
    bars = x.where(F.col("_z").isNotNull()).select(seq.group_key(key).alias("_k"), seq.RN, "_z", "close", whole.alias("_in"))
    fit = cut_lineage(fit)
    better = css.refine(bars, fit.where("aic is not null").withColumn("_k", seq.group_key(key)), max_p, max_q, refine)
    better = better.select("_k", *[F.col(c).alias(f"_{c}") for c in better.columns if c != "_k"])
    return fit.withColumn("_k", seq.group_key(key)).join(better, "_k", "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in better.columns else c for c in fit.columns])


def _in_sample(x: DataFrame, fit: DataFrame, z_lags: list[str], e_lags: list[str], key: str) -> DataFrame:
    """(symbol, rmse, mae, mape) of one-step errors; differencing cancels in them."""
    y = seq.join_on_key(x, fit.select(key, "phi", "theta", "c"), [key], "inner")
    said = F.col("c")
    for array, names in (("phi", z_lags), ("theta", e_lags)):
        for i, c in enumerate(names):
            said = said + F.when(F.size(array) > i, F.get(F.col(array), F.lit(i)) * F.col(c)).otherwise(0.0)
    error = F.col("_z") - said
    return y.withColumn("_r", error).groupBy(key).agg(
        F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rmse"), F.avg(F.abs("_r")).alias("mae"),
        (F.avg(F.abs(F.try_divide(F.col("_r"), F.col("close")))) * 100).alias("mape"))


def _paths(batches: Iterator[pd.DataFrame], block: int = 10_000) -> Iterator[pd.DataFrame]:
    """Forecast rows of every symbol, step by step; memory does not grow with the horizon."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            phi, theta = np.asarray(r.phi, float), np.asarray(r.theta, float)
            z = list(np.asarray(r.last_z, float)[:max(len(phi), 1)])
            e = list(np.asarray(r.last_e, float)[:len(theta)])
            psi, sums = [], np.zeros(r.d + 1)  # sums[0] = psi, sums[k] = its k-th running sum
            level, step, spread, out = r.last_close, r.last_step, 0.0, []
            for h in range(1, int(r.days) + 1):
                zhat = r.c + float(phi @ z[:len(phi)]) + float(theta @ e[:len(theta)])
                if r.d == 0:
                    level = zhat + r.centre
                elif r.d == 1:
                    level += zhat
                else:
                    step += zhat
                    level += step
                j = h - 1
                weight = 1.0 if j == 0 else float(phi[:len(psi)] @ psi[:len(phi)]) + (theta[j - 1] if j <= len(theta) else 0.0)
                psi = [weight, *psi][:max(len(phi), 1)]
                sums[0] = weight
                for k in range(1, r.d + 1):
                    sums[k] += sums[k - 1]
                spread += sums[r.d] ** 2
                z, e = [zhat, *z][:max(len(phi), 1)], [0.0, *e][:len(theta)]
                half = Z95 * math.sqrt(r.sigma2 * spread) if r.sigma2 is not None and r.sigma2 == r.sigma2 else None
                out.append((r.symbol, r.last_date, r.p, r.d, r.q, h, level, half))
                if len(out) == block:
                    yield pd.DataFrame(out, columns=_PATH)
                    out = []
            yield pd.DataFrame(out, columns=_PATH)


_PATH = ["symbol", "last_date", "p", "d", "q", "forecast_step", "predicted_value", "half"]


def arima_forecast(df: DataFrame, days: int = 30, key: str = "symbol", horizon: DataFrame | None = None,
                   max_p: int = MAX_P, max_q: int = MAX_Q, d: int | None = None, fit: DataFrame | None = None) -> DataFrame:
    """Forecast of every symbol with a 95 % interval; ``fit`` may come from storage."""
    fit = arima_fit(df, key, max_p, max_q, d) if fit is None else fit
    fit = with_horizon(fit, horizon, key) if horizon is not None else fit.withColumn("_days", F.lit(days))
    rows = fit.select(F.col(key).alias("symbol"), "last_date", "last_close", "last_step", "p", "d", "q", "phi", "theta",
                      "c", "sigma2", "last_z", "last_e", F.col("_days").alias("days"), F.col("_mean").alias("centre"))
    out = rows.mapInPandas(_paths, "symbol string, last_date timestamp_ntz, p int, d int, q int, forecast_step int, "
                                   "predicted_value double, half double")
    return out.select(F.col("symbol").alias(key), "forecast_step",
                      F.date_add("last_date", F.col("forecast_step")).cast("timestamp_ntz").alias("date"),
                      "predicted_value", (F.col("predicted_value") - F.col("half")).alias("lower_ci"),
                      (F.col("predicted_value") + F.col("half")).alias("upper_ci"),
                      F.format_string("arima(%d,%d,%d)", "p", "d", "q").alias("model_used"))
