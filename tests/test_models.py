"""Fitted models: recovery of known parameters, and no symbol lost."""

import datetime as dt
import math

import numpy as np
import pytest

from tickforge.operators import features as FE
from tickforge.operators import arima_css as CSS
from tickforge.operators import forecast as FC
from tickforge.operators import ml as ML
from tickforge.operators import sequence as seq
from tickforge.operators.arima import adf, adf_p_value, arima_fit, arima_forecast
from tickforge.operators.seasonal import seasonal_fit, seasonal_metrics, seasonal_trend_forecast

D0 = dt.datetime(2015, 1, 1)


def frame(spark, **series):
    rows = [(None if s == "none" else s, D0 + dt.timedelta(days=i), None if v is None else float(v))
            for s, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "symbol string, date timestamp_ntz, close double")


def arma(rng, n, phi=(), theta=()):
    e, y = rng.normal(size=n + 50), []
    for t in range(n + 50):
        y.append(e[t] + sum(p * y[t - i] for i, p in enumerate(phi, 1) if t >= i)
                 + sum(q * e[t - i] for i, q in enumerate(theta, 1) if t >= i))
    return np.array(y[50:])


@pytest.fixture(scope="module")
def fits(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, AR2=50 + arma(rng, 3000, (0.5, -0.3)), MA1=50 + arma(rng, 3000, (), (0.6,)),
               I1=100 + np.cumsum(arma(rng, 3000, (0.4,))), I2=1e4 + np.cumsum(np.cumsum(rng.normal(size=3000))),
               none=10 + arma(rng, 500, (0.3,)), CONST=[7.0] * 300, SHORT=[1.0, 2.0, 4.0], ONE=[5.0],
               GAPS=[None if i % 5 == 0 else v for i, v in enumerate(20 + arma(rng, 400, (0.5,)))])
    return df.cache(), {r.symbol: r for r in arima_fit(df, max_p=3, max_q=2).collect()}


def test_orders_and_coefficients_are_recovered(fits):
    _, f = fits
    assert len(f) == 9
    assert (f["AR2"].d, f["MA1"].d, f["I1"].d, f["I2"].d) == (0, 0, 1, 2)
    # lag polynomials with a common factor are the same process: compare impulse responses
    assert np.allclose(_psi(f["AR2"].phi, f["AR2"].theta, 4), _psi((0.5, -0.3), (), 4), atol=0.1)
    assert np.allclose(_psi(f["MA1"].phi, f["MA1"].theta, 4), _psi((), (0.6,), 4), atol=0.1)
    assert all(abs(f[s].sigma2 - 1) < 0.15 and abs(f[s].rmse - 1) < 0.1 for s in ("AR2", "MA1", "I1"))
    assert (f["CONST"].p, f["CONST"].q) == (0, 0) and (f["SHORT"].p, f["ONE"].p) == (0, 0)


def _psi(phi, theta, n):
    out = [1.0]
    for j in range(1, n + 1):
        out.append((theta[j - 1] if j <= len(theta) else 0.0) + sum(p * out[j - i] for i, p in enumerate(phi, 1) if j >= i))
    return out


def test_every_symbol_is_forecast(spark, fits):
    df, _ = fits
    rows = arima_forecast(df, 12, max_p=3, max_q=2).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.forecast_step):
        by.setdefault(r.symbol, []).append(r)
    assert len(by) == 9 and all(len(v) == 12 for v in by.values())
    assert all(abs(r.predicted_value - 7.0) < 1e-9 for r in by["CONST"])
    for s in ("AR2", "I1", "I2"):
        width = np.array([r.upper_ci - r.lower_ci for r in by[s]])
        assert (np.diff(width) > -1e-9).all()
    with pytest.raises(ValueError):
        arima_fit(df, d=3)


def test_adf_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    y = 30 + np.cumsum(rng.normal(size=400)) * 0.3 + rng.normal(size=400)
    got = adf(frame(spark, A=y), max_lags=2).first()
    dy = np.diff(y)
    best = None
    for lag in range(3):
        x = np.column_stack([np.ones(len(dy) - 2), y[2:-1], *[dy[2 - i:len(dy) - i] for i in range(1, lag + 1)]])
        b, ssr, *_ = np.linalg.lstsq(x, dy[2:], rcond=None)
        n = len(x)
        aic = n * math.log(ssr[0] / n) + 2 * (lag + 2)
        if best is None or aic < best[0]:
            best = (aic, lag, b[1] / math.sqrt(ssr[0] / (n - 2 - lag) * np.linalg.inv(x.T @ x)[1, 1]))
    assert got.used_lag == best[1] and abs(got.adf_stat - best[2]) < 1e-6
    assert abs(adf_p_value(-2.8621) - 0.05) < 0.001 and adf_p_value(-30) == 0.0 and adf_p_value(3) == 1.0


def test_seasonal_trend_recovers_a_season(spark):
    t = np.arange(1200)
    y = 100 + 0.05 * t + 8 * np.sin(2 * np.pi * t / 7) + np.where(t > 500, 0.1 * (t - 500), 0)
    df = frame(spark, S=y, none=y + 1, ONE=[3.0], FLAT=[2.0] * 40)
    fit = seasonal_fit(df)
    f = {(r.symbol, r.forecast_step): r for r in seasonal_trend_forecast(df, 14, fit=fit).collect()}
    assert len(f) == 4 * 14
    ahead = np.arange(1200, 1214)
    want = 100 + 0.05 * ahead + 8 * np.sin(2 * np.pi * ahead / 7) + 0.1 * (ahead - 500)
    assert max(abs(f["S", h].predicted_value - want[h - 1]) for h in range(1, 15)) < 4
    assert abs(f["FLAT", 3].predicted_value - 2.0) < 0.2
    m = {r.symbol: r for r in seasonal_metrics(df, fit).collect()}
    assert m["S"].n == 1200 and m["S"].rmse < 1.5 and m["S"].mae <= m["S"].rmse


def test_ar_closed_form_equals_recursion(spark):
    rng = np.random.default_rng(11)
    df = frame(spark, A=50 + np.cumsum(arma(rng, 300, (0.6,))), CONST=[4.0] * 30)
    for d in (0, 1):
        fit = {r.symbol: r for r in FC.ar_fit(df, d).collect()}["A"]
        rows = sorted((r for r in FC.ar_forecast(df, 20, d).collect() if r.symbol == "A"), key=lambda r: r.forecast_step)
        z, y, cum, psi, v = fit.last_z, fit.last_close, 0.0, 1.0, 0.0
        for r in rows:
            z = fit.c + fit.phi * z
            y = y + z if d else z
            cum = cum + psi
            v += (cum if d else psi) ** 2
            psi *= fit.phi
            assert abs(r.predicted_value - y) < 1e-6
            assert abs((r.upper_ci - r.lower_ci) / 2 - FC.Z95 * math.sqrt(fit.sigma2 * v)) < 1e-6
    assert {r.symbol for r in FC.ar_forecast(df, 2).collect()} == {"A", "CONST"}
    with pytest.raises(ValueError):
        FC.ar_forecast(df, 2, d=2)


def test_selection_loses_no_symbol(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, A=20 + arma(rng, 120, (0.5,)), none=30 + arma(rng, 120), ONE=[5.0])
    got = FC.select_and_forecast(df, 5, ("drift", "ar")).collect()
    assert {r.symbol for r in got} == {"A", None, "ONE"} and len(got) == 15


def walk_bars(spark, seed=4, **sizes):
    rng, rows = np.random.default_rng(seed), []
    for s, n in sizes.items():
        c = 100 + np.cumsum(rng.normal(size=n))
        rows += [(s, D0 + dt.timedelta(days=i), v - 0.5, v + 1, v - 1, v, 1000.0 + i % 7) for i, v in enumerate(c.tolist())]
    schema = "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double"
    return spark.createDataFrame(rows, schema), rows


def test_patience_looks_past_a_rise():
    curve = [9.0, 8.0, 7.0, 7.5, 7.6, 6.0, 5.0] + [4.9 - 0.01 * i for i in range(20)] + [6.0] * 60
    assert ML.kept_rounds(curve, 50) == (27, True)
    assert ML.kept_rounds(curve[:40], 50) == (27, False)  # too short to say
    assert ML.kept_rounds(curve, 2) == (3, True)
    assert ML.kept_rounds([3.0], 50) == (1, False)
    assert ML.kept_rounds([2.0, float("nan"), 1.0], 50)[0] == 3


def test_training_rows_are_bars_and_labels_stay_in_their_part(spark):
    bars, _ = walk_bars(spark, A=900, B=150, TINY=8)
    rows = ML.training_rows(FE.model_features(bars)).select("symbol", "date", "actual", "close", "label", "part").collect()
    assert len(rows) <= bars.count() and {r.symbol for r in rows} == {"A", "B"}
    for s in "AB":
        mine = sorted((r for r in rows if r.symbol == s), key=lambda r: r.date)
        assert [p for p, _ in __import__("itertools").groupby(r.part for r in mine)] == ["train", "validation", "test"]
        first = {p: min(r.date for r in mine if r.part == p) for p in ("validation", "test")}
        last = {p: max(r.date for r in mine if r.part == p) for p in ("train", "validation")}
        # the close that a label names is the next day's: still before the next part
        assert last["train"] + dt.timedelta(days=1) < first["validation"]
        assert last["validation"] + dt.timedelta(days=1) < first["test"]
    assert all(abs(r.label - math.log(r.actual / r.close)) < 1e-12 for r in rows)
    by_hash = ML.training_rows(FE.model_features(bars), "random").groupBy("part").count().collect()
    assert {r.part for r in by_hash} == {"train", "validation", "test"}


def test_boosting_keeps_the_rounds_that_the_whole_curve_asks_for(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(size=1500) * 0.3
    rows = spark.createDataFrame([(float(a), float(b), float(c), "validation" if i % 5 == 0 else "train")
                                  for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "a double, b double, label double, part string")
    model, curve = ML.gbt_fit(rows, rounds=45, patience=10, features=("a", "b"), step=0.2)
    kept = model.stages[-1].getNumTrees
    assert kept == ML.kept_rounds(curve, 10)[0] > 10 and curve[kept - 1] == min(curve[:kept])
    # the prefix is the first trees of the whole ensemble: its error is the curve's
    said = model.transform(rows.where("part = 'validation'"))
    error = said.agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    assert abs(error - curve[kept - 1]) < 1e-9
    none, curve = ML.gbt_fit(rows.where("part = 'train'"), rounds=3, features=("a", "b"))
    assert curve == [] and none.stages[-1].getNumTrees == 3


def test_trees_forecast_any_days_and_come_back_from_storage(spark, tmp_path):
    from pyspark.sql import functions as F
    bars, rows = walk_bars(spark, A=260, B=240, TINY=8)
    f = FE.model_features(bars)
    model, pred, curve = ML.gbt_train(f, rounds=8)
    assert len(curve) == 8 and pred.count() > 0 and pred.where("predicted is null").count() == 0
    got = ML.gbt_forecast(model, f, 90, cut_every=30).collect()
    assert len(got) == 270 and all(math.isfinite(r.predicted_value) for r in got)
    assert {(r.symbol, r.model_used) for r in got} == {("A", "gbt"), ("B", "gbt"), ("TINY", "last_close")}
    last = {s: max(r[1] for r in rows if r[0] == s) for s in ("A", "B", "TINY")}
    assert all(r.date == last[r.symbol] + dt.timedelta(days=r.forecast_step) for r in got)
    # step 1 is the model on the newest bar, step 2 on features with the predicted close in their history
    newest = model.transform(f.join(f.groupBy("symbol").agg(F.max("date").alias("date")), ["symbol", "date"])
                             .where("symbol != 'TINY'")).collect()
    one = {r.symbol: r.close * math.exp(r.prediction) for r in newest}
    steps = {(r.symbol, r.forecast_step): r.predicted_value for r in got}
    assert all(abs(steps[s, 1] - v) < 1e-9 for s, v in one.items())
    from_a = [r for r in rows if r[0] == "A"]
    longer = [*from_a, ("A", last["A"] + dt.timedelta(days=1), *from_a[-1][2:5], one["A"], from_a[-1][6])]
    again = FE.model_features(spark.createDataFrame(longer, bars.schema)).where(F.col("date") > last["A"])
    old = f.where((F.col("symbol") == "A") & (F.col("date") == last["A"])).first().asDict()
    held = [c for c in FE.MODEL_FEATURES if c not in ML.close_features(F.array(F.lit(0.0)))]
    two = model.transform(again.withColumns({c: F.lit(old[c]) for c in held})).first()
    assert abs(steps["A", 2] - two["close"] * math.exp(two["prediction"])) < 1e-9
    back, meta = ML.model_load(ML.model_save(model, str(tmp_path / "m"), curve))
    assert meta["lookback"] == 60 and meta["feature_names"] == list(FE.MODEL_FEATURES) and meta["curve"] == curve
    assert sorted(map(str, ML.gbt_forecast(back, f, 5).collect())) == sorted(str(r) for r in got if r.forecast_step <= 5)


def test_default_order_where_no_order_fits(spark):
    from tickforge.operators.arima import arima_fit, arima_forecast
    df = frame(spark, CONST=[5.0] * 40, SHORT=[1.0, 2.0, 4.0], ONE=[7.0])
    fits = {r.symbol: r for r in arima_fit(df).collect()}
    assert {(r.p, r.d, r.q) for r in fits.values()} == {(1, 1, 1)}
    got = {(r.symbol, r.forecast_step): r for r in arima_forecast(df, 2).collect()}
    assert {r.model_used for r in got.values()} == {"arima(1,1,1)"}
    assert [got["CONST", h].predicted_value for h in (1, 2)] == [5.0, 5.0]
    assert [got["SHORT", h].predicted_value for h in (1, 2)] == [5.5, 7.0]
    assert [got["ONE", h].predicted_value for h in (1, 2)] == [7.0, 7.0]
    assert {(r.p, r.d, r.q) for r in arima_fit(df, max_q=0, d=1).collect()} == {(0, 1, 0)}


def squares(z, c, phi, theta, first):
    """Sum of squared residuals from row ``first`` on, step by step from zero."""
    e = []
    for t in range(len(z)):
        e.append(0.0 if t < len(phi) else z[t] - c - sum(f * z[t - i] for i, f in enumerate(phi, 1))
                 - sum(v * e[t - j] for j, v in enumerate(theta, 1) if t >= j))
    return sum(v * v for v in e[first:]), e


def test_refined_models_are_the_least_squares_and_nearer_to_the_truth(spark):
    rng, truth = np.random.default_rng(7), {"P": 0.8, "N": -0.7}
    series = {f"{k}{i}": 50 + arma(rng, 300, (), (v,)) for k, v in truth.items() for i in range(8)}
    series["none"] = series["P0"]
    df = frame(spark, **series, CONST=[3.0] * 60).cache()
    start = {r.symbol: r for r in arima_fit(df, max_p=0, max_q=1, d=0, refine=0).collect()}
    fits = {r.symbol: r for r in arima_fit(df, max_p=0, max_q=1, d=0).collect()}
    assert set(fits) == set(start) and fits["CONST"] == start["CONST"]
    assert fits[None].theta == fits["P0"].theta
    for s in (k for k in series if k != "none"):
        z, r = series[s] - series[s].mean(), fits[s]
        best, e = squares(z, r.c, r.phi, r.theta, 11)
        assert best <= squares(z, start[s].c, start[s].phi, start[s].theta, 11)[0]
        for dc, dt_ in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
            assert best < squares(z, r.c + dc, r.phi, [r.theta[0] + dt_], 11)[0]
        assert r.n_obs == len(z) - 11 and abs(r.rmse - math.sqrt(best / r.n_obs)) < 1e-9
        assert abs(r.last_e[0] - e[-1]) < 1e-9 and abs(r.mae - np.abs(e[11:]).mean()) < 1e-9
        assert abs(r.aic - (r.n_obs * math.log(best / r.n_obs) + 6)) < 1e-6
    off = lambda f: sum((f[s].theta[0] - truth[s[0]]) ** 2 for s in series if s != "none")
    assert off(fits) < off(start)


def test_refinement_does_not_see_chunk_borders(spark):
    rng = np.random.default_rng(8)
    z = arma(rng, 9000, (0.6,), (0.5, 0.2)).tolist()
    bars = spark.createDataFrame([("v", i, v, 5.0 if i % 9 else 0.0, i > 20) for i, v in enumerate(z)],
                                 f"_k string, {seq.RN} long, _z double, close double, _in boolean")
    first = spark.createDataFrame([("v", 1, 2, 0.0, [0.3], [0.2, 0.0]), ("far", 0, 1, 0.0, [], [0.99])],
                                  "_k string, p int, q int, c double, phi array<double>, theta array<double>")
    one, cut = (CSS.refine(bars, first, 2, 3, rounds=12, chunk_rows=n).collect() for n in (1 << 17, 2500))
    assert len(one) == len(cut) == 1
    for a, b in zip(one[0][1:], cut[0][1:], strict=True):
        assert np.allclose(a, b, rtol=1e-7, atol=1e-9)
    r = one[0]
    best, e = squares(z, r.c, r.phi, r.theta, 21)
    assert abs(r.rmse - math.sqrt(best / (9000 - 21))) < 1e-9 and np.allclose(r.last_e, e[:-4:-1], atol=1e-9)
    assert np.allclose(_psi(r.phi, r.theta, 4), _psi((0.6,), (0.5, 0.2), 4), atol=0.05)
    assert abs(r.mape - np.mean([abs(v) / 5 for i, v in enumerate(e) if i > 20 and i % 9]) * 100) < 1e-9


def test_chained_forecasts_stay_within_the_range_of_the_closes(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(9)
    c = np.exp(rng.normal(size=120) * 3 + 5)
    rows = [("J", D0 + dt.timedelta(days=i), v * 0.9, v * 1.2, v * 0.8, v, 100.0 + i % 5) for i, v in enumerate(c.tolist())]
    bars = spark.createDataFrame(rows, "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double")
    f = FE.model_features(bars)
    model, _, _ = ML.gbt_train(f, rounds=4)
    span = c.max() / c.min()
    got = [r.predicted_value for r in ML.gbt_forecast(model, f, 12, cut_every=4).collect()]
    newest = f.where(F.col("symbol") == "J").dropna(subset=list(FE.MODEL_FEATURES)).orderBy(F.desc("date")).first().close
    assert len(got) == 12 and all(newest / span * 0.999999 <= v <= newest * span * 1.000001 for v in got)
