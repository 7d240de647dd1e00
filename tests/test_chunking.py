"""Chunked windows and the EMA scan equal the single-partition result."""

import datetime as dt

import numpy as np
import pandas as pd

from tickforge import schema as S
from tickforge.operators import features as FE


def long_bars(spark, n=40000, symbols=("A", "B")):
    rng = np.random.default_rng(1)
    rows = []
    t0 = dt.datetime(2000, 1, 1)
    for s in symbols:
        p = 100.0 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i in range(n):
            rows.append((s, t0 + dt.timedelta(hours=i), float(p[i]), float(p[i]) + 1,
                         float(p[i]) - 1, float(p[i]), 1.0 + i % 7))
    return spark.createDataFrame(pd.DataFrame(rows, columns=list(S.BAR_COLS)), S.BAR_SCHEMA)


def test_chunked_equals_reference(spark):
    df = long_bars(spark).cache()
    f = FE.technical_features(df, chunk_rows=16384).toPandas().sort_values(["symbol", "date"])
    for sym, g in f.groupby("symbol"):
        c = g.close.reset_index(drop=True)
        ema12 = c.ewm(span=12, adjust=False).mean()
        ema26 = c.ewm(span=26, adjust=False).mean()
        sig = (ema12 - ema26).ewm(span=9, adjust=False).mean()
        assert np.allclose(g.ema_12.to_numpy(), ema12, rtol=1e-12, atol=1e-9)
        assert np.allclose(g.macd_signal.to_numpy(), sig, rtol=1e-9, atol=1e-8)
        ma200 = c.rolling(200).mean()
        m = ~ma200.isna()
        assert (g.ma_200.isna().to_numpy() == ~m.to_numpy()).all()
        assert np.allclose(g.ma_200.to_numpy()[m], ma200[m], rtol=1e-12)
        vol = c.pct_change().rolling(50).std()
        mv = ~vol.isna()
        assert np.allclose(g.volatility_50.to_numpy()[mv], vol[mv], rtol=1e-7)
    df.unpersist()
