"""Hand-made frames for the rules of the data model (FIXTURES.md B4)."""

import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge import schema as S
from tickforge.operators import clean as C
from tickforge.operators import features as FE
from tickforge.operators import forecast as FC
from tickforge.operators import merge as MG
from tickforge.sources import bars as B


def bars(spark, closes, symbol="X", start=dt.datetime(2020, 1, 1), opens=None):
    rows = []
    for i, c in enumerate(closes):
        o = opens[i] if opens is not None else c
        rows.append((symbol, start + dt.timedelta(days=i), o, None if c is None else c * 1.01,
                     None if c is None else c * 0.99, c, 1000.0 + i))
    return spark.createDataFrame(rows, S.BAR_SCHEMA)


def test_constant_price(spark):
    f = FE.technical_features(bars(spark, [50.0] * 30)).orderBy("date").toPandas()
    assert np.allclose(f.ema_12, 50.0) and np.allclose(f.ema_26, 50.0)
    assert np.allclose(f.macd, 0.0) and np.allclose(f.macd_signal, 0.0)
    assert f.rsi.isna().all()
    assert np.allclose(f.bb_width.dropna(), 0.0) and f.bb_position.isna().all()


def test_rising_price_rsi(spark):
    f = FE.technical_features(bars(spark, [10.0 + i for i in range(20)])).orderBy("date").toPandas()
    assert f.rsi[:13].isna().all()
    assert np.allclose(f.rsi[13:], 100.0)


def test_short_history_nulls(spark):
    f = FE.technical_features(bars(spark, [10.0 + i for i in range(19)])).toPandas()
    assert f.ma_20.isna().all() and f.bb_upper.isna().all() and f.bb_middle.isna().all()


def test_backward_fill_first_open(spark):
    df = bars(spark, [10.0, 11.0, 12.0], opens=[None, 10.5, 11.5])
    f = C.fill_prices(df).orderBy("date").toPandas()
    assert f.open.tolist() == [10.5, 10.5, 11.5]


def test_fill_across_chunks(spark):
    vals = [None if i % 7 == 0 else float(i) for i in range(300)]
    df = bars(spark, [float(i + 1) for i in range(300)], opens=vals)
    a = C.fill_prices(df, chunk_rows=64).orderBy("date").toPandas().open
    ref = pd.Series(vals).ffill().bfill()
    assert np.allclose(a, ref)


def test_normalise_and_merge(spark):
    rows = [("TCS", dt.datetime(2021, 1, 4), 1.0, 1.0, 1.0, 1.0, 1.0),
            ("TCS.NS", dt.datetime(2021, 1, 4), 2.0, 2.0, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, S.BAR_SCHEMA)
    existing = df.filter(F.col("symbol") == "TCS")
    new = df.filter(F.col("symbol") == "TCS.NS").withColumn("symbol", B.strip_suffix("symbol"))
    m = MG.merge_bars(existing, new).toPandas()
    assert len(m) == 1 and m.close[0] == 2.0


def test_merge_idempotent(spark):
    a = bars(spark, [float(i) for i in range(1, 40)])
    assert MG.merge_bars(a, a).exceptAll(a).count() == 0
    assert a.exceptAll(MG.merge_bars(a, a)).count() == 0


def test_ar1_recovers_phi(spark):
    rng = np.random.default_rng(7)
    y = [100.0]
    for _ in range(499):
        y.append(20.0 + 0.8 * y[-1] + rng.normal(0, 1))
    fit = FC.ar_fit(bars(spark, y), d=0).first()
    assert abs(fit.phi - 0.8) < 0.1


def test_clean_properties(spark, tmp_path=None):
    from tickforge.sources import fixtures as fx
    q = fx.quotes_dirty(spark, "/root/testdata/sf0.001")
    c = C.clean_bars(q)
    bad = c.filter((F.col("low") > F.col("open")) | (F.col("low") > F.col("close"))
                   | (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")))
    assert bad.count() == 0
    assert c.groupBy("symbol", "date").count().filter("count > 1").count() == 0
    # idempotent
    assert C.clean_bars(c).exceptAll(c).count() == 0


def test_rsi_bounds(spark):
    from tickforge.sources import fixtures as fx
    f = FE.technical_features(fx.bars_nation(spark, "/root/testdata/sf0.001"))
    assert f.filter((F.col("rsi") < 0) | (F.col("rsi") > 100)).count() == 0
    assert f.filter(F.col("bb_lower") > F.col("bb_upper")).count() == 0


def test_file_names_become_symbols(spark):
    d = tempfile.mkdtemp(prefix="tf-csv-")
    header = "Date,Symbol,Series,Prev Close,Open,High,Low,Last,Close,VWAP,Volume\n"
    with open(os.path.join(d, "M&M.csv"), "w") as fh:
        fh.write(header + "2020-01-01,X,EQ,1,1,2,0.5,1.5,1.5,1,10\n")
    with open(os.path.join(d, "A B.csv"), "w") as fh:
        fh.write(header + "2020-01-01,X,EQ,1,1,2,0.5,1.5,1.5,1,10\n")
    with open(os.path.join(d, "EMPTY.csv"), "w") as fh:
        fh.write(header)
    with open(os.path.join(d, "stock_metadata.csv"), "w") as fh:
        fh.write("Company Name,Industry,Symbol\nA,B,C\n")
    out = B.scan_bars_csv(spark, d).toPandas()
    assert sorted(out.symbol) == ["A B", "M&M"]
    assert out.close.tolist() == [1.5, 1.5]


def test_missing_column_raises(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0)], "date string, close double")
    with pytest.raises(ValueError):
        C.require_columns(C.default_symbol(df))
