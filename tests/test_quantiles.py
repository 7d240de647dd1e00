"""Distributed exact quantiles equal Spark's buffered percentile."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickforge.operators.quantiles import exact_quantiles


def test_matches_percentile_with_hot_group_and_duplicates(spark):
    rng = np.random.default_rng(5)
    hot = pd.DataFrame({"symbol": "HOT", "v": np.round(rng.lognormal(5, 2, 30000), 2)})
    dup = pd.DataFrame({"symbol": "DUP", "v": rng.integers(0, 5, 3000).astype(float)})
    one = pd.DataFrame({"symbol": ["ONE"], "v": [7.5]})
    const = pd.DataFrame({"symbol": "CONST", "v": np.full(50, 3.25)})
    df = spark.createDataFrame(pd.concat([hot, dup, one, const]))
    probs = [0.25, 0.5, 0.75]
    got = exact_quantiles(df, "v", probs, bins=8, gather=20).toPandas().set_index("symbol")
    ref = df.groupBy("symbol").agg(F.percentile("v", probs).alias("p")).toPandas() \
        .set_index("symbol")
    for sym in ref.index:
        assert [got.loc[sym, f"q{i}"] for i in range(3)] == list(ref.loc[sym, "p"]), sym


def test_widest_values_end(spark):
    values = [-1.5e308, *(np.linspace(-1, 1, 200) * 1e308).tolist(), 1.5e308]
    missing = [None, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([("A", v) for v in [*values, *missing]], "symbol string, v double")
    got = exact_quantiles(df, "v", [0.0, 0.5, 1.0], bins=8, gather=0).first()
    middle = sorted(values)
    assert (got.q0, got.q2) == (-1.5e308, 1.5e308)
    assert middle[100] <= got.q1 <= middle[101]
