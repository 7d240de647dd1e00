"""Registered queries against their DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
FAST = ["resample_bars", "technical_features", "clean_bars", "validate_bars", "analyze_symbols",
        "drift_forecast", "merge_bars", "market_analysis", "regression_metrics",
        "direction_metrics", "stationarity", "outliers_iqr", "tail_n", "model_features",
        "source_failover", "stream_resample", "ar_forecast", "random_split", "best_model_drift_ar",
        "gbt_training_rows"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    r = compare(E.queries()[name](spark, SF), E.oracle_sql()[name], con)
    assert r["rows"][0] == r["rows"][1] and r["cols_match"] and r["hash_match"], r


#: Fitted models; their recovery and properties are tested in test_models.py.
MODELS = {"gbt_train", "gbt_forecast", "gbt_validation_curve", "feature_importance", "top_features", "model_save_load", "gbt_metrics",
          "seasonal_trend_forecast", "seasonal_metrics", "ar_order_select", "arp_forecast", "arima_forecast",
          "arima_metrics", "adf_test", "select_and_forecast_all", "best_model", "select_and_forecast", "end_to_end"}


def test_every_query_has_oracle_or_is_model():
    ours = {k for k in E.queries() if not k.startswith("op") and k != "pipeline"}
    assert ours - set(E.oracle_sql()) == MODELS


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 25 and "total_return_percent" in df.columns
