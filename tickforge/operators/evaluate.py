"""Forecast evaluation: error metrics, direction, confusion matrix, best model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickforge.functions.columns import safe_div


def _by(by):
    return [by] if isinstance(by, str) else list(by or [])


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       by=("symbol",)) -> DataFrame:
    """n, RMSE, MAE, MSE, R2 after dropping rows with a null on either side."""
    x = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    err = F.col(actual) - F.col(predicted)
    agg = x.groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"), F.sum(err * err).alias("_ss_res"),
        F.var_pop(actual).alias("_var"))
    return agg.select(*_by(by), "n", F.sqrt("mse").alias("rmse"), "mae", "mse",
                      (1 - safe_div(F.col("_ss_res"), F.col("_var") * F.col("n"))).alias("r2"))


def mape(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
         by=("symbol",)) -> DataFrame:
    """Mean |err / actual| * 100, rows with actual = 0 skipped."""
    x = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()
                  & (F.col(actual) != 0))
    return x.groupBy(*_by(by)).agg(
        (F.avg(F.abs((F.col(actual) - F.col(predicted)) / F.col(actual))) * 100).alias("mape"))


def direction_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                      key: str = "symbol", order: str = "date") -> DataFrame:
    """Sign of step changes of both series: accuracy and the 2x2 confusion matrix.

    Up = change > 0. Steps are consecutive rows of a symbol by ``order``; the
    lag runs on the chunked sequence, so a long symbol spans many tasks.
    """
    from tickforge.operators import sequence as seq
    x = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    s = seq.chunked(x.select(key, order, actual, predicted), key, order, back=1)
    w = seq.window(key)
    s = s.select("*", (F.col(actual) - F.lag(actual).over(w) > 0).alias("_au"),
                 (F.col(predicted) - F.lag(predicted).over(w) > 0).alias("_pu"),
                 F.lag(actual).over(w).isNotNull().alias("_has"))
    s = seq.drop_halo(s).filter("_has")
    agg = s.groupBy(key).agg(
        F.count_if(~F.col("_au") & ~F.col("_pu")).alias("tn"),
        F.count_if(~F.col("_au") & F.col("_pu")).alias("fp"),
        F.count_if(F.col("_au") & ~F.col("_pu")).alias("fn"),
        F.count_if(F.col("_au") & F.col("_pu")).alias("tp"))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return agg.withColumn("direction_accuracy", safe_div(F.col("tn") + F.col("tp"), total))


def classification_metrics(conf: DataFrame) -> DataFrame:
    """precision, recall, F1 from tn/fp/fn/tp; 0 when undefined."""
    p = F.coalesce(safe_div(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(safe_div(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(safe_div(2 * p * r, p + r), F.lit(0.0))
    return conf.withColumns({"precision": p, "recall": r, "f1": f1})


_HIGHER_IS_BETTER = {"r2", "direction_accuracy"}


def best_model(metrics: DataFrame, metric: str = "rmse", by=("symbol",),
               model_col: str = "model_name") -> DataFrame:
    """Model with the best metric per group (max for r2/direction accuracy);
    rows with an error or a null metric are ignored; name breaks ties."""
    x = metrics.filter(F.col(metric).isNotNull())
    if "error" in x.columns:
        x = x.filter(F.col("error").isNull())
    if metric in _HIGHER_IS_BETTER:
        pick = F.min_by(model_col, F.struct(-F.col(metric), F.col(model_col)))
        val = F.max(metric)
    else:
        pick = F.min_by(model_col, F.struct(F.col(metric), F.col(model_col)))
        val = F.min(metric)
    return x.groupBy(*_by(by)).agg(pick.alias("best_model"), val.alias(f"best_{metric}"))


def accuracy_vs_price(metrics_pairs: DataFrame, actual: str = "actual",
                      predicted: str = "predicted", by=("symbol",)) -> DataFrame:
    """(1 - MAE / mean actual price) * 100."""
    x = metrics_pairs.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return x.groupBy(*_by(by)).agg(
        ((1 - safe_div(F.avg(F.abs(F.col(actual) - F.col(predicted))), F.avg(actual))) * 100)
        .alias("accuracy_pct"))
