"""Model preparation, gradient-boosted trees over all symbols, persistence."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple
from uuid import uuid4

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickforge import schema as S
from tickforge.functions.columns import safe_div
from tickforge.operators import sequence as seq
from tickforge.operators.features import MODEL_FEATURES
from tickforge.operators.forecast import random_split
from tickforge.session import cut_lineage


def prepare_for_modeling(df: DataFrame, target: str = "target", drop_na: bool = True
                         ) -> DataFrame:
    """Numeric columns + date (+ symbol), rows with any null dropped."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "long")]
    keep = [c for c in ("symbol", "date") if c in df.columns] + numeric
    x = df.select(*keep)
    return x.dropna() if drop_na else x


def standard_scale(train: DataFrame, other: DataFrame | None = None,
                   features=MODEL_FEATURES) -> tuple[DataFrame, DataFrame | None]:
    """z-score fitted on ``train`` only (sample std), applied to both frames."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="scaled", withMean=True, withStd=True)
    model = Pipeline(stages=[asm, scaler]).fit(train)
    return (model.transform(train).drop("_raw"),
            model.transform(other).drop("_raw") if other is not None else None)


ROUNDS, PATIENCE, LEARNING_RATE, DEPTH = 500, 50, 0.05, 5
#: Trees of the first fit, in patiences; rows a task gets in training.
FIRST_FIT, TASK_ROWS = 2, 20_000
#: Share of a symbol's training bars, its latest, that early stopping watches.
VALIDATION_FRACTION = 0.1


class Trained(NamedTuple):
    """A fitted pipeline, its test predictions and its validation curve."""

    model: PipelineModel
    predictions: DataFrame
    curve: list[float]


def training_rows(features: DataFrame, split: str = "temporal", key: str = "symbol") -> DataFrame:
    """One row per bar with complete features: the features, ``actual`` = the next
    close, ``label`` = the log return to it (trees cannot extrapolate price levels,
    and log returns do not drift upwards when steps are chained) and ``part``:
    train, validation or test. Bars without a positive close have no label.

    ``split`` temporal: a symbol's latest fifth is test, the latest tenth of the
    rest validation; the bar before each border is left out, as its label lies
    beyond. ``random``: bars by hash are test, whole months by hash validation.
    """
    x = prepare_for_modeling(features, drop_na=False).dropna(subset=[*MODEL_FEATURES, "target"])
    x = x.where("close > 0 and target > 0").withColumn("label", F.ln(F.col("target") / F.col("close")))
    x = x.withColumnRenamed("target", "actual")
    if split == "random":
        month = F.concat_ws("|", F.col(key), F.date_format("date", "yyyy-MM"))
        held = F.conv(F.substring(F.md5(month), 1, 8), 16, 10).cast("long") % 100 < round(100 * VALIDATION_FRACTION)
        return random_split(x).withColumn("part", F.when(~F.col("is_train"), "test").when(held, "validation")
                                          .otherwise("train")).drop("is_train")
    n = x.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    placed = seq.join_on_key(seq.with_position(x, key, "date"), n, [key], "inner")
    at, test = F.col(seq.RN), F.floor(F.col("_n") * S.TRAIN_FRACTION)
    late = F.floor(test * (1 - VALIDATION_FRACTION))
    part = (F.when(at >= test, "test").when(at == test - 1, None).when(at >= late, "validation")
            .when(at == late - 1, None).otherwise("train"))
    return placed.withColumn("part", part).where("part is not null").drop(seq.RN, "_n")


def kept_rounds(curve: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Rounds up to the least error that ``patience`` further rounds did not undercut,
    and whether the curve is long enough to say so."""
    best = 0
    for i, error in enumerate(curve):
        if error < curve[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def _booster(rounds: int, depth: int, step: float, seed: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="label", maxDepth=depth, stepSize=step, maxIter=rounds,
                        subsamplingRate=0.8, featureSubsetStrategy="0.9", seed=seed)


def _partitions(train: DataFrame) -> int:
    """A tree level is one job, so few rows are better off in few tasks."""
    most = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, train.count() // TASK_ROWS + 2))


def _prefix(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The ensemble of the first ``rounds`` trees."""
    java, jvm = model._java_obj, SparkSession.getActiveSession()._jvm
    gateway = SparkSession.getActiveSession().sparkContext._gateway
    ml = jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(ml.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(java.trees()[:rounds], model.treeWeights[:rounds], strict=True)):
        trees[i], weights[i] = tree, weight
    cut = ml.GBTRegressionModel(f"{model.uid}_{uuid4().hex[:8]}", trees, weights)
    return GBTRegressionModel(model._java_obj.copyValues(cut, model._java_obj.extractParamMap()))


def gbt_fit(rows: DataFrame, rounds: int = ROUNDS, patience: int = PATIENCE, depth: int = DEPTH,
            step: float = LEARNING_RATE, seed: int = 42, features=MODEL_FEATURES) -> tuple[PipelineModel, list[float]]:
    """Assemble -> z-score -> boosted trees on the train rows, stopped by the validation
    rows: the shortest prefix that ``patience`` further rounds do not improve on.

    Spark's own stop has no patience, so trees are fitted without one and the curve
    of all prefixes is read off the validation rows in one pass. A fit of fewer
    rounds holds the first trees of a longer one with its seed, so the longest is
    only fitted if the curve asks for it. Returns the pipeline and the curve (mean
    squared error after each round; empty without validation rows, which keeps all).
    """
    asm = VectorAssembler(inputCols=list(features), outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    parts = {p: rows.where(F.col("part") == p) for p in ("train", "validation")}
    prepared = Pipeline(stages=[asm, scaler]).fit(parts["train"])
    train, held = (prepared.transform(parts[p]).select("features", "label") for p in ("train", "validation"))
    if held.isEmpty():
        return PipelineModel([*prepared.stages, _booster(rounds, depth, step, seed).fit(train)]), []
    n = min(rounds, FIRST_FIT * patience)
    train = train.repartition(_partitions(train))
    while True:
        model = _booster(n, depth, step, seed).fit(train)
        curve = list(model.evaluateEachIteration(held, "squared"))
        kept, settled = kept_rounds(curve, patience)
        if settled or n == rounds:
            break
        n = min(rounds, max(kept, n // 2) + 2 * patience)
    return PipelineModel([*prepared.stages, _prefix(model, kept) if kept < n else model]), curve


def gbt_train(features: DataFrame, split: str = "temporal", rounds: int = ROUNDS, patience: int = PATIENCE) -> Trained:
    """Fit one model on all symbols; predict the next close of every test bar."""
    rows = cut_lineage(training_rows(features, split))
    model, curve = gbt_fit(rows, rounds, patience)
    pred = model.transform(rows.where("part = 'test'")).select(
        "symbol", "date", "actual", (F.col("close") * F.exp("prediction")).alias("predicted"))
    return Trained(model, pred, curve)


def validation_curve(spark: SparkSession, trained: Trained) -> DataFrame:
    """(round, error, kept): the error on the validation rows after each round."""
    n = trained.model.stages[-1].getNumTrees
    rows = [(i + 1, float(e), i < n) for i, e in enumerate(trained.curve)]
    return spark.createDataFrame(rows, "round int, error double, kept boolean")


def feature_importance(spark: SparkSession, model: PipelineModel,
                       features=MODEL_FEATURES) -> DataFrame:
    """(feature, importance, rank) of the fitted trees, most important first."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    imp += [0.0] * (len(features) - len(imp))  # features after the last one that a tree asks for
    rows = [(f, float(v)) for f, v in zip(features, imp, strict=True)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature")


#: Closes that the features of a bar look back on.
HISTORY = 51


def close_features(closes: Column) -> dict[str, Column]:
    """The features that depend on closes alone, from an array of the last closes."""
    last = lambda k: F.element_at(closes, -1 - k)
    tail = lambda n: F.slice(closes, -n, n)
    add = lambda a, v: a + v

    def mean(n: int) -> Column:
        return F.aggregate(tail(n), F.lit(0.0), add) / n

    def std(n: int) -> Column:
        # a one-element array binds the mean to a name, so it is computed once
        return F.transform(F.array(mean(n)), lambda m: F.sqrt(
            F.aggregate(tail(n), F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (n - 1)))[0]

    steps = F.transform(F.sequence(F.lit(-S.RSI_PERIOD), F.lit(-1)),
                        lambda i: F.element_at(closes, i) - F.element_at(closes, i - 1))
    gain = F.aggregate(steps, F.lit(0.0), lambda a, v: a + F.greatest(v, F.lit(0.0)))
    loss = F.aggregate(steps, F.lit(0.0), lambda a, v: a - F.least(v, F.lit(0.0)))
    out = {"close": last(0)}
    out |= {f"return_{n}d": safe_div(last(0), last(n)) - 1 for n in (1, 5, 20)}
    out |= {f"ma_{n}": mean(n) for n in (5, 10, 20, 50)}
    out |= {"close_to_ma5": safe_div(last(0), mean(5)), "close_to_ma20": safe_div(last(0), mean(20)),
            "ma5_to_ma20": safe_div(mean(5), mean(20))}
    out |= {f"volatility_{n}d": std(n) for n in (5, 20)}
    # without any change the last known value stands, as a tree needs one
    out["rsi_14"] = F.coalesce(F.when(loss == 0, F.when(gain > 0, F.lit(100.0)))
                               .otherwise(100 - 100 / (1 + gain / loss)), F.lit(50.0))
    out |= {f"close_lag_{k}": last(k) for k in S.MODEL_LAGS}
    return out


def _states(features: DataFrame) -> DataFrame:
    """One row per symbol: last date and close, the newest bar with complete features
    (null without one), the closes up to it, at most ``HISTORY``, and ``_span``, the
    ratio of the highest to the lowest positive close."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in MODEL_FEATURES])
    ends = cut_lineage(features.groupBy("symbol").agg(
        F.max("date").alias("_last"), F.max_by("close", "date").alias("_close"),
        F.try_divide(F.max("close"), F.min(F.when(F.col("close") > 0, F.col("close")))).alias("_span"),
        F.max(F.when(full, F.col("date"))).alias("_at"),
        F.max_by(F.struct(*MODEL_FEATURES), F.when(full, F.col("date"))).alias("_f")))
    upto = seq.join_on_key(features.select("symbol", "date", "close"), ends.select("symbol", "_at"), ["symbol"], "inner")
    placed = seq.with_position(upto.where("date <= _at"), "symbol", "date")
    n = placed.groupBy("symbol").agg(F.max(seq.RN).alias("_n"))
    late = seq.join_on_key(placed, n, ["symbol"], "inner").where(F.col(seq.RN) > F.col("_n") - HISTORY)
    # at most HISTORY rows a symbol
    closes = late.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(seq.RN, "close"))).alias("_c"))
    return seq.join_on_key(ends, closes.select("symbol", F.transform("_c", lambda x: x["close"]).alias("_closes")), ["symbol"])


def gbt_forecast(model: PipelineModel, features: DataFrame, days: int = 30, cut_every: int = 10) -> DataFrame:
    """Forecast of the next ``days`` calendar days from each symbol's newest bar with
    complete features, step by step: a predicted close joins the history and what
    depends on closes is computed anew; open, high, low, volume and their ratios
    stay those of the last bar. A symbol without such a bar keeps its last close
    (``model_used`` last_close). Chained returns can add up without end where few bars
    jump by orders of magnitude, so no forecast is further from the newest close than
    the symbol's highest and lowest closes are from each other (as a ratio).

    The state is one row a symbol (its last closes and the path so far), cut off from
    its lineage every ``cut_every`` steps, so any number of days can be asked for.
    """
    start = cut_lineage(_states(features))
    held = [c for c in MODEL_FEATURES if c not in close_features(F.col("_closes"))]
    # null, and so no bound, without a positive close
    newest = F.when(F.col("_f.close") > 0, F.col("_f.close"))
    bounds = [F.try_divide(newest, F.col("_span")).alias("_least"), (newest * F.col("_span")).alias("_most")]
    state = start.where("_f is not null").select(
        "symbol", "_last", "_closes", *bounds, *[F.col(f"_f.{c}").alias(c) for c in MODEL_FEATURES],
        F.array().cast("array<double>").alias("_path"))
    for step in range(days):
        if step:
            state = state.select("symbol", "_last", "_closes", "_path", "_least", "_most", *held, *[
                v.alias(k) for k, v in close_features(F.col("_closes")).items()])
        said = F.greatest(F.least(F.col("close") * F.exp("prediction"), F.col("_most")), F.col("_least"))
        state = model.transform(state).select("symbol", "_last", "_closes", "_path", "_least", "_most", *held, said.alias("_said"))
        state = state.select("symbol", "_last", "_least", "_most", *held, F.concat("_path", F.array("_said")).alias("_path"),
                             F.concat(F.slice("_closes", F.greatest(F.lit(1), F.size("_closes") - HISTORY + 2), F.lit(HISTORY)),
                                      F.array("_said")).alias("_closes"))
        if step % cut_every == cut_every - 1:
            state = cut_lineage(state)
    said = state.select("symbol", "_last", F.posexplode("_path").alias("_step", "predicted_value"), F.lit("gbt").alias("model_used"))
    rest = start.where("_f is null").select(
        "symbol", "_last", F.posexplode(F.array_repeat("_close", days)).alias("_step", "predicted_value"),
        F.lit("last_close").alias("model_used"))
    return said.unionByName(rest).select(
        "symbol", (F.col("_step") + 1).alias("forecast_step"),
        F.date_add("_last", F.col("_step") + 1).cast("timestamp_ntz").alias("date"), "predicted_value", "model_used")


_META = "feature_names array<string>, lookback int, trees int, curve array<double>"


def model_save(model: PipelineModel, path: str, curve: list[float] = ()) -> str:
    """Scaler and trees, and beside them what a caller must know to use them."""
    model.write().overwrite().save(path + "/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(list(MODEL_FEATURES), S.LOOKBACK, model.stages[-1].getNumTrees, list(map(float, curve)))],
                          _META).coalesce(1).write.mode("overwrite").json(path + "/metadata")
    return path


def model_load(path: str) -> tuple[PipelineModel, dict]:
    """The fitted pipeline and its metadata; raises if the features differ from ours."""
    spark = SparkSession.getActiveSession()
    meta = spark.read.schema(_META).json(path + "/metadata").first().asDict()
    if meta["feature_names"] != list(MODEL_FEATURES):
        raise ValueError("the model was trained on other features")
    return PipelineModel.load(path + "/model"), meta


def scaled_array(df: DataFrame, col: str = "scaled") -> DataFrame:
    return df.withColumn(col, vector_to_array(col))
