"""No operator loses rows with null keys, exact re-deliveries or odd numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickforge.operators import analytics as A
from tickforge.operators import clean as C
from tickforge.operators import sequence as seq
from tickforge.operators.quantiles import exact_quantiles

D = [dt.datetime(2024, 1, d) for d in range(1, 20)]
SCHEMA = "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double, ingest_seq long"


def bar(symbol, date, close=10.0, n=0, volume=1.0, open_=10.0):
    return (symbol, date, open_, 12.0, 8.0, close, volume, n)


@pytest.fixture
def dirty(spark):
    rows = [bar("A", D[0]), bar("A", D[0]), bar("A", D[0], n=1, close=11.0), bar("A", D[1], close=None),
            bar("A", None), bar(None, D[0]), bar(None, D[1], volume=None), bar(None, None), bar("B", D[0], volume=-1.0),
            bar("B", D[1], close=50.0), bar("C", D[2]), bar("C", D[2]), bar("C", D[2])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("with_seq", [True, False])
def test_good_and_rejects_are_the_input(dirty, with_seq):
    df = dirty if with_seq else dirty.drop("ingest_seq")
    good, bad = C.validate(df)
    assert good.count() + bad.count() == df.count()
    assert good.groupBy("symbol", "date").count().where("count > 1").count() == 0
    got = sorted(map(str, good.unionByName(bad.drop("reject_reason")).collect()))
    assert got == sorted(map(str, C.cast_types(df).select(*good.columns).collect()))


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter" in line]


def test_rejects_of_text_parse_a_value_once(dirty):
    """No filter repeats the parsing: each mention of a price would be one more."""
    text = dirty.select(*[F.col(c).cast("string").alias(c) if c != "ingest_seq" else F.col(c) for c in dirty.columns])
    good, bad = C.validate(text)
    assert _filters(bad) and not [f for f in _filters(bad) if "cast" in f]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count("try_cast") <= 6 for line in plan.splitlines())
    assert sorted(map(str, good.unionByName(bad.drop("reject_reason")).collect())) == sorted(
        map(str, C.cast_types(text).select(*good.columns).collect()))


def test_bars_and_rejects_share_one_count_of_rows(dirty):
    """Derived prices are not computed again in a filter, and the rows that are
    counted per key are shuffled once, not for the bars and the rejects each."""
    df = dirty.unionByName(dirty).withColumn("high", F.when(F.col("ingest_seq") % 37 == 0, 3.25 * F.col("high")).otherwise(F.col("high")))
    good, bad = C.validate(df)
    both = good.withColumn("reject_reason", F.lit("kept")).unionByName(bad)
    assert _filters(both) and not [f for f in _filters(both) if "3.25" in f]
    got = both.groupBy("reject_reason").agg(F.count("*").alias("n"))
    counts = {r.reject_reason: r.n for r in got.collect()}
    assert sum(counts.values()) == 2 * dirty.count() and counts["kept"] == good.count()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_null_keys_keep_their_rows(dirty):
    assert C.fill_prices(dirty).count() == dirty.count()
    x = seq.with_position(dirty, tiebreak=("ingest_seq",))
    assert x.count() == dirty.count()
    nulls = x.where("symbol is null").orderBy("_rn").collect()
    assert [r._rn for r in nulls] == [0, 1, 2] and nulls[0].date is None
    assert A.tail_n(dirty, 100).count() == dirty.count()
    assert C.fill_volume_median(dirty).where("symbol is null and volume is null").count() == 0


def test_nan_and_infinity_are_missing(spark):
    rows = [("A", "2024-01-01", "NaN", "inf", "1", "2", "3"), ("A", "2024-01-02", "1", "2", "1", "NaN", "3"),
            ("A", "2024-01-03", "1", "2", "1", "-Infinity", "3"), ("A", "2024-01-04", "1", "2", "1", "1.5", "x")]
    text = spark.createDataFrame(rows, "symbol string, date string, open string, high string, low string, close string, volume string")
    out = C.cast_types(text).orderBy("date").collect()
    assert [r.close for r in out] == [2.0, None, None, 1.5] and out[0].open is None and out[0].high is None
    assert [r.close for r in C.clean_spark_bars(text).orderBy("date").collect()] == [2.0, 1.5]
    numbers = spark.createDataFrame([("A", D[0], float("nan"), 1.0, 1.0, float("inf"), 1.0)],
                                    "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double")
    r = C.cast_types(numbers).first()
    assert r.open is None and r.close is None


def test_quantiles_of_a_null_group_and_many_passes(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("a", 10.0 ** i) for i in range(-40, 40)],
                               "symbol string, v double")
    got = {r.symbol: r.q0 for r in exact_quantiles(df, "v", [0.5], bins=2, gather=0).collect()}
    want = {r.symbol: r.q for r in df.groupBy("symbol").agg(F.percentile("v", 0.5).alias("q")).collect()}
    assert got == want


def test_counts_are_summed_before_the_shuffle_by_group(spark):
    """With broadcast joins off an exchange lies between partial and final sums."""
    rows = [("hot", float(i), D[i % 19]) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, close double, date timestamp_ntz")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.outlier_counts(df, columns=("close",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = plan[:plan.index("SortMergeJoin")]
    assert top.count("HashAggregate") >= 2 and "Exchange" in top
