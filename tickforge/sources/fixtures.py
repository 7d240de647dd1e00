"""Bar tables derived from the TPC-H-like test tables.

``first``/``last`` inside a bar are made deterministic by a unique key
(``o_orderkey``, ``event_id``) through ``min_by``/``max_by``, which are
partial aggregates: a hot (symbol, date) group is combined map-side.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _bars(df: DataFrame, symbol: str, date, price: str, order: str) -> DataFrame:
    return (df.groupBy(F.col(symbol).alias("symbol"), date.alias("date"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, order).alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume")))


def bars_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per nation: orders -> customer -> nation (25 rows, broadcast)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                              "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation has 25 rows at every scale factor: a proven broadcast bound
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))
    return _bars(j, "n_name", F.col("o_orderdate"), "o_totalprice", "o_orderkey")


def bars_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return _bars(o, "o_orderpriority", F.col("o_orderdate"), "o_totalprice", "o_orderkey")


def bars_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return _bars(e, "event_type", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"),
                 "value", "event_id")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector): nation name -> region name. Fixed 25 rows (region: 5)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector")))


def symbol_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company name, industry, symbol, series, ISIN-like code per nation symbol."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.concat(F.col("n_name"), F.lit(" LTD")).alias("company_name"),
                    F.col("r_name").alias("industry"), F.col("n_name").alias("symbol"),
                    F.lit("EQ").alias("series"),
                    F.format_string("IN%010d", F.col("n_nationkey")).alias("isin_code")))


def quotes_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty quotes for cleaning tests (rules in FIXTURES.md B2)."""
    o = table(spark, sf_dir, "orders")
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    base = o.select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"),
        (2 * k).alias("ingest_seq"),
        F.when(k % 31 == 0, F.lit(None).cast("double")).otherwise(p).alias("open"),
        F.when(k % 37 == 0, 0.5 * p).otherwise(1.02 * p).alias("high"),
        F.when(k % 41 == 0, F.lit(None).cast("double")).otherwise(0.98 * p).alias("low"),
        F.when(k % 43 == 0, -p).when(k % 47 == 0, F.lit(None).cast("double"))
         .when(k % 101 == 0, 50 * p).otherwise(1.01 * p).alias("close"),
        F.when(k % 53 == 0, F.lit(None).cast("double"))
         .otherwise((k % 1000).cast("double")).alias("volume"))
    fixes = o.filter(k % 13 == 0).select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"),
        (2 * k + 1).alias("ingest_seq"), p.alias("open"), (1.02 * p).alias("high"),
        (0.98 * p).alias("low"), (1.005 * p).alias("close"),
        (k % 1000).cast("double").alias("volume"))
    return base.unionByName(fixes)
