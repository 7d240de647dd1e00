"""Market-level views: sectors, industries, gainers/losers, sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge import schema as S
from tickforge.functions.columns import pct


def sector_dimension(spark: SparkSession, sets: dict | None = None) -> DataFrame:
    """(symbol, sector) from the fixed sector sets (15 rows)."""
    sets = sets or S.SECTOR_SETS
    return spark.createDataFrame([(sym, sec) for sec, syms in sets.items() for sym in syms],
                                 "symbol string, sector string")


def sector_join(df: DataFrame, sectors: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the sector. The dimension has one row per symbol but no proven
    bound, so the broadcast decision is left to AQE's runtime size check."""
    return df.join(sectors.select("symbol", "sector"), "symbol", how)


def industry_join(df: DataFrame, dim: DataFrame, aliases: dict | None = None) -> DataFrame:
    """Left join of the symbol dimension, mapping renamed symbols first."""
    aliases = S.SYMBOL_ALIASES if aliases is None else aliases
    sym = F.col("symbol")
    for old, new in aliases.items():
        sym = F.when(sym == old, F.lit(new)).otherwise(sym)
    d = dim.withColumn("symbol", sym)
    return df.join(d, "symbol", "left")  # AQE broadcasts it when small


def predicted_change(forecast: DataFrame, bars: DataFrame) -> DataFrame:
    """(last prediction - last close) / last close * 100 per symbol."""
    last_pred = forecast.groupBy("symbol").agg(
        F.max_by("predicted_value", "forecast_step").alias("last_prediction"),
        F.max("forecast_step").alias("days"))
    last_close = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"))
    return last_pred.join(last_close, "symbol").withColumn(
        "predicted_change_pct", pct("last_prediction", "last_close"))


def confidence_label(days="days") -> F.Column:
    d = F.col(days)
    return F.when(d <= 7, "High").when(d <= 30, "Medium").otherwise("Low")


def top_movers(changes: DataFrame, n: int = 5, col: str = "predicted_change_pct"
               ) -> tuple[DataFrame, DataFrame]:
    """Top ``n`` gainers (descending) and losers (ascending); symbol breaks ties.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: a per-partition
    top-n, then a merge of n rows per partition."""
    gainers = changes.orderBy(F.col(col).desc(), "symbol").limit(n)
    losers = changes.orderBy(F.col(col).asc(), "symbol").limit(n)
    return gainers, losers


def sector_performance(changes: DataFrame, sectors: DataFrame,
                       col: str = "predicted_change_pct") -> DataFrame:
    """Mean change and number of stocks per sector (0 when the sector is empty)."""
    j = sectors.join(changes.select("symbol", col), "symbol", "left")
    return j.groupBy("sector").agg(F.coalesce(F.avg(col), F.lit(0.0)).alias("avg_change"),
                                   F.count(col).alias("stocks"))


def market_sentiment(changes: DataFrame, col: str = "predicted_change_pct") -> DataFrame:
    n = F.count(F.lit(1))
    bull = F.count_if(F.col(col) > 0)
    bear = F.count_if(F.col(col) < 0)
    return changes.agg(bull.alias("bullish"), bear.alias("bearish"), n.alias("total"),
                       F.when(bull > n / 2, "Bullish").otherwise("Bearish").alias("sentiment"))


def market_analysis(forecast: DataFrame, bars: DataFrame, sectors: DataFrame
                    ) -> dict[str, DataFrame]:
    """Changes per symbol with confidence, movers, sectors and sentiment."""
    ch = predicted_change(forecast, bars).withColumn("confidence", confidence_label("days"))
    g, lo = top_movers(ch)
    return {"changes": ch, "gainers": g, "losers": lo,
            "sectors": sector_performance(ch, sectors), "sentiment": market_sentiment(ch)}
