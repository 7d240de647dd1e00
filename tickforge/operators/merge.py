"""Upsert of new bar batches into existing bars, and output ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickforge import schema as S
from tickforge.operators.clean import dedup_keep_last
from tickforge.session import cut_lineage

#: Partition column of a bar table beside the symbol.
MONTH = "month"


def merge_bars(existing: DataFrame, new: DataFrame, key=S.KEY) -> DataFrame:
    """Union existing and new bars and keep the newest batch per key.

    ``batch_no`` orders the inputs (existing = 0, new = 1); keep-last is a
    ``max_by`` aggregate, so hot keys are combined map-side.
    """
    a = existing.withColumn("_batch", F.lit(0))
    b = new.withColumn("_batch", F.lit(1))
    u = a.unionByName(b, allowMissingColumns=True)
    return dedup_keep_last(u, key, "_batch").drop("_batch")


def sort_bars(df: DataFrame, key: str = "symbol", partitions: int | None = None
              ) -> DataFrame:
    """Range-partition by (symbol, date) and sort inside partitions: globally
    ordered files without a single-task sort."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, key, "date").sortWithinPartitions(key, "date")


def _by_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, F.date_format("date", "yyyy-MM"))


def write_bar_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Bars as Parquet by (symbol, month), sorted by date inside files; rows with a
    null symbol or date have partitions of their own. With ``mode`` overwrite only
    the partitions that ``df`` holds are replaced."""
    (_by_month(df).repartition("symbol", MONTH).sortWithinPartitions("symbol", "date").write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("symbol", MONTH).parquet(path))


def read_bar_table(spark, path: str, schema) -> DataFrame:
    """The bars of ``write_bar_table`` in the columns of ``schema``."""
    columns = [f for f in schema.fields if f.name != MONTH]
    full = schema.__class__([*columns, *schema.__class__().add(MONTH, "string").fields])
    return spark.read.schema(full).parquet(path).select(*[f.name for f in columns])


def upsert_bars(spark, path: str, new: DataFrame) -> None:
    """Merge a batch into the bar table at ``path``: the batch wins on (symbol, date).

    Only the (symbol, month) parts that the batch touches are read and rewritten;
    all other files stay as they are. The merged parts are complete in the shared
    folder before the first of them is replaced, so a failure is mended by running
    the batch again.
    """
    new = cut_lineage(new)
    span = _by_month(new).agg(F.min(MONTH).alias("lo"), F.max(MONTH).alias("hi"),
                              F.max(F.col(MONTH).isNull()).alias("none")).first()
    if span["lo"] is None and not span["none"]:
        return  # an empty batch
    columns = [f for f in new.schema.fields]
    full = new.schema.__class__([*columns, *new.schema.__class__().add(MONTH, "string").fields])
    inside = F.col(MONTH).between(span["lo"], span["hi"]) if span["lo"] is not None else F.lit(False)
    near = spark.read.schema(full).parquet(path).where(inside | F.col(MONTH).isNull() if span["none"] else inside)
    touched = _by_month(new).select(F.col("symbol").alias("_s"), F.col(MONTH).alias("_m")).distinct()
    held = near.join(touched, F.col("symbol").eqNullSafe(F.col("_s")) & F.col(MONTH).eqNullSafe(F.col("_m")), "left_semi")
    write_bar_table(cut_lineage(merge_bars(held.drop(MONTH), new)), path, "overwrite")
