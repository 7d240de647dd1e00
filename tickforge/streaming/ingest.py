"""Streaming ingest and resampling with restartable, idempotent sinks.

Every micro-batch is written by ``foreachBatch`` to a folder of its own, named
by the query's id and the epoch. The id lives in the checkpoint, so a restarted
query goes on where it stopped and a replayed batch rewrites the same folder,
while a query with a new checkpoint never touches what an older one wrote. The
current table is the keep-last view over all folders; ``compact_bars`` folds
them into one.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickforge import schema as S
from tickforge.operators.clean import dedup_keep_last, validate_bars


def default_checkpoint(target: str) -> str:
    """Beside the target and as lasting as it: the same after every restart."""
    return target.rstrip("/") + "-checkpoint"


def _epoch_writer(target: str, checkpoint: str, transform):
    def write(batch: DataFrame, epoch_id: int) -> None:
        told = batch.sparkSession.read.text(os.path.join(checkpoint, "metadata")).first()[0]
        folder = f"batch={json.loads(told)['id']}-{epoch_id}"
        out = transform(batch)
        out.withColumn("_epoch", F.lit(epoch_id).cast("long")).write.mode("overwrite") \
            .parquet(os.path.join(target, folder))
    return write


def stream_ingest(spark: SparkSession, source_dir: str, target: str, schema: T.StructType,
                  checkpoint_location: str | None = None, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, redelivery: str | None = None) -> DataFrame:
    """Landed quote files -> validation -> keep-last upsert into ``target``.

    Stateless by default: re-delivered rows and late rows are written like all
    others and resolved by the keep-last view, so nothing is dropped for its age
    and no state grows with the stream. ``redelivery``: see ``run_ingest``.
    """
    run_ingest(spark, source_dir, target, schema, checkpoint_location, fmt, max_files_per_trigger, redelivery)
    return current_bars(spark, target)


def run_ingest(spark: SparkSession, source_dir: str, target: str, schema: T.StructType,
               checkpoint_location: str | None = None, fmt: str = "parquet",
               max_files_per_trigger: int | None = None, redelivery: str | None = None):
    """Process all files that have landed; returns the finished query.

    With ``redelivery`` (a duration) a row that comes again within that time is not
    written again. Its age is that of the file that brought it, not that of its
    date, so late bars are never dropped; the state holds the keys that arrived
    within the duration and no others.
    """
    checkpoint = checkpoint_location or default_checkpoint(target)
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.load(source_dir)
    if redelivery:
        rows = (rows.withColumn("_arrived", F.col("_metadata.file_modification_time"))
                .withWatermark("_arrived", redelivery)
                .dropDuplicatesWithinWatermark([*S.KEY, "ingest_seq"]).drop("_arrived"))
    q = (rows.writeStream.foreachBatch(_epoch_writer(target, checkpoint, validate_bars))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def current_bars(spark: SparkSession, target: str) -> DataFrame:
    """Keep-last view over all ingested batches (largest ingest_seq wins)."""
    allb = spark.read.parquet(target).drop("_epoch", "batch")
    return dedup_keep_last(allb, S.KEY, "ingest_seq")


def compact_bars(spark: SparkSession, target: str) -> None:
    """Fold all batch folders into one.

    The folded copy is written before the folders that it replaces go; a failure
    in between, or a replayed batch later, leaves rows twice, which keep-last
    resolves.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(conf)
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=")]
    if len(old) > 1:
        current_bars(spark, target).withColumn("_epoch", F.lit(-1).cast("long")).write.parquet(
            os.path.join(target, f"batch=base-{uuid.uuid4().hex}"))
        for folder in old:
            fs.delete(folder, True)


def _tick_bars(ticks: DataFrame, interval: str, symbol: str, price: str, order: str) -> DataFrame:
    """Bars per tumbling window of ``_t``."""
    bars = (ticks.groupBy(F.window("_t", interval), F.col(symbol).alias("symbol"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, order).alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume"),
                 F.max(order).alias("_last_id")))
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("date"),
                       "open", "high", "low", "close", "volume", "_last_id")


def stream_resample(spark: SparkSession, source_dir: str, target: str, schema: T.StructType,
                    checkpoint_location: str | None = None, interval: str = "1 hour",
                    watermark: str = "30 days", symbol: str = "event_type", ts: str = "ts", price: str = "value",
                    order: str = "event_id", max_files_per_trigger: int | None = None
                    ) -> DataFrame:
    """Ticks -> bars per tumbling window in update mode; state is dropped once
    the watermark passes a window, rows later than the watermark are ignored."""
    checkpoint = checkpoint_location or default_checkpoint(target)
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ticks = reader.load(source_dir).withColumn("_t", F.col(ts).cast("timestamp"))
    bars = _tick_bars(ticks.withWatermark("_t", watermark), interval, symbol, price, order)
    q = (bars.writeStream.outputMode("update")
         .foreachBatch(_epoch_writer(target, checkpoint, lambda b: b))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    # an updated window supersedes its earlier emission: it has counted more ticks
    allb = spark.read.parquet(target).drop("batch").withColumn("_order", F.struct("volume", "_epoch"))
    latest = dedup_keep_last(allb, S.KEY, "_order")
    return latest.drop("_order", "_epoch", "_last_id")


def _on_time_writer(target: str, delay: str, interval: str):
    """Splits a batch by the latest tick of the batches before it: what falls into a
    window that ended ``delay`` before that tick goes to ``late``, the rest to ``ticks``."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        part = lambda name, epoch: os.path.join(target, name, f"epoch={epoch}")
        if _exists(spark, os.path.join(part("ticks", epoch_id), "_SUCCESS")):
            return  # a replay: the next step may have read these files
        before = spark.read.parquet(part("seen", epoch_id - 1)).first()["latest"] if epoch_id else None
        late = F.lit(False) if before is None else (
            F.window("_t", interval).end <= F.lit(before) - F.expr(f"INTERVAL {delay}"))
        rows = batch.where("_t is not null").withColumn("_late", late).unionByName(
            batch.where("_t is null").withColumn("_late", F.lit(True))).persist()
        latest = rows.agg(F.max(F.greatest("_t", F.lit(before).cast("timestamp"))).alias("latest"))
        latest.select(F.coalesce("latest", F.lit(before).cast("timestamp")).alias("latest")).write.mode(
            "overwrite").parquet(part("seen", epoch_id))
        rows.where("_late").drop("_late", "_t").write.mode("overwrite").parquet(part("late", epoch_id))
        rows.where("not _late").drop("_late", "_t").write.mode("overwrite").parquet(part("ticks", epoch_id))
        rows.unpersist()
    return write


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def stream_resample_closed(spark: SparkSession, source_dir: str, target: str, schema: T.StructType,
                           interval: str = "1 hour", watermark: str = "1 day", symbol: str = "event_type",
                           ts: str = "ts", price: str = "value", order: str = "event_id",
                           max_files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, late ticks): append mode, every window once, when the watermark passes it.

    Two queries in a row. The first sets late ticks aside: those whose window had
    ended ``watermark`` before the latest tick of an earlier batch. The second
    aggregates the others; as it sees no batch before the first has split it, its
    own watermark never drops what the first let through. Ticks of windows still
    open are in neither result. Ticks without a time are late.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ticks = reader.load(source_dir).withColumn("_t", F.col(ts).cast("timestamp"))
    split = (ticks.writeStream.foreachBatch(_on_time_writer(target, watermark, interval))
             .option("checkpointLocation", default_checkpoint(target) + "-split").trigger(availableNow=True).start())
    split.awaitTermination()
    checkpoint = default_checkpoint(target)
    good = spark.readStream.schema(schema).parquet(os.path.join(target, "ticks", "*")).withColumn(
        "_t", F.col(ts).cast("timestamp"))
    bars = _tick_bars(good.withWatermark("_t", watermark), interval, symbol, price, order)
    q = (bars.writeStream.outputMode("append")
         .foreachBatch(_epoch_writer(os.path.join(target, "bars"), checkpoint, lambda b: b))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    done = spark.read.parquet(os.path.join(target, "bars")).drop("batch", "_epoch", "_last_id")
    return done, spark.read.schema(schema).parquet(os.path.join(target, "late", "*"))
