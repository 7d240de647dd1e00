"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickforge.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; no two calls share one."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes ``df`` once, compressed and
    column-pruned on re-read; survives the loss of any executor.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    folders = {f.rsplit("/llm-", 1)[0] + "/llm-" + f.rsplit("/llm-", 1)[1].split("/")[0]
               for f in df.inputFiles() if "/llm-" in f}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
