"""Session helpers.

The library never owns the session: callers pass theirs in. ``local_session``
exists for tests and the bench only.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Observation, SparkSession

# Settings every caller should have. ANSI mode stays on (the default), so
# every division in the library goes through ``try_divide``.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tickforge") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where it is unset a single-process session (``local[...]``, as in tests)
    gets a scratch folder; any other master raises, because a machine-local
    folder would be invisible to the other executors.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tickforge-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``checkpoint()`` has a folder; returns it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()


def cut_lineage(df, counters: dict | None = None, metrics: dict | None = None):
    """Truncate a long plan: write it to the shared folder and read it back.

    Composite operators call this between stages: every "aggregate, then join
    back" step embeds a second copy of its input plan, so deep pipelines grow
    (and recompute) exponentially without a cut. The table is computed once,
    compressed, pruned by column on re-read, and survives the loss of any
    executor.

    ``metrics`` (name: aggregate) are observed in the pass that writes the table and
    put into ``counters``, without another scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    if counters is None or not metrics:
        df.write.parquet(path)
    else:
        watch = Observation(f"cut-{uuid.uuid4().hex}")
        df.observe(watch, *[m.alias(name) for name, m in metrics.items()]).write.parquet(path)
        counters.update(watch.get)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    return os.path.join(shared_folder(spark), "tickforge-tables", name)
