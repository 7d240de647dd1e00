"""Per-symbol ordering without putting a whole symbol into one task.

A plain ``Window.partitionBy("symbol").orderBy("date")`` sends every bar of
a symbol to one task; one hot symbol holding a third of all rows would then
serialise the job. This module gives every bar a dense position ``_rn``
inside its symbol, numbered per time bucket in parallel and offset by the
sizes of earlier buckets, then cuts each symbol into chunks of
``chunk_rows`` positions. Windows run over ``(symbol, _ck)``; bounded frames
(rolling means, lags, leads) stay exact by copying the last ``back`` rows of
the previous chunk and the first ``fwd`` rows of the next one into each chunk
as *halo* rows, which are dropped after the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RN, CK, HALO = "_rn", "_ck", "_halo"
DEFAULT_CHUNK_ROWS = 1 << 20
# Time bucket that numbers rows in parallel; a finer unit for denser data.
DEFAULT_BUCKET = "month"


def group_key(c: str):
    """A never-null stand-in for a key column: a null key is a group of its own.

    Plain equality on it keeps the partitioning of the window that precedes a
    join; a null-safe comparison would shuffle the rows again.
    """
    return F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))


def with_position(df: DataFrame, key: str = "symbol", order: str = "date",
                  tiebreak: tuple[str, ...] = (), bucket: str = DEFAULT_BUCKET
                  ) -> DataFrame:
    """Add ``_rn``: 0-based position of each row inside its ``key`` by ``order``.

    ``(key, order, *tiebreak)`` should be unique. Rows are numbered inside
    deterministic time buckets ``(key, date_trunc(bucket, order))`` (many tasks
    per symbol); the bucket sizes, a table of #symbols x #buckets rows, are
    prefix-summed per symbol and joined back as offsets. Everything is a pure
    function of the row, so recomputation after a lost executor gives the same
    numbers. No row is lost: null keys form one group, null ``order`` values
    come first in theirs.
    """
    x = df.withColumn("_gk", group_key(key)).withColumn("_bk", F.coalesce(
        F.date_trunc(bucket, F.col(order)).cast("string"), F.lit("")))
    wb = Window.partitionBy("_gk", "_bk").orderBy(order, *tiebreak)
    x = x.withColumn("_lrn", F.row_number().over(wb) - 1)
    sizes = x.groupBy("_gk", "_bk").agg(F.count(F.lit(1)).alias("_cnt"), F.min(order).alias("_first"))
    before = Window.partitionBy("_gk").orderBy(F.col("_first").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    offs = sizes.select("_gk", "_bk",
                        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    out = x.join(offs, ["_gk", "_bk"])
    return out.withColumn(RN, F.col("_lrn") + F.col("_off")).drop("_gk", "_bk", "_lrn", "_off")


def join_on_key(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys; ``other`` gives its other columns."""
    right = other.select(*[group_key(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in other.columns if c not in keys])
    left = df.withColumns({f"_l_{k}": group_key(k) for k in keys})
    on = [F.col(f"_l_{k}") == F.col(f"_r_{k}") for k in keys]
    return left.join(right, on, how).drop(*[f"_{s}_{k}" for s in "lr" for k in keys])


def salted_join(df: DataFrame, per_key: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Left join of rows with a table of one row per key, a hot key split over ``salts``
    tasks. What aggregates the result by key shuffles partial sums, not rows."""
    left = df.withColumns({"_gk": group_key(key), "_salt": F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")})
    right = per_key.select(group_key(key).alias("_gk"), *[c for c in per_key.columns if c != key],
                           F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return left.join(right, ["_gk", "_salt"], "left").drop("_gk", "_salt")


def chunked(df: DataFrame, key: str = "symbol", order: str = "date", back: int = 0,
            fwd: int = 0, chunk_rows: int = DEFAULT_CHUNK_ROWS,
            tiebreak: tuple[str, ...] = (), positioned: bool = False,
            bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """Position rows and add ``_ck`` and halo copies for bounded frames.

    ``back``: rows of history a frame needs (window length - 1, or a lag);
    ``fwd``: rows of future (a lead). Both must not exceed ``chunk_rows``.
    """
    if back > chunk_rows or fwd > chunk_rows:
        raise ValueError("halo larger than a chunk")
    s = df if positioned else with_position(df, key, order, tiebreak, bucket)
    ck = F.floor(F.col(RN) / chunk_rows).cast("long")
    pos = F.col(RN) % chunk_rows
    copies = [F.struct(ck.alias(CK), F.lit(False).alias(HALO))]
    if back:
        copies.append(F.when(pos >= chunk_rows - back,
                             F.struct((ck + 1).alias(CK), F.lit(True).alias(HALO))))
    if fwd:
        copies.append(F.when((pos < fwd) & (ck > 0),
                             F.struct((ck - 1).alias(CK), F.lit(True).alias(HALO))))
    if len(copies) == 1:
        out = s.withColumn(CK, ck).withColumn(HALO, F.lit(False))
    else:
        arr = F.filter(F.array(*copies), lambda c: c.isNotNull())
        out = s.select("*", F.inline(arr))
    # The window stages after this exchange are CPU-heavy; an explicit
    # partition count keeps AQE from coalescing a small input into one task.
    return out.repartition(_partitions(df), key, CK)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def window(key: str = "symbol") -> Window:
    """The ordered window of a chunked frame."""
    return Window.partitionBy(key, CK).orderBy(RN)


def drop_halo(df: DataFrame, keep_position: bool = False) -> DataFrame:
    out = df.filter(~F.col(HALO)).drop(HALO)
    return out if keep_position else out.drop(RN, CK)
