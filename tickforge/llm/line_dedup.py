"""Line dedup over levelled sorted runs of line hashes, DataFrame functions only.

Documents arrive in batches ordered by id. ``LineIndex`` keeps the first holder
of every line key seen so far in sorted, bucketed runs. A batch aggregates its
own keys (partially, before the shuffle), merge-joins them with the runs —
bucketed tables, so the runs are never shuffled again — and adds the unmatched
keys (the anti-join) as a new run of level 0. ``fanout`` runs of one level are
compacted to one run of the next, so a key is rewritten a logarithmic number of
times. A line goes if an earlier document holds its key.

Line keys are compared by two independent 64-bit hashes.

Defined results
* null or empty text: one empty line, nothing dropped.
* null ids sort after every id (they never keep a line that an id holds).
* rows that repeat an id are one document: none of them drops the other's lines.
* very long texts: positions, not lines, are gathered, one array per document.
* empty table: empty result. Extra columns stay untouched in ``dedup_text``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.store import stored

#: Stripped characters, least key length.
SPACE = " \t\n\x0b\f\r"
MIN_KEY = 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _row_keys(text_col: str, id_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("row_hash")]


def line_hashes(docs: DataFrame, id_col: str, text_col: str, cuts: list[int]) -> DataFrame:
    """(doc, row_hash, pos, h1, h2, batch) of every line whose key is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(*_row_keys(text_col, id_col), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "row_hash", "pos", line_key(F.col("line")).alias("key"))
    batch = sum((F.when(F.col("doc") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    return keyed.where(F.length("key") >= MIN_KEY).select(
        "doc", "row_hash", "pos", F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), batch.cast("int").alias("batch"))


class LineIndex:
    """Levelled runs of (h1, h2, first): each key once, with its first document."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "h1", "h2").write.format("parquet").option("compression", "zstd")
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name))
        return name

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``first``: the first holder known to the runs, else null."""
        out = keys.withColumn("first", F.lit(None).cast("long"))
        for name in (n for level in self.levels for n in level):
            run = self.spark.table(name).select("h1", "h2", F.col("first").alias("held"))
            out = (out.join(run, ["h1", "h2"], "left")
                   .withColumn("first", F.coalesce("first", "held")).drop("held"))
        return out

    def add(self, new_keys: DataFrame) -> None:
        """Add keys that no run holds; compact every level that is full."""
        name, level = self._write(new_keys.select("h1", "h2", "first")), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            full = self.levels[level]
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            name = self._write(merged)
            for old in full:
                self.spark.sql(f"DROP TABLE {old}")
            self.levels[level] = []
            level += 1

    def drop(self) -> None:
        for name in (n for level in self.levels for n in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc, row_hash, dropped): the sorted line positions that each row loses."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).alias("doc"))
    share = [i / batches for i in range(1, batches)]
    cuts = ids.agg(F.percentile_approx("doc", share, 1000).alias("c")).first()["c"] if batches > 1 else []
    lines = stored(line_hashes(docs, id_col, text_col, sorted(set(cuts or []))), "lines", "batch")
    index, drops = LineIndex(spark, fanout), None
    for b in range(len(set(cuts or [])) + 1):
        part = lines.where(F.col("batch") == b)
        keys = part.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        seen = stored(index.lookup(keys).select(
            "h1", "h2", F.coalesce("first", "lo").alias("first"), F.col("first").isNull().alias("is_new"),
            (F.col("hi") > F.coalesce("first", "lo")).alias("again")), f"seen{b}")
        if b < len(set(cuts or [])):
            index.add(seen.where("is_new"))
        hit = (part.join(seen.where("again").select("h1", "h2", "first"), ["h1", "h2"])
               .where("doc > first").select("doc", "row_hash", "pos"))
        drops = hit if drops is None else drops.unionByName(hit)
    drops = stored(drops.distinct(), "drops")
    index.drop()
    return drops.groupBy("doc", "row_hash").agg(F.array_sort(F.collect_list("pos")).alias("dropped"))


def dedup_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4,
               fanout: int = 2) -> DataFrame:
    """``docs`` plus ``_kept_text``, ``_n_lines`` and ``_n_dropped``."""
    names = docs.columns
    drops = dropped_lines(docs, id_col, text_col, batches, fanout)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_row_keys(text_col, id_col))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rest = lambda l: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("dropped")), lambda i: l[i])
    kept = F.transform(F.array(F.split(text, "\n")), lambda l: F.array_join(rest(l), "\n"))[0]
    return (packed.join(drops, ["doc", "row_hash"], "left")
            .select(*[F.col("row").getField(c).alias(c) for c in names],
                    F.when(F.col("dropped").isNull(), text).otherwise(kept).alias("_kept_text"),
                    (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("_n_lines"),
                    F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("_n_dropped")))
