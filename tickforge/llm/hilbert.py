"""Shards in Hilbert-curve order of several metadata columns, DataFrame functions only.

1. Every metadata column is quantised to ``2^bits`` bins of near equal row counts:
   a value's bin is the share of all rows that hold a lesser value. Counts per
   value are summed first, so a frequent value is one row.
2. The bins of a row are a cell of a grid; its place on the Hilbert curve through
   all cells is the curve index. Neighbours on the curve are neighbours in the
   grid, so a run of it is narrow in every column.
3. Rows are sorted by (curve, tie breakers, row number) and numbered, and the
   numbers are cut into runs, the shards: by ``rows`` (counts at most one apart)
   or by ``bytes`` (sizes as near as the rows allow).

Numbering is exact and needs no task that sees all rows: ``numbered`` range-
partitions the rows, writes them sorted, and adds to a row's place in its file the
rows of the files before it. The row number in the sort key is written before, so
it is fixed; it lets the range partitioner cut a cell, a source or a pile of equal
rows of any size.

Defined results
* null metadata sort before every value; null sizes count 0.
* ties on the curve go by id (nulls first), size and checksum, then by row number:
  rows that tie there too are equal in all that ``assign`` reads but extra columns.
* repeated rows are rows of their own. Empty table: empty result.
* very long texts: only their size and checksum are read.
* extra columns are carried along; names starting with ``_h_`` are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.store import scratch, stored

SHARDS, BITS = 8, 4


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of the cell ``axes`` (integers of ``bits`` bits).

    From the highest bit down, every axis either inverts the lower bits of the
    first axis or swaps them with it, which turns the curve's sub-cubes into one
    orientation; a Gray code then gives the digits.
    """
    n = len(axes)
    if n * bits > 62:
        raise ValueError(f"{n} axes of {bits} bits do not fit a long")
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        own, low = F.element_at(x, s["i"] + 1), s["q"] - 1
        inverts = own.bitwiseAND(s["q"]) != 0
        swap = F.when(inverts, F.lit(0).cast("long")).otherwise(x[0].bitwiseXOR(own).bitwiseAND(low))
        first = F.when(inverts, low).otherwise(swap)
        change = lambda v, j: v.bitwiseXOR(
            F.when(j == 0, first).when(j == s["i"], swap).otherwise(F.lit(0).cast("long")))
        return F.transform(x, change)

    def digits(x: Column) -> Column:
        gray = [x[0]]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(x[i]))
        flips = [F.when(gray[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1).cast("long"))
                 .otherwise(F.lit(0).cast("long")) for b in range(bits - 1, 0, -1)]
        t = reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0).cast("long"))
        places = [F.shiftleft(F.shiftright(g.bitwiseXOR(t), b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - i)
                  for b in range(bits) for i, g in enumerate(gray)]
        return reduce(lambda a, b: a.bitwiseOR(b), places)

    cell = F.array(*[a.cast("long") for a in axes])
    # one-element arrays bind a value to a name, so it is computed once
    return F.transform(F.array(F.aggregate(steps, cell, turn) if bits > 1 else cell), digits)[0]


def numbered(df: DataFrame, order: list[str], weights: dict[str, str]) -> DataFrame:
    """``df`` sorted by ``order`` plus one column per entry (name: weight column) of
    ``weights``: the sum of the weights of all rows before, exact. The order must
    be total; weight None counts rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "sorted")
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_h_file"), F.col("_metadata.row_index").alias("_h_at"))
    sums = rows.groupBy("_h_file").agg(F.min(F.struct(*order)).alias("_h_first"), *[
        (F.count(F.lit(1)) if w is None else F.sum(w)).alias(f"_h_sum_{k}") for k, w in weights.items()])
    # one row per file of the sort, as many as there are shuffle partitions
    files = Window.orderBy("_h_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_h_file", *[F.coalesce(F.sum(f"_h_sum_{k}").over(files), F.lit(0)).alias(f"_h_off_{k}")
                                       for k in weights])
    inside = Window.partitionBy("_h_file").orderBy("_h_at").rowsBetween(Window.unboundedPreceding, -1)
    before = {k: F.col("_h_at") if w is None else F.coalesce(F.sum(w).over(inside), F.lit(0))
              for k, w in weights.items()}
    rows = rows.select(*df.columns, "_h_file", *[b.alias(f"_h_in_{k}") for k, b in before.items()])
    # as many rows as shuffle partitions, whatever the input: a bounded side
    return rows.join(F.broadcast(offsets), "_h_file").select(
        *df.columns, *[(F.col(f"_h_in_{k}") + F.col(f"_h_off_{k}")).cast("long").alias(k) for k in weights])


def equal_bins(df: DataFrame, column: str, bits: int, total: int) -> DataFrame:
    """(value, bin): ``2^bits`` bins of near equal row counts in the order of the
    values; a value is never split."""
    counts = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, ["value"], {"lesser": "n"}).select(
        "value", F.floor(F.col("lesser") * F.lit(1 << bits) / F.lit(total)).cast("long").alias("bin"))


def assign(df: DataFrame, dims: list[str], size: str, ties: list[str], shards: int = SHARDS, bits: int = BITS,
           law: str = "rows") -> DataFrame:
    """``df`` plus ``curve``, ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``law``. ``dims`` are quantised, ``ties`` order the rows of a cell, ``size`` is
    a column of bytes."""
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    names = df.columns
    rows = stored(df.select("*", F.monotonically_increasing_id().alias("_h_row"),
                            F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("_h_size")), "rows")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_h_size").alias("b")).first()
    binned = rows
    for i, c in enumerate(dims):
        bins = equal_bins(rows, c, bits, max(1, total["n"])).select(
            F.col("value").alias(f"_h_value{i}"), F.col("bin").alias(f"_h_bin{i}"))
        binned = binned.join(bins, F.col(f"`{c}`").eqNullSafe(F.col(f"_h_value{i}"))).drop(f"_h_value{i}")
    cells = binned.select(*[F.col(f"`{c}`") for c in names], "_h_row", "_h_size",
                          hilbert_index([F.col(f"_h_bin{i}") for i in range(len(dims))], bits).alias("_h_curve"))
    if law == "rows":
        at = numbered(cells, ["_h_curve", *ties, "_h_row"], {"_h_pos": None})
        run = F.floor(F.col("_h_pos") * F.lit(shards) / F.lit(max(1, total["n"])))
    else:
        at = numbered(cells, ["_h_curve", *ties, "_h_row"], {"_h_pos": None, "_h_bytes": "_h_size"})
        run = F.floor(F.col("_h_bytes").cast("decimal(38,0)") * F.lit(shards) / F.lit(max(1, total["b"] or 0)))
    cut = stored(at.withColumn("_h_shard", F.least(run, F.lit(shards - 1)).cast("int")), "cut")
    # one row per shard
    starts = cut.groupBy("_h_shard").agg(F.min("_h_pos").alias("_h_start"))
    return cut.join(F.broadcast(starts), "_h_shard").select(
        *[F.col(f"`{c}`") for c in names], F.col("_h_curve").alias("curve"), F.lit(law).alias("law"),
        F.col("_h_shard").alias("shard"), (F.col("_h_pos") - F.col("_h_start")).alias("slot"))


def text_columns(docs: DataFrame, text_col: str = "text") -> tuple[Column, Column]:
    """(size, checksum) of the text: UTF-8 bytes plus 1, unsigned CRC-32; null: none."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return (F.octet_length(raw) + 1).cast("long"), F.crc32(raw)


def shard_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                dims: tuple[str, ...] = ("lang", "source", "size"), shards: int = SHARDS, bits: int = BITS,
                law: str = "rows") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, curve."""
    size, crc = text_columns(docs, text_col)
    narrow = docs.select(F.col(id_col), size.alias("size"), crc.alias("text_crc32"),
                         *[F.col(d) for d in dims if d != "size"])
    put = assign(narrow, list(dims), "size", [id_col, "size", "text_crc32"], shards, bits, law)
    return put.select(id_col, "size", "text_crc32", "law", "shard", "slot", "curve")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 dims: tuple[str, ...] = ("lang", "source", "size"), shards: int = SHARDS, bits: int = BITS,
                 law: str = "rows", files: int = 1) -> None:
    """Write the documents as ``path/shard=k``, ``files`` runs of the curve per shard.

    Each file is a run, so its column statistics are narrow in every dimension
    and a filter on any of them skips files.
    """
    size, crc = text_columns(docs, text_col)
    full = docs.withColumns({"_size": size, "_crc": crc})
    put = assign(full, ["_size" if d == "size" else d for d in dims], "_size", [id_col, "_size", "_crc"],
                 shards, bits, law)
    (put.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
     .drop("_size", "_crc", "curve", "law", "slot").write.partitionBy("shard").parquet(path))
