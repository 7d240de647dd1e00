"""Bar file scans, symbol helpers, source failover and health."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tickforge import schema as S
from tickforge.operators import clean as C
from tickforge.operators import sequence as seq
from tickforge.session import cut_lineage


def _stem_symbol(path: F.Column) -> F.Column:
    """Symbol from the file path: Hive-style ``symbol=X`` dir, else the file stem.

    Paths are URL-encoded by Spark; ``+`` is protected before decoding."""
    hive = F.regexp_extract(path, r"symbol=([^/]+)/[^/]*$", 1)
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    raw = F.when(hive != "", hive).otherwise(stem)
    return F.url_decode(F.regexp_replace(raw, r"\+", "%2B"))


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the first line that is not blank of every symbol file under
    ``path``, at any depth; files that hold no symbol and empty files are left out.

    Listing and reading are Spark's, so nothing is opened by the driver: one pass of
    the text reader, in which a file's lines shrink to one before the shuffle. That
    pass is cheap beside parsing the same files as CSV.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))
    firsts = (lines.where("start = 0 and trim(value) != ''").groupBy("file")
              .agg(F.regexp_replace(F.min_by("value", "place"), "^\ufeff", "").alias("line")))
    return cut_lineage(firsts.where(~_stem_symbol(F.col("file")).isin(*S.NON_SYMBOL_STEMS)))


def distinct_headers(headers: DataFrame) -> list[tuple[str, list[str], str]]:
    """(line, column names, a file that has it) of every header, the commonest first."""
    rows = headers.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).collect()
    return [(r["line"], next(csv.reader([r["line"]]), []), r["file"]) for r in sorted(rows, key=lambda r: (-r["n"], r["line"]))]


def _positions(spark: SparkSession, header: list[str]) -> dict[str, int]:
    """Canonical column name -> place in the file; the symbol comes from the file name."""
    unique = [c if c not in header[:i] else f"{c}_{i}" for i, c in enumerate(header)]
    at = {c.strip().lower(): i for i, c in reversed(list(enumerate(unique)))}
    at.pop("symbol", None)
    frame = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in at]))
    named = dict(zip(C.map_synonyms(frame).columns, at.values(), strict=True))
    named.pop("symbol", None)
    return named


def scan_bars_csv(spark: SparkSession, path: str, symbols: list[str] | None = None,
                  headers: DataFrame | None = None) -> DataFrame:
    """Read every symbol file under ``path``, columns by each file's own header.

    One scan under an all-string schema by position (no inference pass). A row's
    header is that of its file: the commonest unless ``headers`` says otherwise, so
    only the files with other headers are joined to the rows. The symbol comes from
    the file name; ``symbols`` selects files before any data is read.
    """
    headers = csv_headers(spark, path) if headers is None else headers
    kinds = distinct_headers(headers)
    if not kinds:
        return spark.createDataFrame([], S.BAR_SCHEMA)
    width = max(len(names) for _, names, _ in kinds)
    raw = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    rows = (spark.read.schema(raw).option("header", True).option("recursiveFileLookup", True).csv(path)
            .select("*", F.col("_metadata.file_path").alias("_file")))
    symbol = _stem_symbol(F.col("_file"))
    rows = rows.where(~symbol.isin(*S.NON_SYMBOL_STEMS) if symbols is None else symbol.isin(*symbols))
    if len(kinds) > 1:
        number = {line: i for i, (line, _, _) in enumerate(kinds)}
        other = headers.where(F.col("line") != kinds[0][0]).replace(
            {k: str(v) for k, v in number.items()}, subset=["line"]).select(
            F.col("file").alias("_other"), F.col("line").cast("int").alias("_kind"))
        rows = rows.join(other, rows["_file"] == F.col("_other"), "left").drop("_other")
    kind = F.coalesce("_kind", F.lit(0)) if len(kinds) > 1 else F.lit(0)
    places = [_positions(spark, names) for _, names, _ in kinds]
    columns = dict.fromkeys(c for p in places for c in p)
    value = {c: F.coalesce(*[F.when(kind == i, F.col(f"_c{p[c]}")) for i, p in enumerate(places) if c in p])
             for c in columns}
    x = C.cast_types(rows.select(*[v.alias(c) for c, v in value.items()], _stem_symbol(F.col("_file")).alias("symbol")))
    keep = [c for c in S.BAR_COLS if c in x.columns]
    return x.select(*keep, *[c for c in x.columns if c not in keep])


def scan_csv_validated(spark: SparkSession, path: str, symbols: list[str] | None = None
                       ) -> tuple[DataFrame, DataFrame]:
    """Scan and validate bar files: (bars, rejects with a reason).

    A file that lacks one of the bar columns fails the scan; uploaded bytes are
    a file landed under ``path``. Headers are read once.
    """
    headers = csv_headers(spark, path)
    for _, header, file in distinct_headers(headers):
        named = [c.strip().lower() for c in header]
        lacking = [c for c in S.BAR_COLS if c != "symbol" and not any(o in named for o in S.SYNONYMS[c])]
        if lacking:
            raise ValueError(f"{file}: bars lack the columns {lacking}")
    return C.validate(scan_bars_csv(spark, path, symbols, headers))


def scan_single_symbol(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    return C.clean_spark_bars(scan_bars_csv(spark, path, [symbol]).select(*S.BAR_COLS))


def union_symbols(*frames: DataFrame) -> DataFrame:
    """Combine per-source frames by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def list_symbols(df: DataFrame) -> DataFrame:
    """Sorted distinct symbols with their row counts."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("records")).orderBy("symbol")


def normalise_symbol(c="symbol") -> F.Column:
    """Upper-case, trim, append the default exchange suffix unless present."""
    s = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    pattern = "(" + "|".join(x.replace(".", r"\.") for x in S.EXCHANGE_SUFFIXES) + ")$"
    return F.when(s.rlike(pattern), s).otherwise(F.concat(s, F.lit(S.DEFAULT_EXCHANGE_SUFFIX)))


def strip_suffix(c="symbol") -> F.Column:
    pattern = "(" + "|".join(x.replace(".", r"\.") for x in S.EXCHANGE_SUFFIXES) + ")$"
    return F.regexp_replace(F.upper(F.trim(F.col(c) if isinstance(c, str) else c)),
                            pattern, "")


def known_symbols(df: DataFrame, dim: DataFrame) -> DataFrame:
    return df.join(dim.select("symbol").distinct(), "symbol", "left_semi")


def unknown_symbols(df: DataFrame, dim: DataFrame) -> DataFrame:
    return df.join(dim.select("symbol").distinct(), "symbol", "left_anti")


def source_failover(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per symbol, rows of the first source (in priority order) that has any.

    A cascade: a later source is read only for the symbols that no earlier one
    has (an anti-join with the symbols found so far, one row each). Symbols are
    summed before they are compared, so a symbol's rows never meet in one task.
    """
    out, found = None, None
    for name, rows in sources:
        rows = rows.withColumn("source", F.lit(name))
        key = seq.group_key("symbol")  # a null symbol is a symbol of its own
        if found is not None:
            rows = rows.withColumn("_key", key).join(found, "_key", "left_anti").drop("_key")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if name != sources[-1][0]:
            new = rows.select(key.alias("_key")).distinct()
            found = cut_lineage(new if found is None else found.unionByName(new))
    return out


def source_health(sources: list[tuple[str, DataFrame]], spark: SparkSession) -> DataFrame:
    """Status, record count and last price per source, plus a recommendation."""
    names = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(sources)],
                                  "source string, source_rank int")
    stats = union_symbols(*[d.select("symbol", "date", "close").withColumn("source", F.lit(n))
                            for n, d in sources]).groupBy("source").agg(
        F.count(F.lit(1)).alias("records"),
        F.max_by("close", F.struct("date", "symbol")).alias("last_price"))
    # one row per source in the given list: bounded by len(sources)
    x = names.join(F.broadcast(stats), "source", "left").select(
        "source", "source_rank", F.coalesce("records", F.lit(0)).alias("records"),
        "last_price")
    x = x.withColumn("status", F.when(F.col("records") > 0, "working").otherwise("failed"))
    w = Window.partitionBy()  # over the list of sources: a handful of rows
    working = F.sum((F.col("status") == "working").cast("int")).over(w)
    total = F.count(F.lit(1)).over(w)
    rec = (F.when(working == total, "All sources working")
           .when(working > 0, "Some sources working")
           .otherwise("No sources working"))
    return x.select("*", working.alias("working_sources"), total.alias("total_sources"),
                    rec.alias("recommendation"))


_PERIOD_MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60, "10y": 120}
_PERIOD_DAYS = {"1d": 1, "5d": 5}


def period_slice(df: DataFrame, period: str | None = None, start=None, end=None,
                 key: str = "symbol") -> DataFrame:
    """Rows in [start, end), or the trailing ``period`` before each symbol's last bar."""
    x = df
    if start is not None:
        x = x.filter(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        x = x.filter(F.col("date") < F.lit(end).cast("timestamp_ntz"))
    if period is None or period == "max":
        return x
    if period not in S.PERIODS:
        raise ValueError(f"unknown period {period}")
    last = x.groupBy(key).agg(F.max("date").alias("_last"))
    if period == "ytd":
        lo = F.date_trunc("year", F.col("_last"))
    elif period in _PERIOD_DAYS:
        lo = F.col("_last") - F.make_dt_interval(F.lit(_PERIOD_DAYS[period]))
    else:
        lo = F.add_months(F.col("_last"), -_PERIOD_MONTHS[period]).cast("timestamp_ntz")
    return x.join(last, key).filter(F.col("date") > lo).drop("_last")


_INTERVAL_UNITS = {"m": "minutes", "h": "hours", "d": "days", "wk": "weeks"}


def resample_bars(df: DataFrame, interval: str = "1wk", key: str = "symbol",
                  price: str | None = None, order: str | None = None) -> DataFrame:
    """Bars at a coarser interval: first open, max high, min low, last close,
    summed volume. Month intervals align to calendar months, others to the epoch
    (weeks start on Monday). With ``price`` the input is ticks (one price
    column, ``order`` breaks ties)."""
    if interval not in S.INTERVALS:
        raise ValueError(f"unknown interval {interval}")
    num = int("".join(ch for ch in interval if ch.isdigit()))
    unit = "".join(ch for ch in interval if not ch.isdigit())
    if unit == "mo":
        m = F.year("date") * 12 + F.month("date") - 1
        m0 = m - m % num
        bucket = F.make_timestamp_ntz(F.floor(m0 / 12).cast("int"), (m0 % 12 + 1).cast("int"),
                                      F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    elif unit == "wk" and num == 1:
        bucket = F.date_trunc("week", F.col("date")).cast("timestamp_ntz")
    else:
        length = f"{7 * num} days" if unit == "wk" else f"{num} {_INTERVAL_UNITS[unit]}"
        bucket = F.window(F.col("date").cast("timestamp"), length).start.cast("timestamp_ntz")
    g = df.groupBy(F.col(key).alias("symbol"), bucket.alias("date"))
    if price:
        ordc = order or "date"
        return g.agg(F.min_by(price, F.struct("date", ordc)).alias("open"),
                     F.max(price).alias("high"), F.min(price).alias("low"),
                     F.max_by(price, F.struct("date", ordc)).alias("close"),
                     F.count(F.lit(1)).cast("double").alias("volume"))
    return g.agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
                 F.sum("volume").alias("volume"))
