"""Validation and cleaning of bar tables (schema, filters, dedup, fills, outliers)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tickforge import schema as S
from tickforge.functions.columns import not_true, safe_div
from tickforge.operators import sequence as seq


# --- schema normalisation --------------------------------------------------

def standardise_columns(df: DataFrame) -> DataFrame:
    """Lower-case and trim every column name in one projection."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def map_synonyms(df: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """Rename the first present synonym to each canonical name (if absent)."""
    synonyms = synonyms or S.SYNONYMS
    names = list(df.columns)
    rename = {}
    for target, options in synonyms.items():
        if target in names or target in rename.values():
            continue
        for o in options:
            if o in names and o not in rename:
                rename[o] = target
                break
    return df.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in names])


def default_symbol(df: DataFrame, value: str = "UNKNOWN") -> DataFrame:
    if "symbol" in df.columns:
        return df
    return df.withColumn("symbol", F.lit(value))


def require_columns(df: DataFrame, required=S.BAR_COLS) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack the columns {missing}")
    return df


def finite(c: F.Column) -> F.Column:
    """NaN and infinities count as missing."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def cast_types(df: DataFrame, date_col: str = "date") -> DataFrame:
    """date -> timestamp_ntz, numbers -> double; unparsable, NaN and infinite values become null.

    Two projections: ``finite`` names its column three times, and each would parse."""
    out = []
    types = dict(df.dtypes)
    for c in df.columns:
        if c == date_col:
            if types[c] == "string":
                out.append(F.expr(f"try_cast(trim(`{c}`) as timestamp_ntz)").alias(c))
            else:
                out.append(F.col(c).cast("timestamp_ntz").alias(c))
        elif c in S.OHLCV:
            if types[c] == "string":
                out.append(F.expr(f"try_cast(trim(`{c}`) as double)").alias(c))
            else:
                out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    read = df.select(*out)
    return read.select(*[finite(F.col(c)).alias(c) if c in S.OHLCV and c != date_col else F.col(c)
                         for c in df.columns])


def computed(df: DataFrame) -> DataFrame:
    """The same rows as output of a generator, which no filter is pushed through.

    Else the optimizer copies the parsing of a column into each of its mentions in a
    later filter, which makes methods too large for Java's compiler.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def null_report(df: DataFrame, columns=S.OHLCV, key: str | None = "symbol") -> DataFrame:
    """Null count per column and in total, in one aggregation pass."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    total = reduce(lambda a, b: a + b, [F.col(f"null_{c}") for c in columns])
    agg = df.groupBy(key).agg(*counts) if key else df.agg(*counts)
    return agg.withColumn("null_total", total)


# --- predicates and filters ------------------------------------------------

def price_relation_broken() -> F.Column:
    h, lo, o, c = F.col("high"), F.col("low"), F.col("open"), F.col("close")
    return (h < lo) | (h < o) | (h < c) | (lo > o) | (lo > c)


def filter_price_relationships(df: DataFrame) -> DataFrame:
    """Drop rows whose prices contradict each other; null comparisons keep the row."""
    return df.filter(not_true(price_relation_broken()))


def check_negative_volume(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with negative volume; in strict mode a query over them fails."""
    bad = df.filter(F.col("volume") < 0)
    if strict:
        return df.withColumn("volume", F.when(
            F.col("volume") < 0, F.raise_error(F.lit("a bar has a volume below zero"))
        ).otherwise(F.col("volume")))
    return bad


def dedup_keep_last(df: DataFrame, key=S.KEY, order: str = "ingest_seq") -> DataFrame:
    """Keep the row with the largest ``order`` per key.

    A ``max_by`` aggregate, not a window: partial aggregation runs before the
    shuffle, so a key with billions of copies does not land whole in one task.
    Without an ``order`` column the largest full row wins (deterministic).
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    if order in df.columns:
        best = F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order]))
    else:
        best = F.max(F.struct(*rest))
    return df.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*").select(*df.columns)


def dedup_full_row(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_null_critical(df: DataFrame, columns=("date", "close")) -> DataFrame:
    return df.dropna(subset=list(columns))


def filter_positive_close(df: DataFrame) -> DataFrame:
    return df.filter(F.col("close") > 0)


def filter_positive_ohlc(df: DataFrame) -> DataFrame:
    """Drop rows where any of O/H/L/C is <= 0; nulls do not count as invalid."""
    bad = reduce(lambda a, b: a | b, [F.col(c) <= 0 for c in S.PRICE_COLS])
    return df.filter(not_true(bad))


def repair_ohlc(df: DataFrame) -> DataFrame:
    """high = max(O,H,L,C); then low = min(O, new high, L, C). Nulls skipped."""
    high = F.greatest(*[F.col(c) for c in S.PRICE_COLS])
    low = F.least(F.col("open"), high, F.col("low"), F.col("close"))
    return df.withColumns({"high": high, "low": low})


def fill_prices(df: DataFrame, key: str = "symbol", columns=S.PRICE_COLS,
                chunk_rows: int = seq.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Forward fill, then backward fill, by date within each symbol.

    Inside a chunk the fills are window functions; across chunks they use a
    per-chunk summary (last / first non-null value) that is tiny.
    """
    base = list(df.columns)
    s = seq.chunked(df, key, "date", chunk_rows=chunk_rows)
    # Both fills are running frames (O(n)); the backward one runs over the
    # reversed order. A (current, unboundedFollowing) frame would be O(n^2).
    before = seq.window(key).rowsBetween(Window.unboundedPreceding, 0)
    rev = Window.partitionBy(key, seq.CK).orderBy(F.col(seq.RN).desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    x = s.select("*", *[F.last(c, ignorenulls=True).over(before).alias(f"_ff_{c}")
                        for c in columns],
                 *[F.last(c, ignorenulls=True).over(rev).alias(f"_bf_{c}")
                   for c in columns])
    summ = s.groupBy(key, seq.CK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq.RN))).alias(f"_l_{c}")
          for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq.RN))).alias(f"_f_{c}")
          for c in columns])
    wc = Window.partitionBy(key).orderBy(seq.CK)
    summ = summ.select(
        key, seq.CK,
        *[F.last(f"_l_{c}", ignorenulls=True).over(
            wc.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_pl_{c}")
          for c in columns],
        *[F.last(f"_f_{c}", ignorenulls=True).over(
            Window.partitionBy(key).orderBy(F.col(seq.CK).desc()).rowsBetween(
                Window.unboundedPreceding, -1)).alias(f"_nf_{c}")
          for c in columns])
    x = seq.join_on_key(x, summ, [key, seq.CK])
    filled = {c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_pl_{c}"),
                            F.col(f"_bf_{c}"), F.col(f"_nf_{c}")) for c in columns}
    return x.withColumns(filled).select(*base)


def group_quantiles(df: DataFrame, value: str, probs: list[float], keys, method: str
                    ) -> DataFrame:
    """Per-group quantiles as columns q0, q1, ...

    ``exact``: distributed histogram refinement (no group gathered in a task);
    ``buffer``: Spark's exact ``percentile`` (merges a value->count map per
    group in one task); ``approx``: ``percentile_approx``.
    """
    from tickforge.operators.quantiles import exact_quantiles
    keys = list(keys)
    if method == "exact":
        return exact_quantiles(df, value, probs, keys)
    fn = (F.percentile_approx(value, probs, 100000) if method == "approx"
          else F.percentile(value, probs))
    g = df.groupBy(*keys).agg(fn.alias("_q"))
    return g.select(*keys, *[F.col("_q")[i].cast("double").alias(f"q{i}")
                             for i in range(len(probs))])


def fill_volume_median(df: DataFrame, key: str = "symbol", method: str = "exact"
                       ) -> DataFrame:
    """Null volume -> the symbol's median volume."""
    meds = group_quantiles(df, "volume", [0.5], [key], method).select(
        key, F.col("q0").alias("_med"))
    return (seq.join_on_key(df, meds, [key])
            .withColumn("volume", F.coalesce(F.col("volume"), F.col("_med")))
            .select(*df.columns))


def clean_bars(df: DataFrame, key: str = "symbol", order: str = "ingest_seq",
               chunk_rows: int = seq.DEFAULT_CHUNK_ROWS, materialize: bool = True) -> DataFrame:
    """keep-last -> fill prices -> volume median -> drop non-positive -> repair.

    With ``materialize`` the input is read once and the bars, which the fills
    read several times, go through the shared folder."""
    from tickforge.session import cut_lineage
    cut = cut_lineage if materialize else (lambda x: x)
    x = dedup_keep_last(df, (key, "date"), order)
    if order in x.columns:
        x = x.drop(order)
    x = cut(fill_prices(cut(x), key, chunk_rows=chunk_rows))
    x = fill_volume_median(x, key)
    x = filter_positive_ohlc(x)
    return repair_ohlc(x)


def clean_spark_bars(df: DataFrame) -> DataFrame:
    """standardise -> full-row dedup -> cast -> drop null date/close -> close > 0.

    The null check follows the cast, so text that is no date or number goes too.
    """
    x = standardise_columns(df)
    x = dedup_full_row(x)
    x = cast_types(x)
    x = drop_null_critical(x, ("date", "close"))
    return filter_positive_close(x)


def _prepare(df: DataFrame) -> DataFrame:
    x = map_synonyms(standardise_columns(df))
    x = default_symbol(x)
    require_columns(x)
    return cast_types(x)


def validate(df: DataFrame, order: str = "ingest_seq") -> tuple[DataFrame, DataFrame]:
    """Validated bars and rejected rows with a ``reject_reason``.

    Rules: null symbol, null date, broken price relation, negative volume,
    superseded duplicate of (symbol, date).
    """
    x = computed(_prepare(df))
    reason = (F.when(F.col("symbol").isNull(), F.lit("null_symbol"))
              .when(F.col("date").isNull(), F.lit("null_date"))
              .when(F.coalesce(price_relation_broken(), F.lit(False)),
                    F.lit("price_relation"))
              .when(F.col("volume") < 0, F.lit("negative_volume")))
    x = x.withColumn("reject_reason", reason)
    ok = x.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    # Equal rows are counted once, map-side; of each key the last row stays once,
    # every other copy is a reject, so good + rejects = input. The last row takes its
    # count along, so that all readers of ``rows`` share one shuffle.
    rest = [c for c in ok.columns if c not in S.KEY]
    rows = ok.groupBy(*ok.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rank = F.struct(order, *[c for c in rest if c != order]) if order in rest else F.struct(*rest)
    best = rows.groupBy(*S.KEY).agg(F.max_by(F.struct(*rest, "_copies"), rank).alias("_best"))
    good = best.select(*S.KEY, "_best.*").select(*ok.columns)
    spare = F.col("_copies") - F.struct(*rest, "_copies").eqNullSafe(F.col("_best")).cast("int")
    superseded = (rows.join(best, list(S.KEY)).withColumn("_spare", spare).where("_spare > 0")
                  .select(*ok.columns, F.explode(F.sequence(F.lit(1), F.col("_spare").cast("int"))).alias("_n"))
                  .drop("_n"))
    rejects = x.filter(F.col("reject_reason").isNotNull()).unionByName(
        superseded.withColumn("reject_reason", F.lit("duplicate")))
    return good, rejects


def validate_bars(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    return validate(df, order)[0]


# --- outliers ----------------------------------------------------------------

def iqr_fences(df: DataFrame, columns=S.PRICE_COLS, key: str = "symbol",
               k: float = S.OUTLIER_IQR_K, method: str = "exact") -> DataFrame:
    """Per symbol and column: Q1 - k*IQR and Q3 + k*IQR, all columns in one
    long (symbol, column, value) pass."""
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val"))
        for c in columns])).alias("_e")).select(key, "_e._col", "_e._val")
    q = group_quantiles(long, "_val", [0.25, 0.75], [key, "_col"], method)
    q = q.select(key, "_col", (F.col("q0") - k * (F.col("q1") - F.col("q0"))).alias("_lo"),
                 (F.col("q1") + k * (F.col("q1") - F.col("q0"))).alias("_hi"))
    f = q.groupBy(key).pivot("_col", list(columns)).agg(F.first("_lo").alias("lo"),
                                                         F.first("_hi").alias("hi"))
    return f.select(key, *[x for c in columns for x in (F.col(f"{c}_lo").alias(f"lo_{c}"),
                                                        F.col(f"{c}_hi").alias(f"hi_{c}"))])


def _clip(c: str, lo: F.Column, hi: F.Column) -> F.Column:
    v = F.col(c)
    return F.when(v < lo, lo).when(v > hi, hi).otherwise(v)


def outliers_iqr(df: DataFrame, columns=S.PRICE_COLS, key: str = "symbol",
                 k: float = S.OUTLIER_IQR_K, method: str = "exact", fences: DataFrame | None = None
                 ) -> DataFrame:
    """Clip each column to [Q1 - k*IQR, Q3 + k*IQR] of its symbol."""
    fences = iqr_fences(df, columns, key, k, method) if fences is None else fences
    x = seq.join_on_key(df, fences, [key])
    return x.withColumns({c: _clip(c, F.col(f"lo_{c}"), F.col(f"hi_{c}"))
                          for c in columns}).select(*df.columns)


def outliers_zscore(df: DataFrame, columns=S.PRICE_COLS, key: str = "symbol",
                    z: float = S.OUTLIER_Z) -> DataFrame:
    """|z| > 3 -> mean +/- 3 std (sample std), per symbol."""
    stats = df.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                                *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    x = seq.join_on_key(df, stats, [key])
    new = {}
    for c in columns:
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        score = F.abs(safe_div(F.col(c) - m, s))
        new[c] = F.when(score > z, m + z * s * F.signum(F.col(c) - m)).otherwise(F.col(c))
    return x.withColumns(new).select(*df.columns)


def outlier_counts(df: DataFrame, columns=S.PRICE_COLS, key: str = "symbol",
                   k: float = S.OUTLIER_IQR_K, method: str = "exact", fences: DataFrame | None = None
                   ) -> DataFrame:
    """Outliers per price column (before clipping) and their total, per symbol."""
    fences = iqr_fences(df, columns, key, k, method) if fences is None else fences
    x = seq.salted_join(df, fences, key)
    counts = [F.count_if((F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}")))
              .alias(f"outliers_{c}") for c in columns]
    out = x.groupBy(key).agg(*counts)
    return out.withColumn("outliers_total", reduce(
        lambda a, b: a + b, [F.col(f"outliers_{c}") for c in columns]))


def full_pipeline(df: DataFrame, add_features: bool = True, handle_outliers: bool = True,
                  key: str = "symbol", chunk_rows: int = seq.DEFAULT_CHUNK_ROWS,
                  materialize: bool = True) -> DataFrame:
    """clean -> IQR outliers -> technical features, each step optional.

    With ``materialize`` the cleaned bars are checkpointed (shared folder)
    before the next stage, so each stage plans and runs on a leaf input.
    """
    from tickforge.operators.features import technical_features
    from tickforge.session import cut_lineage
    x = clean_bars(df, key, chunk_rows=chunk_rows, materialize=materialize)
    if handle_outliers:
        x = outliers_iqr(cut_lineage(x) if materialize else x, key=key)
    if add_features:
        x = technical_features(cut_lineage(x) if materialize else x, key, chunk_rows)
    return x
