"""Exact per-group quantiles without gathering a group in one task.

Spark's exact ``percentile`` merges a value -> count map per group in a
single task, which for a hot group with distinct values is the whole group.
Here each pass counts rows per (group, value bin): rows meet the bins of their
group split by salt, so the counts are summed before the shuffle by group. It
finds the bin holding the wanted rank from prefix sums over the small bin
table, and narrows the value interval to that bin. A target is resolved when
its bin holds one distinct value, or when the bin is small enough
(``gather`` rows) to sort. Every pass reads the data once and parts an interval
that holds two or more values, so the passes end by themselves.

Interpolation is the linear one of pandas / ``percentile`` /
``quantile_cont``: position (n-1)p between the values of ranks floor and ceil.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickforge.operators.sequence import group_key
from tickforge.session import cut_lineage


def exact_quantiles(df: DataFrame, value: str, probs: list[float], keys=("symbol",),
                    bins: int = 1024, gather: int = 100_000, salts: int = 32) -> DataFrame:
    """One row per group: ``q0, q1, ...`` for ``probs`` (nulls, NaN and infinities
    are missing values; null keys are a group)."""
    names = list(keys)
    keys = [f"_g{i}" for i in range(len(names))]
    df = df.select(value, *[group_key(c).alias(g) for c, g in zip(names, keys)],
                   *[F.col(c).alias(f"{g}v") for c, g in zip(names, keys)])
    originals = [f"{g}v" for g in keys]
    # read several times (stats, passes, final sort): materialise the narrow
    # (group, value) projection once instead of re-running the upstream plan
    x = cut_lineage(df.select(*keys, *originals, F.col(value).cast("double").alias("_v")).filter(
        F.abs("_v") < F.lit(float("inf"))))
    x = x.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    stats = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"),
                                 F.max("_v").alias("_hi"), *[F.first(c).alias(c) for c in originals])
    named = stats.select(*keys, *originals)
    want = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        r0 = F.floor(pos).cast("long")
        want.append(F.struct(F.lit(i).alias("q"), F.lit(0).alias("side"), r0.alias("rank"),
                             pos.alias("frac")))
        want.append(F.struct(F.lit(i).alias("q"), F.lit(1).alias("side"),
                             F.least(r0 + 1, F.col("_n") - 1).alias("rank"),
                             pos.alias("frac")))
    state = stats.select(*keys, "_n", "_lo", "_hi", F.explode(F.array(*want)).alias("_t")).select(
        *keys, "_t.q", "_t.side", "_t.rank", "_t.frac", F.col("_lo").alias("lo"),
        F.col("_hi").alias("hi"), F.lit(0).cast("long").alias("before"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("val"),
        F.col("_n").alias("cnt"))
    tkeys = keys + ["q", "side"]
    while True:
        # groups already within the gather bound skip the histogram passes
        open_ = state.filter(F.col("val").isNull() & (F.col("cnt") > gather))
        if open_.isEmpty():
            break
        j = x.join(open_.select(*tkeys, "lo", "hi", spread), [*keys, "_salt"]).filter(
            (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        # halves where the width of the interval itself would overflow
        part = F.when(F.col("hi") - F.col("lo") == F.lit(float("inf")),
                      (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(
            (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        b = F.least(F.floor(part * bins), F.lit(bins - 1)).cast("int")
        h = j.groupBy(*tkeys, b.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"),
                                                    F.min("_v").alias("_bmin"),
                                                    F.max("_v").alias("_bmax"))
        w = Window.partitionBy(*tkeys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("_cprev", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        st = open_.select(*tkeys, "rank", "frac", "before")
        pick = h.join(st, tkeys).filter(
            (F.col("before") + F.col("_cprev") <= F.col("rank"))
            & (F.col("rank") < F.col("before") + F.col("_cprev") + F.col("_c")))
        moved = pick.select(*tkeys, "rank", "frac", F.col("_bmin").alias("lo"),
                            F.col("_bmax").alias("hi"),
                            (F.col("before") + F.col("_cprev")).alias("before"),
                            F.when(F.col("_bmin") == F.col("_bmax"), F.col("_bmin")).alias("val"),
                            F.col("_c").alias("cnt"))
        kept = state.join(open_.select(*tkeys), tkeys, "left_anti")
        state = cut_lineage(kept.unionByName(moved))
    # Sort the remaining small intervals (at most ``gather`` rows each).
    rest = state.filter(F.col("val").isNull())
    j = x.join(rest.select(*tkeys, "lo", "hi", "rank", "before", spread), [*keys, "_salt"]).filter(
        (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    picked = j.groupBy(*tkeys, "rank", "before").agg(
        F.sort_array(F.collect_list("_v")).alias("_vals")).select(
        *tkeys, F.element_at("_vals", (F.col("rank") - F.col("before") + 1).cast("int"))
        .alias("_pv"))
    resolved = state.join(picked, tkeys, "left").select(
        *tkeys, "frac", F.coalesce("val", "_pv").alias("v"))
    # ``frac`` holds the position (n-1)p; same interpolation as ``percentile``
    lo_side = resolved.filter("side = 0").select(*keys, "q", F.col("frac").alias("pos"),
                                                 F.col("v").alias("v0"))
    hi_side = resolved.filter("side = 1").select(*keys, "q", F.col("v").alias("v1"))
    lower = F.floor("pos")
    higher = F.ceil("pos")
    interp = ((higher - F.col("pos")) * F.col("v0") + (F.col("pos") - lower) * F.col("v1"))
    qv = lo_side.join(hi_side, keys + ["q"]).select(
        *keys, "q", F.when((lower == higher) | (F.col("v0") == F.col("v1")), F.col("v0"))
        .otherwise(interp).alias("qv"))
    wide = qv.groupBy(*keys).pivot("q", list(range(len(probs)))).agg(F.first("qv"))
    return wide.join(named, keys).select(*[F.col(f"{g}v").alias(c) for c, g in zip(names, keys)],
                                         *[F.col(str(i)).alias(f"q{i}") for i in range(len(probs))])
