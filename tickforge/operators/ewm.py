"""Exponential moving average (``adjust=False``) as a distributed scan.

Recurrence: y0 = x0, yt = (r^g * y + a*xt) / (r^g + a) with a = 2/(span+1),
r = 1-a and g the rows since the last value; without nulls g = 1 and the divisor
is 1. A null row repeats the value before it, rows before the first value are
null (the pandas rule).

Rows of a symbol are cut into chunks (``sequence.chunked``) and each chunk
into sub-chunks of ``SUB`` rows, small enough that the products of the decays
cannot underflow. Inside a sub-chunk the scan is a window sum
``loc = P * sum(c_j x_j / P_j)`` with P the running product of the decays.
The value carried into a sub-chunk is the fold of the previous sub-chunks'
end values, made once per sub-chunk and only over the last ``K`` of them: what
is older has decayed by e**-100 and lies far below the last digit of a double.
The chunk needs only ``K*SUB`` halo rows of history (``ewm_halo``) and everything runs as
window functions over the chunk partitioning: no join, no extra shuffle. (A run
of nulls longer than the halo, thousands of rows, starts the average anew.)
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tickforge.operators.sequence import CK, RN

SUB = 128
# Decays below e**-100 = 4e-44 of a value are left out: 28 orders of magnitude
# below what a double resolves beside it.
_FORGOTTEN_LOG = 100.0


def smoothing(span: float) -> tuple[float, float]:
    if span < 1:
        raise ValueError("span must be >= 1")
    alpha = 2.0 / (span + 1.0)
    return alpha, 1.0 - alpha


def reach(span: float) -> int:
    """Previous sub-chunks that can still change the value of a row."""
    r = smoothing(span)[1]
    if r <= 0.0:
        return 0
    return int(math.ceil(_FORGOTTEN_LOG / (SUB * math.log(1.0 / r)))) + 1


def ewm_halo(*spans: float) -> int:
    """History rows a chunk needs for chained EMAs of these spans."""
    return sum(reach(s) for s in spans) * SUB + SUB


def ewm_columns(df: DataFrame, specs: list[tuple[str, float, str]], key: str = "symbol"
                ) -> DataFrame:
    """Add one EMA column per ``(input, span, output)`` spec.

    ``df`` carries ``_rn``/``_ck`` from ``sequence.chunked`` with at least
    ``ewm_halo(span)`` halo rows; values on halo rows are not exact.
    """
    w_chunk = Window.partitionBy(key, CK).orderBy(RN)
    w_sub = Window.partitionBy(key, CK, "_sc").orderBy(RN)
    w_run = w_sub.rowsBetween(Window.unboundedPreceding, 0)
    inputs = {c: f"_in{i}" for i, c in enumerate(dict.fromkeys(c for c, _, _ in specs))}

    # layer 1: sub-chunk number, rows since the last value of every input
    x = df.select("*", F.floor(F.col(RN) / SUB).cast("long").alias("_sc"), *[
        (F.col(RN) - F.last(F.when(F.col(c).isNotNull(), F.col(RN)), ignorenulls=True).over(
            w_chunk.rowsBetween(Window.unboundedPreceding, -1))).alias(f"{v}_gap")
        for c, v in inputs.items()])
    # layer 2: decay and contribution of every row, and where a sub-chunk begins
    layer = [(F.row_number().over(w_sub) == 1).alias("_start")]
    for i, (c, span, _) in enumerate(specs):
        a, r = smoothing(span)
        gap, value = F.col(f"{inputs[c]}_gap"), F.col(c).cast("double")
        kept = F.pow(F.lit(r), gap)
        decay = F.when(gap == 1, F.lit(r)).otherwise(kept / (kept + a))
        part = F.when(gap == 1, F.lit(a)).otherwise(F.lit(a) / (kept + a))
        layer += [F.when(value.isNull() | gap.isNull(), F.lit(1.0)).otherwise(decay).alias(f"_f{i}"),
                  F.when(value.isNull(), F.lit(0.0)).when(gap.isNull(), value).otherwise(part * value).alias(f"_c{i}")]
    x = x.select("*", *layer)
    # layer 3 and 4: running products, then the local scans
    n = range(len(specs))
    tiny = F.lit(1e-300)  # span 1 has decay 0: its own value alone counts
    x = x.select("*", *[F.product(F.greatest(F.col(f"_f{i}"), tiny)).over(w_run).alias(f"_p{i}") if smoothing(specs[i][1])[1] > 0
                        else F.lit(0.0).alias(f"_p{i}") for i in n])
    x = x.select("*", *[(F.col(f"_p{i}") * F.sum(F.col(f"_c{i}") / F.col(f"_p{i}")).over(w_run)).alias(f"_loc{i}")
                        if smoothing(specs[i][1])[1] > 0 else F.col(f"_c{i}").alias(f"_loc{i}") for i in n])
    # layer 5: the previous sub-chunks' ends, folded on the first row of each sub-chunk
    last = F.lead("_sc", 1, -1).over(w_chunk) != F.col("_sc")
    x = x.select("*", last.alias("_end"))

    def carry(i: int) -> F.Column:
        before = Window.partitionBy(key, CK).orderBy("_sc").rangeBetween(-reach(specs[i][1]), -1)
        ends = F.collect_list(F.when(F.col("_end"), F.struct(
            F.col("_sc").alias("k"), F.col(f"_p{i}").alias("p"), F.col(f"_loc{i}").alias("e")))).over(before)
        folded = F.aggregate(ends, F.lit(0.0), lambda acc, e: acc * e["p"] + e["e"])
        return F.when(F.col("_start"), folded)

    x = x.select("*", *[carry(i).alias(f"_y{i}") for i in n])
    outs = {}
    for i, (c, _, out) in enumerate(specs):
        value = F.col(f"_loc{i}") + F.col(f"_p{i}") * F.first(f"_y{i}").over(w_run)
        outs[out] = F.when(F.col(c).isNotNull() | F.col(f"{inputs[c]}_gap").isNotNull(), value)
    keep = [c for c in df.columns if c not in outs]
    return x.select(*keep, *[v.alias(k) for k, v in outs.items()])
