"""Column-expression helpers shared by the operators.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, null where b is 0 or null (pandas gives inf/NaN there)."""
    return F.try_divide(col(a), col(b))


def not_true(pred: Column) -> Column:
    """Negation that keeps rows whose predicate is null, like ``~mask`` on NaN."""
    return ~F.coalesce(pred, F.lit(False))


def full_avg(c, w: WindowSpec, n: int) -> Column:
    """Rolling mean that is null until the frame holds ``n`` non-null values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) == n, F.avg(col(c)).over(frame))


def full_std(c, w: WindowSpec, n: int) -> Column:
    """Rolling sample standard deviation, null until the frame is full."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) == n, F.stddev_samp(col(c)).over(frame))


def pct(new, old) -> Column:
    """(new - old) / old * 100."""
    return safe_div(col(new) - col(old), col(old)) * 100


def signal_when(value, upper: float, lower: float, above: str, below: str,
                mid: str) -> Column:
    v = col(value)
    return (F.when(v > upper, F.lit(above)).when(v < lower, F.lit(below))
            .when(v.isNotNull(), F.lit(mid)))
