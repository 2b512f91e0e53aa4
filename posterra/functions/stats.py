"""Order statistics over draws, log-space sums, and arithmetic with C semantics for zero and NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def draws(value: Column | str) -> Column:
    """Sorted array of a group's draws; a group holds one row a draw, so its size is the number of draws."""
    return F.sort_array(F.collect_list(F.col(value) if isinstance(value, str) else value))


def nearest_rank(values: Column, q: float) -> Column:
    """``sorted[lround((n - 1) * q)]``: halves round away from zero."""
    return F.element_at(values, F.round((F.size(values) - 1) * F.lit(float(q))).cast("int") + 1)


def upper_median(values: Column) -> Column:
    """``sorted[n / 2]`` with integer division."""
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def truncated_rank(values: Column, q: float) -> Column:
    """``sorted[(int)(q * n)]``."""
    return F.element_at(values, F.floor(F.size(values) * F.lit(float(q))).cast("int") + 1)


def bounds(level: float) -> tuple[float, float]:
    if not 0 < level < 1:
        raise ValueError("credible level must lie between 0 and 1")
    return 0.5 - level / 2, 0.5 + level / 2


def safe_div(a: Column, b: Column) -> Column:
    """a / b as C does it: x/0 is an infinity, 0/0 is NaN."""
    zero = F.when(a == 0, F.lit(NAN)).when(a.isNull() | F.isnan(a), a).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def safe_log2(x: Column) -> Column:
    """log2 with -Infinity at 0 and NaN below."""
    return F.when(x > 0, F.log2(x)).when(x == 0, F.lit(-INF)).when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(NAN))


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF)).when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(NAN))


def log2_fold_change(a: Column, b: Column) -> Column:
    return safe_log2(safe_div(a, b))


def logaddexp(x: Column, y: Column) -> Column:
    """log(exp(x) + exp(y)); two equal infinities give that infinity."""
    high, low = F.greatest(x, y), F.least(x, y)
    return F.when(high == -INF, high).otherwise(high + F.log1p(F.exp(low - high)))


def log_sum_exp(x: Column) -> Column:
    """Aggregate log(sum(exp(x))), shifted by the largest term."""
    top = F.max(x)
    terms = F.aggregate(F.collect_list(x), F.lit(0.0), lambda acc, v: acc + F.exp(v - _shift(top)), lambda acc: F.log(acc))
    return F.when(top == -INF, top).otherwise(_shift(top) + terms)


def _shift(top: Column) -> Column:
    return F.when((top == INF) | (top == -INF), F.lit(0.0)).otherwise(top)


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def fold_tails(x: Column, effect: float) -> tuple[Column, Column]:
    """(up, down) indicators of a fold change: x >= e and x <= -e; NaN is neither."""
    ok = ~F.isnan(x)
    return F.when(ok & (x >= effect), 1.0).otherwise(0.0), F.when(ok & (x <= -effect), 1.0).otherwise(0.0)


def change_tails(x: Column, effect: float) -> tuple[Column, Column]:
    """(up, down) indicators of a rate change: where abs(x) >= e, x <= 0 is down and the rest up."""
    far = ~F.isnan(x) & (F.abs(x) >= effect)
    return F.when(far & (x > 0), 1.0).otherwise(0.0), F.when(far & (x <= 0), 1.0).otherwise(0.0)


def entropy(p: Column) -> Column:
    """p ln p + (1 - p) ln (1 - p), with 0 ln 0 = 0."""
    term = lambda v: F.when(v > 0, v * F.log(v)).otherwise(F.lit(0.0))
    return term(p) + term(1 - p)
