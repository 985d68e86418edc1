"""Arithmetic that neither raises under ANSI mode nor depends on the engine's rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, or null where b is null or 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def safe(a: Column | str, b: Column | str) -> Column:
    """a / b, or 0 where b is null or 0."""
    return F.coalesce(div(a, b), F.lit(0.0))


def clip(x: Column | str, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _c(x).cast("double"))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def epoch14(ts: Column | str) -> Column:
    """A timestamp as a 14-digit integer, yyyyMMddHHmmss."""
    return F.date_format(_c(ts), "yyyyMMddHHmmss").cast("long")


def half_even(x: Column | str, scale: int) -> Column:
    """Banker's rounding, for parity with numpy."""
    return F.bround(_c(x), scale)


def r6(x: Column | str) -> Column:
    """Six places, so that sums taken in another order compare equal; minus zero becomes zero."""
    return F.round(_c(x).cast("double"), 6) + F.lit(0.0)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
