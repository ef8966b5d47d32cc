"""Rounding as the estimation model does it: decimals, half away from zero, at fixed points."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS = "decimal(18,4)"


def dec(x, kind: str = HOURS) -> Column:
    """A number or column as a decimal column."""
    return (F.lit(Decimal(str(x))) if isinstance(x, (int, float, str, Decimal)) else x).cast(kind)


def to_increment(x: Column, increment="0.25") -> Column:
    """Nearest multiple of ``increment``, halves away from zero."""
    step = Decimal(str(increment))
    return (F.round(dec(x, "decimal(28,8)") / F.lit(step), 0) * F.lit(step)).cast("decimal(18,2)")


def quarter(x: Column) -> Column:
    return to_increment(x, "0.25")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, dec(low)), dec(high))


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole rounded; null where the whole is zero."""
    return F.round(part.cast("decimal(28,6)") / F.nullif(whole.cast("decimal(28,6)"), dec(0, "decimal(28,6)")), digits)
