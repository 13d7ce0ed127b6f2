"""Column helpers: missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal places at which measures are compared and shown, so that the order of summation cannot tip a gate.
PLACES = 9


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def measure(c: Column, places: int = PLACES) -> Column:
    """c at a fixed number of places; never a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def clamp01(c: Column) -> Column:
    """0 where missing."""
    return F.when(c.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def band(c: Column, best: float, worst: float) -> Column:
    """1 at best, 0 at worst, linear between; 0 where missing."""
    return F.lit(0.0) if best == worst else clamp01((c - worst) / (best - worst))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """0-100, one decimal."""
    total = sum(w for _, w in parts)
    if total <= 0:
        return F.lit(0.0)
    blend = F.lit(0.0)
    for c, w in parts:
        blend = blend + c * w
    return F.round(F.round(blend * 100.0 / total, 6), 1)


def first_reason(*gates: tuple[str, Column]) -> Column:
    """Name of the first gate whose condition is true; '' if none. A NULL condition does not reject."""
    return F.coalesce(*[F.when(c, name) for name, c in gates], F.lit(""))


def unless(c: Column) -> Column:
    """True where c is false or missing: for gates that a missing value fails."""
    return ~F.coalesce(c, F.lit(False))
