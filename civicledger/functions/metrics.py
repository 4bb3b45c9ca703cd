"""Money metrics as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI division would fail)."""
    return a / F.nullif(b, F.lit(0))


def cap_pct(x: Column) -> Column:
    """At most 100; null stays null."""
    return F.when(x.isNotNull(), F.least(x, F.lit(100)))


def annualized(total: Column, years: Column) -> Column:
    return total / F.greatest(F.coalesce(years, F.lit(1)), F.lit(1))


def share_pct(part: Column, whole: Column) -> Column:
    return ratio(part.cast("double"), whole.cast("double")) * 100.0


def growth_pct(now: Column, before: Column) -> Column:
    return ratio(now.cast("double") - before.cast("double"), before.cast("double")) * 100.0


def bennet(q: Column, q0: Column, p: Column, p0: Column) -> tuple[Column, Column]:
    """Volume and unit-cost parts of the change of q * p; they add up to it."""
    return (q - q0) * (p + p0) / 2.0, (p - p0) * (q + q0) / 2.0
