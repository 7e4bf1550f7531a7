"""Arithmetic with unknown values.

A sum is unknown as soon as one of its terms is. Spark's ``sum`` skips nulls
instead, so unknown terms travel as NaN, which every sum, product and ratio
passes on, and become null again in the result table (`known`). This holds over
any number of re-aggregations, which a test on null counts would not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unknown() -> Column:
    return F.lit(float("nan"))


def or_unknown(value: Column) -> Column:
    """`value` with NaN in place of null, as a term of a propagating sum."""
    return F.coalesce(value.cast("double"), unknown())


def known(value: Column) -> Column:
    """`value` with null in place of NaN, for a result table."""
    return F.when(~F.isnan(value), value)


def strict_sum(value: Column) -> Column:
    """Sum that is null when any term is null."""
    return known(F.sum(or_unknown(value)))


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale; null when the whole is zero or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole, 100.0)


def percent_change(before: Column, after: Column) -> Column:
    return percent(after - before, before)
