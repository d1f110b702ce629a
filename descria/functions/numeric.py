"""Scalar column expressions on numbers."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(INFINITY)


def infinite_to_null(c: Column) -> Column:
    """Both infinities become NULL; NaN becomes NULL as well (one kind of missing)."""
    # NaN sorts above infinity, so one comparison rejects all three.
    return F.when(F.abs(c) < F.lit(INFINITY), c)


def finite_or_null(c: Column) -> Column:
    return infinite_to_null(c.cast("double"))


def signed_log(c: Column) -> Column:
    """``sign(x) * log(1 + |x|)``: defined everywhere, keeps the sign and zero."""
    return F.signum(c) * F.log1p(F.abs(c))


def safe_ratio(num: Column, den: Column) -> Column:
    """Quotient that is NULL when the denominator is zero (also in ANSI mode)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * safe_ratio(part, whole)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))
