"""Conditional, null-aware and aggregate helper expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, date_lit


def if_else(cond: Column, yes, no) -> Column:
    """L2: NULL condition gives NULL (not the ``no`` branch)."""
    return F.when(cond, yes).when(~cond, no)


def floor_at(c, floor) -> Column:
    """L4: values below ``floor`` become ``floor``; NULL stays NULL.

    ``greatest`` would skip NULLs and return the floor instead.
    """
    x, k = col_of(c), date_lit(floor)
    return F.when(x < k, k).when(x >= k, x)


def yes_no(c) -> Column:
    """``'Y'`` -> true, other text -> false, NULL -> NULL."""
    return col_of(c) == F.lit("Y")


def round_ratio(num, den, digits: int = 1) -> Column:
    """``num / den`` rounded half-to-even; zero denominator -> NULL.

    Computed in decimal so that a tie (x.x5 exactly) is detected exactly and
    rounds to even, and no floating error moves a value across a boundary.
    decimal(18,0) operands keep 16+ fractional digits in the quotient, enough
    to tell a true tie from its neighbours for denominators up to 1e14.
    """
    n = col_of(num).cast("decimal(18,0)")
    d = F.nullif(col_of(den).cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.bround(n / d, digits).cast("double")


def percent(num, den, digits: int = 1) -> Column:
    """``num / den * 100`` rounded half-to-even to ``digits``; zero denominator -> NULL."""
    return round_ratio(col_of(num).cast("long") * F.lit(100), den, digits)


def any_true(*cols) -> Column:
    """P10: TRUE when any of the columns is TRUE (3-valued OR)."""
    return reduce(or_, [col_of(c) for c in cols])


# -- aggregates ---------------------------------------------------------------

def max_null_propagating(c) -> Column:
    """A1: max that is NULL when any input row is NULL (parity with ``max`` without ``na.rm``)."""
    x = col_of(c)
    return F.when(F.count(F.lit(1)) == F.count(x), F.max(x))


def min_null_propagating(c) -> Column:
    x = col_of(c)
    return F.when(F.count(F.lit(1)) == F.count(x), F.min(x))


def count_true(c) -> Column:
    """A3: number of TRUE values; 0 (not NULL) for an all-NULL group."""
    return F.count_if(col_of(c))


def count_distinct_with_null(c) -> Column:
    """Exact distinct count where NULL counts as one value (0 for no rows)."""
    x = col_of(c)
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))


def count_null(c) -> Column:
    """A10: number of NULL values."""
    return F.count_if(col_of(c).isNull())
