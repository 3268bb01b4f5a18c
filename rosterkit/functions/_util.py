from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def date_lit(d) -> Column:
    """A DATE literal from a ``datetime.date``, an ISO string or a Column."""
    if isinstance(d, Column):
        return d
    if isinstance(d, _dt.datetime):
        d = d.date()
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)
