"""Date and time functions.

Every parse uses a ``try_`` form: with ANSI mode on, a plain ``to_date`` on a
dirty value raises and fails the whole job.  "Today" is never read from the
clock: callers pass ``as_of`` explicitly so that results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, date_lit
from .ids import trim_ws

# Spreadsheet serial day 0.
EXCEL_EPOCH = "1899-12-30"
# Two-digit years at or above this are read as 19xx (20xx below), the
# usual pivot of M/D/Y parsers.
TWO_DIGIT_YEAR_PIVOT = 69


def _mdy_to_ymd(x) -> Column:
    """Rewrite ``M/D/YYYY`` and ``M/D/YY`` text to ``YYYY-M-D`` (other text unchanged).

    Two-digit years from the pivot on are 19xx, below it 20xx.  Each step
    reads the previous one once (see ``ids.normalize_id`` on why).
    """
    return _short_year(F.regexp_replace(x, _MDY, "$3-$1-$2"))


_MDY = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"


def _short_year(x) -> Column:
    """Rewrite ``M/D/YY`` text to ``YYYY-M-D`` (other text unchanged)."""
    p = TWO_DIGIT_YEAR_PIVOT
    hi = rf"(?:{p // 10}[{p % 10}-9]|[{p // 10 + 1}-9][0-9])" if p % 10 else rf"[{p // 10}-9][0-9]"
    x = F.regexp_replace(x, rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/({hi})$", "19$3-$1-$2")
    return F.regexp_replace(x, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$", "20$3-$1-$2")


def parse_mdy(c) -> Column:
    """``M/D/YYYY`` or ``M/D/YY``; anything else is NULL.

    The text is rewritten to Y-M-D and parsed once: a valid value never
    takes a failed-parse path (each failed ``try_to_date`` costs an exception).
    """
    return F.try_to_date(_mdy_to_ymd(col_of(c)), "yyyy-M-d")


def parse_ymd(c) -> Column:
    """``Y-M-D``; anything else is NULL."""
    return F.try_to_date(col_of(c), "yyyy-M-d")


def parse_mixed_date(c) -> Column:
    """D3: trimmed text with ``/`` is M/D/Y, with ``-`` is Y-M-D, else NULL.

    M/D/Y text is rewritten to Y-M-D first, so one parse serves both forms;
    text of neither form fails that parse and is NULL.  The three usual forms
    (no blanks around them) take one match and a plain cast, which gives the
    same dates as the parse by pattern at a fraction of its time.
    """
    x = col_of(c)
    iso, mdy, mdy2 = (rf"^{f}\z" for f in ("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}"))
    text = F.when(x.rlike(iso), x).when(x.rlike(mdy), F.regexp_replace(x, _MDY, "$3-$1-$2")).when(x.rlike(mdy2), _short_year(x))
    return F.coalesce(text.try_cast("date"), F.when(text.isNull(), parse_mixed_date_by_pattern(x)))


def parse_mixed_date_by_pattern(c) -> Column:
    """``parse_mixed_date`` for text of any form."""
    return F.try_to_date(_mdy_to_ymd(trim_ws(c)), "yyyy-M-d")


def excel_serial_to_date(c) -> Column:
    """Spreadsheet day number (may carry a fraction) to DATE.

    Text is parsed as double first: ``try_cast('43009.0' as int)`` is NULL.
    """
    days = F.floor(col_of(c).try_cast("double")).try_cast("int")
    return F.date_add(date_lit(EXCEL_EPOCH), days)


def to_date_part(c) -> Column:
    """The date part of a timestamp."""
    return col_of(c).cast("date")


def cut_at_space(c) -> Column:
    """T4: drop everything from the first space on."""
    return F.regexp_replace(col_of(c), " .*$", "")


def space_before_meridiem(c) -> Column:
    """T5: ``10:30AM`` -> ``10:30 AM`` (a space between a digit and a letter)."""
    return F.regexp_replace(col_of(c), "([0-9])([A-Za-z])", "$1 $2")


def wall_clock(ts) -> Column:
    """A parsed timestamp as a wall-clock value (TIMESTAMP_NTZ).

    ``try_to_timestamp`` reads the text in the session time zone; casting
    back to NTZ returns the same wall-clock reading, so results do not depend
    on the session zone (and no daylight-saving gap can shift them).
    """
    return ts.cast("timestamp_ntz")


def era_timestamp(date_col, time_text, cutoff="2016-10-01") -> Column:
    """Combine a date and a clock text, the format depending on the era.

    From ``cutoff`` on the clock is ``h:mm AM``; before it ``h:mm:ss AM``.
    The result is a wall-clock timestamp (TIMESTAMP_NTZ).
    """
    d = col_of(date_col)
    s = F.concat_ws(" ", d.cast("string"), space_before_meridiem(time_text))
    new = F.try_to_timestamp(s, F.lit("yyyy-MM-dd h:mm a"))
    old = F.try_to_timestamp(s, F.lit("yyyy-MM-dd h:mm:ss a"))
    return wall_clock(F.when(d >= date_lit(cutoff), new).when(d < date_lit(cutoff), old))


def parse_mdy_hms(c, truncated: int = 0) -> Column:
    """``M/D/Y H:M:S``; with ``truncated`` up to that many trailing parts
    (seconds, minutes, hours) may be missing.

    Missing parts are filled with zeros by regex, then the text is parsed
    once with the full pattern.
    """
    x = _mdy_to_ymd_dt(trim_ws(c))
    fills = [(r"^(\S+ [0-9]{1,2}:[0-9]{1,2})$", "$1:00"),
             (r"^(\S+ [0-9]{1,2})$", "$1:00:00"),
             (r"^(\S+)$", "$1 0:00:00")]
    for pattern, repl in fills[:truncated]:
        x = F.regexp_replace(x, pattern, repl)
    return wall_clock(F.try_to_timestamp(x, F.lit("yyyy-M-d H:mm:ss")))


def _mdy_to_ymd_dt(x) -> Column:
    """``M/D/YYYY[ rest]`` -> ``YYYY-M-D[ rest]``."""
    return F.regexp_replace(x, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?=$| )", "$3-$1-$2")


def minutes_between(start, end) -> Column:
    """Fractional minutes from ``start`` to ``end`` (``timestampdiff`` in minutes truncates)."""
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end)) / F.lit(60_000_000.0)


def days_since(c, as_of) -> Column:
    """Whole days from the date to ``as_of``."""
    return F.datediff(date_lit(as_of), col_of(c))


def age_in_years_floor(event_date, birth, days_per_year: float = 365.242) -> Column:
    """floor(days between birth and event / days_per_year)."""
    return F.floor(F.datediff(col_of(event_date), col_of(birth)) / F.lit(days_per_year))


def age_on(birth, as_of, days_per_year: float = 365.25) -> Column:
    """Current age as a fraction of years at ``as_of``."""
    return F.datediff(date_lit(as_of), col_of(birth)) / F.lit(days_per_year)


def week_of_year(c) -> Column:
    """(day of year - 1) div 7 + 1 -- not the ISO week."""
    return (F.floor((F.dayofyear(col_of(c)) - 1) / 7) + 1).cast("int")


def floor_week_sunday(c) -> Column:
    """The Sunday on or before the date."""
    return F.date_sub(F.next_day(col_of(c), "Sun"), 7)


def floor_month(c) -> Column:
    """First day of the month."""
    return F.trunc(col_of(c), "month")


def add_calendar_months(c, months: int, invalid: str = "null") -> Column:
    """Calendar month/year addition.

    ``invalid='null'`` returns NULL when the day does not exist in the target
    month (05-31 + 9 months, 02-29 + 1 year), as calendar-period arithmetic
    does; ``'clamp'`` moves to the month end like ``add_months``.
    """
    x = col_of(c)
    m = F.add_months(x, months)
    if invalid == "clamp":
        return m
    return F.when(F.dayofmonth(m) == F.dayofmonth(x), m)


def add_years(c, years: int, invalid: str = "null") -> Column:
    return add_calendar_months(c, 12 * years, invalid)


def fiscal_year_end(as_of, rollover_month: int = 10, end_month: int = 9, end_day: int = 30) -> Column:
    """The fiscal-year end date that contains ``as_of``.

    From ``rollover_month`` on the fiscal year is the next calendar year's.
    """
    d = date_lit(as_of)
    yr = F.year(d) + (F.month(d) >= rollover_month).cast("int")
    return F.make_date(yr, F.lit(end_month), F.lit(end_day))
