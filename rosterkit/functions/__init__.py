"""Column-expression functions: ids, dates, conditional logic and aggregates."""

from .dates import (  # noqa: F401
    add_calendar_months, add_years, age_in_years_floor, age_on, cut_at_space, days_since,
    era_timestamp, excel_serial_to_date, fiscal_year_end, floor_month, floor_week_sunday,
    minutes_between, parse_mdy, parse_mdy_hms, parse_mixed_date, parse_ymd,
    space_before_meridiem, to_date_part, week_of_year,
)
from .ids import normalize_id, pad_then_normalize, trim_ws  # noqa: F401
from .logic import (  # noqa: F401
    any_true, count_distinct_with_null, count_null, count_true, floor_at, if_else,
    max_null_propagating, min_null_propagating, percent, round_ratio, yes_no,
)
