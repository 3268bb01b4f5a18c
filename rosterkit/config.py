"""Run configuration and the fixed values of the compliance rules.

Every "today" of the original workflow is the explicit ``as_of`` field.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the original rules (kept together, in order).
# ---------------------------------------------------------------------------
# Procedure codes that make a service eligible (case management, supports
# coordination, respite, home based, assertive community treatment).
ELIGIBLE_PROCEDURE_CODES = ("T1016", "T1017", "H0045", "S5151", "T1005", "T2036", "T2037", "H0036", "H0039")
# Payer codes: Medicaid, Medicaid spend-down.
ELIGIBLE_PAYER_CODES = ("Y", "S")
# Provider names recoded for consistent reference; other names stay as they are.
PROVIDER_RECODE = {
    "6-Genesee Health System": "Genesee Health System",
    "2-Lapeer County Community Mental Health": "Lapeer County CMH",
    "3-St. Clair County Community Mental Health": "St. Clair County CMH",
    "4-Sanilac County Community Mental Health": "Sanilac County CMH",
}
# Spreadsheet cells read as missing.
ASSESSMENT_NULL_TOKENS = ("", " ", "NA", "Choose one", "Enterprise Wide")
COMPLETED_STATUS = "COMPLETED"
# Worklist statuses in priority order (rank 1 first) ...
STATUS_INITIAL = "Initial SIS Needed"
STATUS_OVERDUE = "Reassessment Overdue"
STATUS_COMING = "Reassessment Due in 90 Days"
STATUS_IN_FY = "Other upcoming in current FY"
STATUS_EXPIRED_DEFERRAL = "Expired Deferral"
# ... and the statuses that are computed but left out of the worklist.
STATUS_ACTIVE_DEFERRAL = "Active Deferral"
STATUS_COMPLETED_INELIGIBLE = "SIS completed but ineligible"
# Point-in-time worklist statuses.
STATUS_COMING_30 = "Reassessment Due in 30 Days"
FY_KEPT_STATUSES = (STATUS_INITIAL, STATUS_OVERDUE)
# Label of the appended all-provider total row.
TOTAL_LABEL = "Region 10"
# Due dates earlier than this are moved to it.
DUE_FLOOR = dt.date(2017, 9, 30)
# Assessment clock format changed on this date (h:mm AM from here on, h:mm:ss AM before).
CLOCK_FORMAT_CHANGE = dt.date(2016, 10, 1)
# Display names of the completion summary (the original's report headers), in order.
SUMMARY_DISPLAY = {
    "cmhsp": "CMHSP",
    "denominator": "Individuals eligible without refusal (Denominator)",
    "denominator_fy": "Individuals eligible without refusal in Current FY (Denominator)",
    "numerator": "Individuals with a current SIS (Numerator)",
    "eligible": "Individuals eligible to receive SIS",
    "due_in_fy": "Individuals with SIS due in current Fiscal Year",
    "completed_elig": "Eligible individuals with a completed SIS",
    "completed_inel": "Ineligible individuals with a completed SIS",
    "overdue": "Individuals with an expired SIS",
    "deferred": "Individuals who refused to take SIS",
    "percent_complete": "Individuals with a current SIS / Individuals eligible for SIS",
    "percent_complete_fy": "Individuals with a current SIS / Individuals with SIS due in FY",
}
# Set-overlap cohort labels (in set order).
OVERLAP_LABELS = ("Eligible Services", "Eligible QI", "Completed SIS", "Deferred")


@dataclass(frozen=True)
class Source:
    """One input: CSV files (paths or globs) and how they are laid out."""
    paths: tuple[str, ...]
    skip: int = 0                     # preamble lines before each header
    drop_rows_after_header: int = 0   # description rows
    multiline: bool = False           # quoted fields may hold line breaks


@dataclass(frozen=True)
class Inputs:
    """Where a run finds its five extracts.

    ``deferrals``: one entry per sheet: (source, key column, date column, date kind), as ``union_sources`` takes them.
    """
    services: Source
    attributes: Source
    assessments: Source
    deferrals: tuple[tuple[Source, str, str, str], ...]
    admissions: Source


@dataclass(frozen=True)
class RunConfig:
    as_of: dt.date
    procedure_codes: tuple[str, ...] = ELIGIBLE_PROCEDURE_CODES
    payer_codes: tuple[str, ...] = ELIGIBLE_PAYER_CODES
    provider_recode: dict = field(default_factory=lambda: dict(PROVIDER_RECODE))
    min_age: float = 18
    days_per_year: float = 365.25
    deferral_days: int = 365
    coming_days: int = 90
    coming_days_fy: int = 30
    reassess_days_fy: int = 365 * 3
    rollover_month: int = 10
    due_floor: dt.date | None = None
    fy_cutoff: dt.date | None = None
    clock_format_change: dt.date = CLOCK_FORMAT_CHANGE
    total_label: str = TOTAL_LABEL
    # people with more distinct deferrals or admissions than this are split over tasks; None: nobody is
    fan_out_limit: int | None = 1024
    # parity switches for documented quirks
    blank_uses_proxies: bool = False
    dense_priority: bool = False
    fy_uncut_assessments: bool = False   # Q9: the point-in-time roster takes all assessments, as the original joins them
