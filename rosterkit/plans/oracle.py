"""DuckDB SQL oracle for every registered query.

Written independently of the Spark plans: clean values are derived straight
from the driver tables' columns (the Spark side parses them back out of the
dirty stand-in text), and the roster follows the original's literal shape
(full outer joins with NULL-matching keys, a final DISTINCT, a 6-way unpivot
for the worklist, a window minimum).  Agreement therefore checks the id /
date cleaning, the spine + left-join rewrite and the unpivot-free worklist.
"""

from __future__ import annotations

from ..sources.standin import (
    EVENT_EPOCH_SECONDS, STANDIN_AS_OF, STANDIN_DUE_FLOOR, STANDIN_FY_CUTOFF, STANDIN_PROVIDER_RECODE,
)

AS_OF = f"DATE '{STANDIN_AS_OF.isoformat()}'"
# the day that the stand-in extracts count back from: theirs, not the run's
DATA_DAY = f"CAST('{STANDIN_AS_OF.isoformat()}' AS DATE)"
FLOOR = f"DATE '{STANDIN_DUE_FLOOR.isoformat()}'"
FY_CUT = f"DATE '{STANDIN_FY_CUTOFF.isoformat()}'"
TOTAL = "'Region 10'"
SECONDS_PER_AGE_YEAR = repr(86400.0 * 365.242)


def _half_even(x: str, d: str, scale: int) -> str:
    """round(x / d, 1) half-to-even with integer arithmetic; x is pre-multiplied by 10*scale."""
    ax, ad = f"abs({x})", f"abs({d})"
    q, r = f"({ax} // {ad})", f"({ax} % {ad})"
    bump = f"CASE WHEN 2 * {r} > {ad} OR (2 * {r} = {ad} AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    return (f"CASE WHEN ({d}) = 0 OR ({d}) IS NULL OR ({x}) IS NULL THEN NULL "
            f"ELSE CAST(sign({x}) * sign({d}) * ({q} + {bump}) AS DOUBLE) / {scale}.0 END")


def pct(n: str, d: str) -> str:
    return _half_even(f"(CAST({n} AS BIGINT) * 1000)", f"CAST({d} AS BIGINT)", 10)


def rr(n: str, d: str) -> str:
    return _half_even(f"(CAST({n} AS BIGINT) * 10)", f"CAST({d} AS BIGINT)", 10)


def _recode_sql(raw: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STANDIN_PROVIDER_RECODE.items())
    return f"CASE {raw} {whens} ELSE {raw} END"


def add_months_sql(d: str, n: int) -> str:
    m = f"CAST({d} + INTERVAL ({n}) MONTH AS DATE)"
    return f"CASE WHEN day({m}) = day({d}) THEN {m} END"


PID = "lpad(CAST({k} + 1 AS VARCHAR), 10, '0')"

PRELUDE = f"""
WITH
svs_raw AS (
  SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, o.o_orderpriority, l.l_returnflag, l.l_linestatus,
         l.l_discount, l.l_suppkey, CAST(l.l_shipdate AS DATE) AS ship,
         CAST(r.r_regionkey AS VARCHAR) || '-' || r.r_name AS provider_raw
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
svs AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS clm_id,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE {PID.format(k='o_custkey')} END AS MEDICAID_ID,
         {_recode_sql('provider_raw')} AS PROVIDER_NAME,
         o_orderpriority AS CPT_CD, l_returnflag AS MEDICAID, ship AS FROM_DATE, ship AS THRU_DATE,
         l_returnflag = 'R' AS HAB_WAIVER, l_linestatus = 'O' AS HMP_ELIG, l_discount >= 0.05 AS HMP_BUCKET
  FROM svs_raw
),
svs_ids AS (SELECT DISTINCT MEDICAID_ID FROM svs),
elig_svs AS (
  SELECT MEDICAID_ID, PROVIDER_NAME, min(FROM_DATE) AS initial_service, max(FROM_DATE) AS most_recent_service,
         TRUE AS eligible_svs
  FROM svs WHERE CPT_CD IN ('1-URGENT', '2-HIGH') AND (MEDICAID IN ('A') OR HMP_ELIG)
  GROUP BY MEDICAID_ID, PROVIDER_NAME
),
attrs AS (
  SELECT {PID.format(k='c_custkey')} AS MEDICAID_ID,
         CASE c_mktsegment WHEN 'BUILDING' THEN '2' WHEN 'MACHINERY' THEN NULL WHEN 'HOUSEHOLD' THEN '3'
              ELSE '1' END AS DISABILITYDD,
         CASE WHEN c_acctbal > 2000 THEN '1' END AS MOBILITY,
         CASE WHEN c_acctbal < 0 THEN '1' END AS PERSONAL,
         CASE WHEN c_nationkey < 10 THEN '1' END AS SUPPORT_SYSTEM,
         DATE '1975-01-01' + CAST(floor(c_acctbal) AS INTEGER) AS DATE_OF_BIRTH
  FROM customer
),
elig_qi AS (
  SELECT MEDICAID_ID, TRUE AS eligible_qi FROM attrs
  WHERE DISABILITYDD <> '2'
    AND (DISABILITYDD = '1' OR MOBILITY IS NOT NULL OR PERSONAL IS NOT NULL OR SUPPORT_SYSTEM IS NOT NULL)
    AND CAST({AS_OF} - DATE_OF_BIRTH AS DOUBLE) / 365.25 >= 18
),
sis_all AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sis_id, {PID.format(k='o_custkey')} AS mcaid_id, o_orderstatus,
         o_orderpriority = '5-LOW' AS low, o_totalprice, o_orderdate, CAST(o_orderdate AS DATE) AS sis_completed_dt
  FROM orders
),
sis AS (
  SELECT sis_id, mcaid_id, sis_completed_dt,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR AS start,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR
           + to_minutes(CAST(floor(o_totalprice / 5000) AS BIGINT)) AS "end",
         CAST(floor(o_totalprice / 5000) AS DOUBLE) AS duration,
         CAST({AS_OF} - sis_completed_dt AS INTEGER) AS DaysSince,
         CAST(sis_completed_dt - CAST(9000 + floor(o_totalprice / 100) AS INTEGER) AS TIMESTAMP) AS sis_cl_dob_dt,
         CAST((dayofyear(sis_completed_dt) - 1) // 7 + 1 AS INTEGER) AS sis_wk,
         CAST(year(sis_completed_dt) AS INTEGER) AS sis_yr,
         CAST(sis_completed_dt - CAST(dayofweek(sis_completed_dt) AS INTEGER) AS DATE) AS sis_yrwk,
         sis_completed_dt + 30 AS isp_begin_date,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 8 HOUR + INTERVAL 30 MINUTE AS statusChangeDate,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY AS dateUpdated
  FROM sis_all WHERE low AND o_orderstatus = 'F'
),
sis_ids AS (
  SELECT mcaid_id, CASE WHEN count(*) = count(sis_completed_dt) THEN max(sis_completed_dt) END AS sis_completed_dt
  FROM sis GROUP BY mcaid_id
),
defer_raw AS (
  SELECT CAST(user_id * 10 + 1 AS VARCHAR) AS raw_id,
         CAST({DATA_DAY} - CAST(floor((epoch(ts) - {EVENT_EPOCH_SECONDS}) / 3600) AS INTEGER) AS DATE) AS defer_date
  FROM events
),
sis_defer AS (
  SELECT lpad(raw_id, 10, '0') AS MEDICAID_ID, defer_date, TRUE AS deferral,
         CASE WHEN defer_date + 365 < {AS_OF} THEN FALSE WHEN defer_date IS NULL THEN FALSE
              WHEN defer_date + 365 >= {AS_OF} THEN TRUE END AS deferral_active
  FROM defer_raw
),
adm AS (
  SELECT user_id * 10 + event_id % 5 AS k, {PID.format(k='(user_id * 10 + event_id % 5)')} AS medicaid_id,
         CAST({DATA_DAY} - 2 * CAST(floor((epoch(ts) - {EVENT_EPOCH_SECONDS}) / 3600) AS INTEGER) AS DATE) AS d
  FROM events
),
open_date AS (
  SELECT DISTINCT medicaid_id, d AS agency_admission_date FROM adm a
  WHERE d = (SELECT max(b.d) FROM adm b WHERE b.k = a.k)
),
c0 AS (
  SELECT coalesce(a.MEDICAID_ID, e.MEDICAID_ID) AS MEDICAID_ID, e.PROVIDER_NAME, e.initial_service,
         e.most_recent_service, e.eligible_svs
  FROM svs_ids a FULL JOIN elig_svs e ON a.MEDICAID_ID IS NOT DISTINCT FROM e.MEDICAID_ID
),
c1 AS (
  SELECT coalesce(c0.MEDICAID_ID, q.MEDICAID_ID) AS MEDICAID_ID, c0.PROVIDER_NAME, c0.initial_service,
         c0.most_recent_service, c0.eligible_svs, q.eligible_qi
  FROM c0 FULL JOIN elig_qi q ON c0.MEDICAID_ID IS NOT DISTINCT FROM q.MEDICAID_ID
),
c2 AS (
  SELECT c1.MEDICAID_ID, PROVIDER_NAME, initial_service, most_recent_service,
         coalesce(eligible_svs, FALSE) AS eligible_svs, coalesce(eligible_qi, FALSE) AS eligible_qi,
         d.defer_date, coalesce(d.deferral, FALSE) AS deferral, d.deferral_active
  FROM c1 LEFT JOIN sis_defer d ON c1.MEDICAID_ID IS NOT DISTINCT FROM d.MEDICAID_ID
),
c3 AS (
  SELECT coalesce(c2.MEDICAID_ID, s.mcaid_id) AS MEDICAID_ID, c2.PROVIDER_NAME, c2.initial_service,
         c2.most_recent_service, c2.eligible_svs, c2.eligible_qi, c2.defer_date, c2.deferral,
         c2.deferral_active, s.sis_completed_dt
  FROM c2 FULL JOIN sis_ids s ON c2.MEDICAID_ID IS NOT DISTINCT FROM s.mcaid_id
),
c4 AS (
  SELECT *, eligible_svs AND eligible_qi AS sis_eligible FROM c3
  WHERE (eligible_svs OR eligible_qi OR sis_completed_dt IS NOT NULL) AND MEDICAID_ID IS NOT NULL
),
c5 AS (
  SELECT *, sis_completed_dt IS NOT NULL AND sis_eligible AS sis_complete_elig,
            sis_completed_dt IS NOT NULL AND NOT sis_eligible AS sis_complete_inel
  FROM c4
),
c6 AS (
  SELECT *, sis_complete_elig OR sis_complete_inel AS sis_complete_any FROM c5
  WHERE sis_eligible OR sis_complete_inel
),
c7 AS (
  SELECT DISTINCT c6.*, o.agency_admission_date
  FROM c6 LEFT JOIN open_date o ON c6.MEDICAID_ID IS NOT DISTINCT FROM o.medicaid_id
),
c8 AS (
  SELECT *, DATE '{STANDIN_AS_OF.year + (1 if STANDIN_AS_OF.month >= 10 else 0)}-09-30' AS end_of_fy,
    CASE
      WHEN sis_completed_dt IS NULL AND deferral_active = FALSE THEN {add_months_sql('defer_date', 12)}
      WHEN sis_completed_dt IS NULL THEN {add_months_sql('agency_admission_date', 9)}
      WHEN agency_admission_date IS NULL THEN {add_months_sql('sis_completed_dt', 36)}
      WHEN sis_completed_dt >= agency_admission_date THEN {add_months_sql('sis_completed_dt', 36)}
      WHEN sis_completed_dt < agency_admission_date THEN {add_months_sql('sis_completed_dt', 36)}
    END AS due0
  FROM c7
),
c9 AS (
  SELECT *, CASE WHEN due0 < {FLOOR} THEN {FLOOR} WHEN due0 >= {FLOOR} THEN due0 END AS due_by_dt FROM c8
),
roster AS (
  SELECT MEDICAID_ID, PROVIDER_NAME, sis_completed_dt, due_by_dt, defer_date, agency_admission_date,
         initial_service, most_recent_service, eligible_svs, eligible_qi, deferral, deferral_active,
         sis_eligible, sis_complete_elig, sis_complete_inel, sis_complete_any, end_of_fy,
         due_by_dt < {AS_OF} AND sis_completed_dt IS NOT NULL AS sis_overdue,
         due_by_dt < {AS_OF} + 90 AND due_by_dt >= {AS_OF} AS sis_coming90,
         due_by_dt <= end_of_fy AS due_in_fy
  FROM c9
),
w0 AS (
  SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt, sis_completed_dt,
         sis_complete_any, sis_complete_inel, sis_overdue, sis_coming90, due_in_fy, deferral_active
  FROM roster WHERE PROVIDER_NAME IS NOT NULL
),
w1 AS (
  SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt, sis_completed_dt,
         'sis_complete_any' AS field, sis_complete_any AS val FROM w0
  UNION ALL SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt,
         sis_completed_dt, 'sis_complete_inel', sis_complete_inel FROM w0
  UNION ALL SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt,
         sis_completed_dt, 'sis_overdue', sis_overdue FROM w0
  UNION ALL SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt,
         sis_completed_dt, 'sis_coming90', sis_coming90 FROM w0
  UNION ALL SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt,
         sis_completed_dt, 'due_in_fy', due_in_fy FROM w0
  UNION ALL SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt,
         sis_completed_dt, 'deferral_active', deferral_active FROM w0
),
w2 AS (
  SELECT *, CASE
      WHEN field = 'sis_complete_any' AND val = FALSE THEN 'Initial SIS Needed'
      WHEN field = 'sis_complete_inel' AND val = TRUE THEN 'SIS completed but ineligible'
      WHEN field = 'sis_overdue' AND val = TRUE THEN 'Reassessment Overdue'
      WHEN field = 'sis_coming90' AND val = TRUE THEN 'Reassessment Due in 90 Days'
      WHEN field = 'due_in_fy' AND val = TRUE THEN 'Other upcoming in current FY'
      WHEN field = 'deferral_active' AND val = TRUE THEN 'Active Deferral'
      WHEN field = 'deferral_active' AND val = FALSE THEN 'Expired Deferral'
    END AS status
  FROM w1
),
w3 AS (
  SELECT *, CAST(CASE status WHEN 'Initial SIS Needed' THEN 1 WHEN 'Reassessment Overdue' THEN 2
                  WHEN 'Reassessment Due in 90 Days' THEN 3 WHEN 'Other upcoming in current FY' THEN 4
                  WHEN 'Expired Deferral' THEN 5 END AS INTEGER) AS n_priority
  FROM w2
  WHERE status IS NOT NULL
    AND status NOT IN ('Active Deferral', 'SIS completed but ineligible', 'Closed in PCE MiX system')
),
worklist AS (
  SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt, sis_completed_dt,
         status, status AS priority, n_priority
  FROM w3 QUALIFY n_priority = min(n_priority) OVER (PARTITION BY MEDICAID_ID)
),
s1 AS (
  SELECT PROVIDER_NAME AS cmhsp,
         count(*) FILTER (WHERE sis_eligible) AS eligible,
         count(*) FILTER (WHERE due_in_fy) AS due_in_fy,
         count(*) FILTER (WHERE deferral_active) AS deferred,
         count(*) FILTER (WHERE sis_complete_elig) AS completed_elig,
         count(*) FILTER (WHERE sis_complete_inel) AS completed_inel,
         count(*) FILTER (WHERE sis_overdue) AS overdue,
         0 AS is_total
  FROM roster WHERE PROVIDER_NAME IS NOT NULL AND sis_eligible
  GROUP BY PROVIDER_NAME
),
s2 AS (
  SELECT * FROM s1
  UNION ALL
  SELECT {TOTAL}, CAST(sum(eligible) AS BIGINT), CAST(sum(due_in_fy) AS BIGINT), CAST(sum(deferred) AS BIGINT),
         CAST(sum(completed_elig) AS BIGINT), CAST(sum(completed_inel) AS BIGINT), CAST(sum(overdue) AS BIGINT), 1
  FROM s1
),
summary AS (
  SELECT cmhsp, eligible - deferred AS denominator, due_in_fy - deferred AS denominator_fy,
         completed_elig - overdue AS numerator, eligible, due_in_fy, completed_elig, completed_inel, overdue,
         deferred, {pct('completed_elig - overdue', 'eligible - deferred')} AS percent_complete,
         {pct('completed_elig - overdue', 'due_in_fy - deferred')} AS percent_complete_fy,
         CAST(is_total AS INTEGER) AS is_total
  FROM s2
),
monthly AS (
  SELECT PROVIDER_NAME, CAST(date_trunc('month', sis_completed_dt) AS DATE) AS month_complete, count(*) AS n
  FROM roster WHERE PROVIDER_NAME IS NOT NULL AND sis_complete_elig
  GROUP BY PROVIDER_NAME, CAST(date_trunc('month', sis_completed_dt) AS DATE)
),
per_mo AS (
  SELECT month_complete, CAST(sum(n) AS BIGINT) AS n FROM monthly
  WHERE month_complete >= CAST(date_trunc('month', (SELECT max(month_complete) FROM monthly) - 365) AS DATE)
  GROUP BY month_complete
),
elig_svs_fy AS (
  SELECT MEDICAID_ID, PROVIDER_NAME, min(FROM_DATE) AS initial_service, max(FROM_DATE) AS most_recent_service,
         TRUE AS eligible_svs
  FROM svs WHERE CPT_CD IN ('1-URGENT', '2-HIGH') AND (MEDICAID IN ('A') OR HMP_ELIG) AND FROM_DATE <= {FY_CUT}
  GROUP BY MEDICAID_ID, PROVIDER_NAME
),
sis_ids_fy AS (
  SELECT mcaid_id, max(sis_completed_dt) AS sis_completed_dt FROM sis
  WHERE sis_completed_dt <= {FY_CUT} GROUP BY mcaid_id
),
f0 AS (
  SELECT coalesce(a.MEDICAID_ID, e.MEDICAID_ID) AS MEDICAID_ID, e.PROVIDER_NAME, e.initial_service,
         e.most_recent_service, e.eligible_svs
  FROM svs_ids a FULL JOIN elig_svs_fy e ON a.MEDICAID_ID IS NOT DISTINCT FROM e.MEDICAID_ID
),
f1 AS (
  SELECT coalesce(f0.MEDICAID_ID, q.MEDICAID_ID) AS MEDICAID_ID, f0.PROVIDER_NAME, f0.initial_service,
         f0.most_recent_service, f0.eligible_svs, q.eligible_qi
  FROM f0 FULL JOIN elig_qi q ON f0.MEDICAID_ID IS NOT DISTINCT FROM q.MEDICAID_ID
),
f2 AS (
  SELECT f1.MEDICAID_ID, PROVIDER_NAME, initial_service, most_recent_service,
         coalesce(eligible_svs, FALSE) AS eligible_svs, coalesce(eligible_qi, FALSE) AS eligible_qi,
         d.defer_date, coalesce(d.deferral, FALSE) AS deferral, d.deferral_active
  FROM f1 LEFT JOIN sis_defer d ON f1.MEDICAID_ID IS NOT DISTINCT FROM d.MEDICAID_ID
),
f3 AS (
  SELECT coalesce(f2.MEDICAID_ID, s.mcaid_id) AS MEDICAID_ID, f2.PROVIDER_NAME, f2.initial_service,
         f2.most_recent_service, f2.eligible_svs, f2.eligible_qi, f2.defer_date, f2.deferral,
         f2.deferral_active, s.sis_completed_dt
  FROM f2 FULL JOIN sis_ids_fy s ON f2.MEDICAID_ID IS NOT DISTINCT FROM s.mcaid_id
),
fy_roster AS (
  SELECT DISTINCT * FROM (
    SELECT *, eligible_svs AND eligible_qi AS sis_eligible,
           sis_completed_dt IS NOT NULL AS sis_complete,
           sis_completed_dt + 1095 < {AS_OF} AS sis_overdue,
           sis_completed_dt + 1095 < {AS_OF} + 30 AND sis_completed_dt + 1095 >= {AS_OF} AS sis_coming30
    FROM f3
    WHERE (eligible_svs OR eligible_qi OR sis_completed_dt IS NOT NULL) AND MEDICAID_ID IS NOT NULL
  ) WHERE sis_eligible OR sis_complete
),
fy_s1 AS (
  SELECT PROVIDER_NAME, count(*) FILTER (WHERE sis_eligible) AS denominator,
         count(*) FILTER (WHERE sis_complete) AS completed, count(*) FILTER (WHERE sis_overdue) AS overdue,
         0 AS is_total
  FROM fy_roster WHERE sis_eligible AND deferral = FALSE GROUP BY PROVIDER_NAME
),
fy_s2 AS (
  SELECT * FROM fy_s1 UNION ALL
  SELECT {TOTAL}, CAST(sum(denominator) AS BIGINT), CAST(sum(completed) AS BIGINT), CAST(sum(overdue) AS BIGINT), 1
  FROM fy_s1
)
"""

ROSTER_COLS = ("MEDICAID_ID, PROVIDER_NAME, sis_completed_dt, due_by_dt, defer_date, agency_admission_date, "
               "initial_service, most_recent_service, eligible_svs, eligible_qi, deferral, deferral_active, "
               "sis_eligible, sis_complete_elig, sis_complete_inel, sis_complete_any, end_of_fy, sis_overdue, "
               "sis_coming90, due_in_fy")

_OVERLAP_SETS = [
    ("Eligible Services", "SELECT DISTINCT MEDICAID_ID AS id FROM elig_svs WHERE eligible_svs AND MEDICAID_ID IS NOT NULL"),
    ("Eligible QI", "SELECT DISTINCT MEDICAID_ID AS id FROM elig_qi WHERE MEDICAID_ID IS NOT NULL"),
    ("Completed SIS", "SELECT DISTINCT mcaid_id AS id FROM sis_ids WHERE mcaid_id IS NOT NULL"),
    ("Deferred", "SELECT DISTINCT MEDICAID_ID AS id FROM sis_defer WHERE MEDICAID_ID IS NOT NULL"),
]


def _overlap_sql() -> str:
    parts = []
    for mask in range(1, 16):
        idx = [i for i in range(4) if mask >> i & 1]
        inter = " INTERSECT ".join(f"({_OVERLAP_SETS[i][1]})" for i in idx)
        label = f"'{_OVERLAP_SETS[idx[0]][0]}'" if len(idx) == 1 else "CAST(NULL AS VARCHAR)"
        key = ",".join(str(i) for i in idx)
        parts.append(f"SELECT {mask} AS mask, '{key}' AS sets_key, {label} AS label, "
                     f"(SELECT count(*) FROM ({inter})) AS size")
    return " UNION ALL ".join(parts)


def _raw_from_text(d: str, ln: str) -> str:
    return (f"CASE WHEN {ln} = 4 THEN strftime({d}, '%m/%d/%y') WHEN {ln} IN (1, 3, 5) "
            f"THEN strftime({d}, '%-m/%-d/%Y') ELSE strftime({d}, '%Y-%m-%d') END")


def _raw_id_text() -> str:
    k = "CAST(o_custkey + 1 AS VARCHAR)"
    return (f"CASE WHEN l_linenumber = 1 THEN ' MI' || {k} || ' ' WHEN l_linenumber = 2 THEN 'ID-' || {k} "
            f"WHEN l_linenumber = 3 THEN '99' || lpad({k}, 10, '0') WHEN l_linenumber = 7 THEN 'N/A' "
            f"ELSE lpad({k}, 10, '0') END")


def _yn(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'Y' ELSE 'N' END"


# the columns of the written extract that types are inferred from: name -> (text in SQL)
TYPED = {
    "order": "CAST(o_orderkey AS VARCHAR)", "open": "CASE WHEN o_orderstatus = 'O' THEN 'TRUE' ELSE 'FALSE' END",
    "price": "CAST(o_totalprice AS VARCHAR)", "ordered": "strftime(o_orderdate, '%Y-%m-%d')", "priority": "o_orderpriority",
    "code": "lpad(CAST(o_custkey AS VARCHAR), 8, '0')", "nothing": "CAST(NULL AS VARCHAR)",
    "month": "strftime(o_orderdate, '%-m/%-d/%Y')",
}


def _inferred_types() -> str:
    """Types from the values' shapes: the first of logical, integer, double and date that all values have, else text."""
    shapes = [("logical", "(T|F|TRUE|FALSE|true|false)"), ("integer", "[+-]?(0|[1-9][0-9]*)"),
              ("double", r"[+-]?(0|[1-9][0-9]*)(\.[0-9]*)?([eE][+-]?[0-9]+)?"), ("date", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")]
    parts = []
    for name, text in TYPED.items():
        whens = " ".join(f"WHEN bool_and(regexp_full_match(v, '{shape}')) THEN '{kind}'" for kind, shape in shapes)
        parts.append(f"""SELECT '{name}' AS "column", CASE WHEN count(v) = 0 THEN 'empty' {whens} ELSE 'text' END AS type, count(v) AS n_values
          FROM (SELECT {text} AS v FROM orders)""")
    return " UNION ALL ".join(parts)


def _timeline_sql() -> str:
    """The point-in-time summary written out for each run date: claims and assessments cut at that date."""
    return f"""WITH dates AS (
        SELECT CAST(unnest(generate_series(DATE '1992-01-31', {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS run_date
      ), ends AS (SELECT run_date FROM dates WHERE month(run_date + 1) <> month(run_date)),
      adults AS (SELECT MEDICAID_ID, DATE_OF_BIRTH FROM attrs WHERE DISABILITYDD <> '2'
          AND (DISABILITYDD = '1' OR MOBILITY IS NOT NULL OR PERSONAL IS NOT NULL OR SUPPORT_SYSTEM IS NOT NULL)),
      pair AS (SELECT e.MEDICAID_ID, e.PROVIDER_NAME, e.initial_service, a.DATE_OF_BIRTH FROM elig_svs e JOIN adults a ON a.MEDICAID_ID = e.MEDICAID_ID
          WHERE e.MEDICAID_ID NOT IN (SELECT MEDICAID_ID FROM sis_defer WHERE MEDICAID_ID IS NOT NULL)),
      done AS (SELECT run_date, mcaid_id, max(sis_completed_dt) AS d FROM ends JOIN sis ON sis_completed_dt <= run_date GROUP BY 1, 2),
      counted AS (SELECT e.run_date, p.PROVIDER_NAME, count(*) AS denominator, count(o.d) AS completed, count(*) FILTER (WHERE o.d + 1095 < e.run_date) AS overdue
          FROM ends e JOIN pair p ON p.initial_service <= e.run_date AND CAST(e.run_date - p.DATE_OF_BIRTH AS DOUBLE) / 365.25 >= 18
          LEFT JOIN done o ON o.run_date = e.run_date AND o.mcaid_id = p.MEDICAID_ID GROUP BY 1, 2),
      whole AS (SELECT *, 0 AS is_total FROM counted UNION ALL
          SELECT run_date, {TOTAL}, sum(denominator)::BIGINT, sum(completed)::BIGINT, sum(overdue)::BIGINT, 1 FROM counted GROUP BY run_date)
      SELECT run_date, PROVIDER_NAME, denominator, completed, overdue, completed - overdue AS numerator,
        {pct('completed - overdue', 'denominator')} AS percent_complete, CAST(is_total AS INTEGER) AS is_total FROM whole"""


def _many_sets_sql() -> str:
    """Pairs and triples of 40 sets: people by day of month (31 sets) and by provider and code (9 more)."""
    return """WITH member AS (
        SELECT DISTINCT MEDICAID_ID AS id, day(FROM_DATE) - 1 AS s FROM svs WHERE MEDICAID_ID IS NOT NULL
        UNION SELECT DISTINCT MEDICAID_ID, 31 + CAST(regexp_extract(provider_raw, '^[0-9]') AS INTEGER) FROM (
          SELECT provider_raw, CASE WHEN l_linenumber = 7 THEN NULL ELSE lpad(CAST(o_custkey + 1 AS VARCHAR), 10, '0') END AS MEDICAID_ID FROM svs_raw) WHERE MEDICAID_ID IS NOT NULL
        UNION SELECT DISTINCT MEDICAID_ID, 35 + CAST(left(CPT_CD, 1) AS INTEGER) FROM svs WHERE MEDICAID_ID IS NOT NULL AND CPT_CD < '5')
      SELECT CAST(s AS VARCHAR) AS sets_key, count(*) AS size FROM member GROUP BY s
      UNION ALL SELECT a.s || ',' || b.s, count(*) FROM member a JOIN member b ON a.id = b.id AND a.s < b.s GROUP BY a.s, b.s"""


FINAL = {
    # marts
    "services_clean": "SELECT clm_id, MEDICAID_ID, PROVIDER_NAME, CPT_CD, MEDICAID, FROM_DATE, THRU_DATE, "
                      "HAB_WAIVER, HMP_ELIG, HMP_BUCKET FROM svs",
    "services_via_files": "SELECT clm_id, MEDICAID_ID, PROVIDER_NAME, CPT_CD, MEDICAID, FROM_DATE, THRU_DATE, "
                          "HAB_WAIVER, HMP_ELIG, HMP_BUCKET FROM svs",
    "admissions_via_files": "SELECT * FROM open_date",
    "assessments_via_files": """SELECT sis_id, CASE WHEN low AND o_orderstatus = 'F' THEN 'COMPLETED' WHEN low AND o_orderstatus = 'O' THEN 'IN PROGRESS' END AS statusText,
        CASE WHEN o_totalprice > 300000 THEN NULL ELSE 'Region' END AS sis_region FROM sis_all""",
    "load_audit": """SELECT (c_custkey % 4)::INTEGER AS file, count(*) AS rows FROM customer GROUP BY 1""",
    "quoted_records_via_files": r"""SELECT doc_id, lang, source, nullif(trim(text), '') AS text, len(string_split(trim(text), chr(10))) - 1 AS n_breaks FROM documents""",
    "inferred_types": _inferred_types(),
    "encode_levels": """SELECT clm_id, dense_rank() OVER (ORDER BY PROVIDER_NAME) AS PROVIDER_NAME_code, dense_rank() OVER (ORDER BY CPT_CD) AS CPT_CD_code,
        dense_rank() OVER (ORDER BY FROM_DATE) AS FROM_DATE_code FROM svs""",
    "drop_levels": """WITH people AS (SELECT DISTINCT MEDICAID_ID AS level FROM svs WHERE MEDICAID_ID IS NOT NULL),
        old AS (SELECT level, row_number() OVER (ORDER BY level) AS old_code FROM people),
        used AS (SELECT DISTINCT MEDICAID_ID AS level FROM elig_svs WHERE MEDICAID_ID IS NOT NULL)
      SELECT 'MEDICAID_ID' AS "column", old_code, row_number() OVER (ORDER BY level) AS code, level FROM old WHERE level IN (SELECT level FROM used)""",
    "incremental_services": """SELECT PROVIDER_NAME, count(*) AS n_claims, count(DISTINCT MEDICAID_ID) AS n_people, min(FROM_DATE) AS first_service, max(FROM_DATE) AS last_service
      FROM svs GROUP BY PROVIDER_NAME""",
    "summary_timeline": _timeline_sql(),
    "set_overlap_many": _many_sets_sql(),
    "people_sketches": """SELECT PROVIDER_NAME, CAST(date_trunc('month', FROM_DATE) AS DATE) AS month, count(DISTINCT MEDICAID_ID) AS n_people, TRUE AS within
      FROM svs WHERE MEDICAID_ID IS NOT NULL GROUP BY 1, 2""",
    "sketch_unions": """SELECT PROVIDER_NAME, count(DISTINCT MEDICAID_ID) AS n_people, TRUE AS within FROM svs WHERE MEDICAID_ID IS NOT NULL GROUP BY 1""",
    "kept_people": """WITH m AS (SELECT DISTINCT PROVIDER_NAME AS p, CAST(date_trunc('month', FROM_DATE) AS DATE) AS month, MEDICAID_ID AS id FROM svs WHERE MEDICAID_ID IS NOT NULL)
      SELECT a.p AS PROVIDER_NAME, a.month, count(*) AS n_people, count(b.id) AS n_kept, count(*) - count(b.id) AS n_new, TRUE AS within
      FROM m a LEFT JOIN m b ON b.p IS NOT DISTINCT FROM a.p AND b.id = a.id AND b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE) GROUP BY 1, 2""",
    "trailing_months_dense": f"""WITH r AS (SELECT max(month_complete) AS last FROM monthly),
        c AS (SELECT CAST(unnest(generate_series(date_trunc('month', last - 365), last, INTERVAL 1 MONTH)) AS DATE) AS month_complete FROM r),
        t AS (SELECT c.month_complete, coalesce(sum(n), 0)::BIGINT AS n FROM c LEFT JOIN monthly m USING (month_complete) GROUP BY 1)
      SELECT month_complete, n, {rr('(SELECT sum(n) FROM t)', '(SELECT count(*) FROM t)')} AS mean_per_month FROM t""",
    "dense_months": """WITH r AS (SELECT max(month_complete) AS last FROM monthly),
        c AS (SELECT CAST(unnest(generate_series(date_trunc('month', last - 365), last, INTERVAL 1 MONTH)) AS DATE) AS month_complete FROM r)
      SELECT p.PROVIDER_NAME, c.month_complete, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT PROVIDER_NAME FROM monthly) p CROSS JOIN c
      LEFT JOIN monthly m ON m.PROVIDER_NAME IS NOT DISTINCT FROM p.PROVIDER_NAME AND m.month_complete = c.month_complete""",
    "service_eligibility": "SELECT * FROM elig_svs",
    "attributes_clean": "SELECT MEDICAID_ID, DISABILITYDD, MOBILITY, PERSONAL, SUPPORT_SYSTEM, DATE_OF_BIRTH FROM attrs",
    "attribute_eligibility": "SELECT * FROM elig_qi",
    "assessments_clean": f"""SELECT sis_id, mcaid_id, sis_completed_dt, start, "end", duration, DaysSince,
        CAST(floor((epoch(CAST(sis_completed_dt AS TIMESTAMP)) - epoch(sis_cl_dob_dt)) / {SECONDS_PER_AGE_YEAR}) AS BIGINT) AS age,
        sis_wk, sis_yr, sis_yrwk, isp_begin_date, statusChangeDate FROM sis""",
    "latest_assessment": "SELECT * FROM sis_ids",
    "deferral_status": "SELECT * FROM sis_defer",
    "open_admissions": "SELECT * FROM open_date",
    "roster": f"SELECT {ROSTER_COLS} FROM roster",
    "due_dates": "SELECT MEDICAID_ID, PROVIDER_NAME, sis_completed_dt, defer_date, deferral_active, "
                 "agency_admission_date, due_by_dt FROM roster",
    "compliance_flags": "SELECT MEDICAID_ID, PROVIDER_NAME, due_by_dt, end_of_fy, sis_overdue, sis_coming90, "
                        "due_in_fy FROM roster",
    "eligibility_flags": "SELECT MEDICAID_ID, PROVIDER_NAME, eligible_svs, eligible_qi, sis_eligible, "
                         "sis_complete_elig, sis_complete_inel, sis_complete_any FROM roster",
    "select_prefixed": """SELECT MEDICAID_ID, PROVIDER_NAME, sis_completed_dt, sis_eligible, sis_complete_elig, sis_complete_inel, sis_complete_any,
        sis_overdue, sis_coming90 FROM roster""",
    "roster_spread": f"SELECT {ROSTER_COLS} FROM roster",
    "worklist_spread": "SELECT * FROM worklist",
    "worklist": "SELECT * FROM worklist",
    "completion_summary": "SELECT * FROM summary",
    "worklist_split_files": "SELECT * FROM worklist",
    "summary_dated_csv": "SELECT * FROM summary",
    "monthly_completions": "SELECT * FROM monthly",
    "fy_roster": "SELECT MEDICAID_ID, PROVIDER_NAME, initial_service, most_recent_service, eligible_svs, "
                 "eligible_qi, defer_date, deferral, deferral_active, sis_completed_dt, sis_eligible, "
                 "sis_complete, sis_overdue, sis_coming30 FROM fy_roster",
    "fy_worklist": """SELECT MEDICAID_ID, PROVIDER_NAME, initial_service, most_recent_service, status FROM (
        SELECT *, CASE WHEN sis_complete = FALSE THEN 'Initial SIS Needed'
                       WHEN sis_overdue THEN 'Reassessment Overdue'
                       WHEN sis_coming30 THEN 'Reassessment Due in 30 Days' END AS status
        FROM fy_roster
        WHERE sis_eligible AND deferral = FALSE AND (sis_complete = FALSE OR sis_overdue OR sis_coming30))
      WHERE status IN ('Initial SIS Needed', 'Reassessment Overdue')""",
    "fy_summary": f"""SELECT PROVIDER_NAME, denominator, completed, overdue, completed - overdue AS numerator,
        {pct('completed - overdue', 'denominator')} AS percent_complete, CAST(is_total AS INTEGER) AS is_total
      FROM fy_s2""",
    "fy_summary_uncut": f"""WITH r AS (
        SELECT PROVIDER_NAME, s.sis_completed_dt AS d FROM elig_svs_fy e JOIN elig_qi q ON q.MEDICAID_ID = e.MEDICAID_ID LEFT JOIN sis_ids s ON s.mcaid_id = e.MEDICAID_ID
        WHERE e.MEDICAID_ID NOT IN (SELECT MEDICAID_ID FROM sis_defer WHERE MEDICAID_ID IS NOT NULL)),
      t AS (SELECT PROVIDER_NAME, count(*) AS denominator, count(d) AS completed, count(*) FILTER (WHERE d + 1095 < {AS_OF}) AS overdue, 0 AS is_total FROM r GROUP BY 1),
      u AS (SELECT * FROM t UNION ALL SELECT {TOTAL}, sum(denominator)::BIGINT, sum(completed)::BIGINT, sum(overdue)::BIGINT, 1 FROM t)
      SELECT PROVIDER_NAME, denominator, completed, overdue, completed - overdue AS numerator, {pct('completed - overdue', 'denominator')} AS percent_complete,
        CAST(is_total AS INTEGER) AS is_total FROM u""",
    "summary_from_paths": "SELECT * FROM summary",
    "fy_worklist_numbered": """SELECT row_number() OVER (ORDER BY most_recent_service DESC NULLS LAST,
          MEDICAID_ID ASC NULLS LAST, PROVIDER_NAME ASC NULLS LAST, initial_service ASC NULLS LAST,
          status ASC NULLS LAST) AS "row", MEDICAID_ID, PROVIDER_NAME, initial_service, most_recent_service, status
      FROM (SELECT MEDICAID_ID, PROVIDER_NAME, initial_service, most_recent_service, status FROM (
        SELECT *, CASE WHEN sis_complete = FALSE THEN 'Initial SIS Needed'
                       WHEN sis_overdue THEN 'Reassessment Overdue'
                       WHEN sis_coming30 THEN 'Reassessment Due in 30 Days' END AS status
        FROM fy_roster
        WHERE sis_eligible AND deferral = FALSE AND (sis_complete = FALSE OR sis_overdue OR sis_coming30))
      WHERE status IN ('Initial SIS Needed', 'Reassessment Overdue'))""",
    "trailing_months": "SELECT * FROM per_mo",
    "narrative_metrics": f"""SELECT (SELECT max(due_in_fy) FROM summary WHERE is_total = 1) AS needed,
        {rr('(SELECT max(due_in_fy) FROM summary WHERE is_total = 1)', '12')} AS needed_per_month,
        max(month_complete) AS last_month, arg_max(n, month_complete) AS last_month_n,
        {rr('sum(n)', 'count(*)')} AS mean_per_month
      FROM per_mo""",
    "priority_crosstab": """SELECT priority,
        count(*) FILTER (WHERE PROVIDER_NAME = '0-AFRICA') AS n_0_africa,
        count(*) FILTER (WHERE PROVIDER_NAME = 'AMERICA') AS n_america,
        count(*) FILTER (WHERE PROVIDER_NAME = 'ASIA') AS n_asia,
        count(*) FILTER (WHERE PROVIDER_NAME = 'EUROPE') AS n_europe,
        count(*) FILTER (WHERE PROVIDER_NAME = 'MIDDLE EAST') AS n_middle_east,
        count(*) FILTER (WHERE coalesce(PROVIDER_NAME NOT IN ('0-AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'), TRUE)) AS n_other,
        count(*) AS region_total
      FROM worklist GROUP BY priority""",
    "director_table": """SELECT cmhsp AS organization, format('{:,}', denominator) AS denominator,
        format('{:,}', numerator) AS numerator, format('{:,}', eligible) AS eligible, percent_complete,
        format('{:,}', due_in_fy) AS due_this_fy FROM summary""",
    "supervisor_table": """SELECT cmhsp AS organization, format('{:,}', denominator) AS denominator,
        format('{:,}', numerator) AS numerator, format('{:,}', eligible) AS eligible, percent_complete,
        format('{:,}', due_in_fy) AS due_this_fy, format('{:,}', completed_elig) AS completed,
        format('{:,}', overdue) AS overdue, format('{:,}', deferred) AS deferred FROM summary""",
    "summary_display": """SELECT cmhsp AS "CMHSP", denominator AS "Individuals eligible without refusal (Denominator)",
        denominator_fy AS "Individuals eligible without refusal in Current FY (Denominator)",
        numerator AS "Individuals with a current SIS (Numerator)", eligible AS "Individuals eligible to receive SIS",
        due_in_fy AS "Individuals with SIS due in current Fiscal Year",
        completed_elig AS "Eligible individuals with a completed SIS",
        completed_inel AS "Ineligible individuals with a completed SIS",
        overdue AS "Individuals with an expired SIS", deferred AS "Individuals who refused to take SIS",
        percent_complete AS "Individuals with a current SIS / Individuals eligible for SIS",
        percent_complete_fy AS "Individuals with a current SIS / Individuals with SIS due in FY",
        row_number() OVER (ORDER BY is_total, cmhsp) AS "row"
      FROM summary""",
    "reconcile_missing": f"""SELECT {ROSTER_COLS} FROM roster r
      WHERE NOT EXISTS (SELECT 1 FROM worklist w WHERE w.MEDICAID_ID IS NOT DISTINCT FROM r.MEDICAID_ID)
        AND (sis_overdue OR sis_coming90 OR due_in_fy)""",
    "reconcile_counts": """WITH m AS (
        SELECT * FROM roster r
        WHERE NOT EXISTS (SELECT 1 FROM worklist w WHERE w.MEDICAID_ID IS NOT DISTINCT FROM r.MEDICAID_ID)
          AND (sis_overdue OR sis_coming90 OR due_in_fy))
      SELECT count(DISTINCT MEDICAID_ID) + coalesce(max(CASE WHEN MEDICAID_ID IS NULL THEN 1 ELSE 0 END), 0) AS n_people_missing,
        count(*) AS n_rows_missing,
        (SELECT count(DISTINCT MEDICAID_ID) FROM worklist) AS n_worklist_ids,
        (SELECT count(*) FROM (SELECT MEDICAID_ID FROM worklist INTERSECT SELECT MEDICAID_ID FROM roster))
          AS n_worklist_ids_in_roster
      FROM m""",
    "worklist_changes": f"""WITH was AS ({PRELUDE.replace(AS_OF, "DATE '1999-03-31'")} SELECT * FROM worklist),
        b AS (SELECT MEDICAID_ID, PROVIDER_NAME, count(*) AS n, list_sort(list(was::VARCHAR)) AS rows_, string_agg(DISTINCT status, ',' ORDER BY status) AS s
              FROM was GROUP BY ALL),
        a AS (SELECT MEDICAID_ID, PROVIDER_NAME, count(*) AS n, list_sort(list(worklist::VARCHAR)) AS rows_, string_agg(DISTINCT status, ',' ORDER BY status) AS s
              FROM worklist GROUP BY ALL)
      SELECT coalesce(a.MEDICAID_ID, b.MEDICAID_ID) AS MEDICAID_ID, coalesce(a.PROVIDER_NAME, b.PROVIDER_NAME) AS PROVIDER_NAME,
        CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'closed' WHEN a.s <> b.s THEN 'status' ELSE 'details' END AS kind,
        coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(b.s, '') AS status_before, coalesce(a.s, '') AS status_after
      FROM a FULL JOIN b ON a.MEDICAID_ID = b.MEDICAID_ID AND a.PROVIDER_NAME = b.PROVIDER_NAME
      WHERE a.rows_ IS DISTINCT FROM b.rows_""",
    "coverage_gap": """WITH g1 AS (SELECT MEDICAID_ID FROM svs EXCEPT SELECT medicaid_id FROM open_date),
        g2 AS (SELECT MEDICAID_ID FROM worklist EXCEPT SELECT medicaid_id FROM open_date),
        gr AS (SELECT FROM_DATE FROM svs WHERE MEDICAID_ID IN (SELECT MEDICAID_ID FROM g2))
      SELECT (SELECT count(*) FROM g1) AS n_service_ids_without_admission,
        (SELECT count(*) FROM g2) AS n_worklist_ids_without_admission,
        (SELECT CASE WHEN count(*) = count(FROM_DATE) THEN min(FROM_DATE) END FROM gr) AS gap_first_service,
        (SELECT CASE WHEN count(*) = count(FROM_DATE) THEN max(FROM_DATE) END FROM gr) AS gap_last_service,
        (SELECT CASE WHEN count(*) = count(FROM_DATE) THEN min(FROM_DATE) END FROM svs) AS first_service,
        count(*) FILTER (WHERE medicaid_id IS NULL) AS n_null_admission_id,
        count(*) FILTER (WHERE agency_admission_date IS NULL) AS n_null_admission_date
      FROM open_date""",
    "set_overlap": _overlap_sql(),
    # single operators
    "normalize_id": "SELECT clm_id, MEDICAID_ID FROM svs",
    "pad_then_clean_id": "SELECT MEDICAID_ID, defer_date FROM sis_defer",
    "union_sources": "SELECT raw_id, defer_date FROM defer_raw",
    "mixed_dates": "SELECT clm_id, FROM_DATE AS from_date, THRU_DATE AS thru_date FROM svs",
    "excel_dates": "SELECT sis_id, sis_completed_dt FROM sis_all",
    "time_of_day": 'SELECT sis_id, start, "end", sis_cl_dob_dt, dateUpdated FROM sis',
    "minutes_between": "SELECT sis_id, duration FROM sis",
    "age_bands": f"""SELECT MEDICAID_ID, DATE_OF_BIRTH, CAST({AS_OF} - DATE_OF_BIRTH AS DOUBLE) / 365.25 AS age,
        CAST({AS_OF} - DATE_OF_BIRTH AS DOUBLE) / 365.25 >= 18 AS adult,
        CAST({AS_OF} - DATE_OF_BIRTH AS INTEGER) AS days_old,
        CAST(floor(CAST({AS_OF} - DATE_OF_BIRTH AS DOUBLE) / 365.242) AS BIGINT) AS age_floor FROM attrs""",
    "calendar_add": f"""SELECT o_orderkey, d, {add_months_sql('d', 9)} AS plus_9m, {add_months_sql('d', 12)} AS plus_1y,
        {add_months_sql('d', 36)} AS plus_3y, CAST(d + INTERVAL 9 MONTH AS DATE) AS plus_9m_clamp,
        d + 1095 AS plus_1095d
      FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "fiscal_year_end": """SELECT o_orderkey, make_date(CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS BIGINT), 9, 30) AS fy_end,
        make_date(CAST(year(d) + CASE WHEN month(d) >= 11 THEN 1 ELSE 0 END AS BIGINT), 9, 30) AS fy_end_nov
      FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "week_month_floor": """SELECT o_orderkey, CAST((dayofyear(d) - 1) // 7 + 1 AS INTEGER) AS week,
        CAST(year(d) AS INTEGER) AS year, CAST(d - CAST(dayofweek(d) AS INTEGER) AS DATE) AS week_start,
        CAST(date_trunc('month', d) AS DATE) AS month_start
      FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "null_tokens": """SELECT sis_id, CASE WHEN low AND o_orderstatus = 'F' THEN 'COMPLETED' WHEN low AND o_orderstatus = 'O' THEN 'IN PROGRESS' END AS statusText,
        CASE WHEN o_totalprice > 300000 THEN NULL ELSE 'Region' END AS sis_region FROM sis_all""",
    "recode": "SELECT clm_id, PROVIDER_NAME FROM svs",
    "yes_no_flags": "SELECT clm_id, HAB_WAIVER, HMP_ELIG, HMP_BUCKET FROM svs",
    "drop_all_null": f"""SELECT {_raw_id_text()} AS MEDICAID_ID, provider_raw AS PROVIDER_NAME,
        o_orderpriority AS CPT_CD, l_returnflag AS MEDICAID, CAST(l_suppkey AS VARCHAR) AS PRV_ID,
        CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS CLM_ID,
        {_raw_from_text('ship', 'l_linenumber')} AS FROM_DATE, strftime(ship, '%Y-%m-%d') AS THRU_DATE,
        {_yn("l_returnflag = 'R'")} AS HAB_WAIVER, {_yn("l_linestatus = 'O'")} AS HMP_ELIG,
        {_yn('l_discount >= 0.05')} AS HMP_BUCKET
      FROM svs_raw""",
    "unpivot_flags": "SELECT MEDICAID_ID, PROVIDER_NAME, agency_admission_date, most_recent_service, due_by_dt, "
                     "sis_completed_dt, field, val FROM w1",
    "pivot_counts": """SELECT PROVIDER_NAME,
        count(*) FILTER (WHERE n_priority = 1) AS n_rank_1, count(*) FILTER (WHERE n_priority = 2) AS n_rank_2,
        count(*) FILTER (WHERE n_priority = 3) AS n_rank_3, count(*) FILTER (WHERE n_priority = 4) AS n_rank_4,
        count(*) FILTER (WHERE n_priority = 5) AS n_rank_5, count(*) AS n_all
      FROM worklist GROUP BY PROVIDER_NAME""",
    "rollup_total": f"""WITH p AS (SELECT PROVIDER_NAME, count(*) AS n_claims,
          count(*) FILTER (WHERE CPT_CD IN ('1-URGENT', '2-HIGH')) AS n_eligible_claims, 0 AS is_total
        FROM svs GROUP BY PROVIDER_NAME)
      SELECT * FROM p UNION ALL
      SELECT {TOTAL}, CAST(sum(n_claims) AS BIGINT), CAST(sum(n_eligible_claims) AS BIGINT), 1 FROM p""",
    "distinct_with_null": """SELECT PROVIDER_NAME,
        count(DISTINCT MEDICAID_ID) + coalesce(max(CASE WHEN MEDICAID_ID IS NULL THEN 1 ELSE 0 END), 0) AS n_people
      FROM svs GROUP BY PROVIDER_NAME""",
    "null_counts": """SELECT PROVIDER_NAME, count(*) FILTER (WHERE MEDICAID_ID IS NULL) AS n_null_id, count(*) AS n_rows
      FROM svs GROUP BY PROVIDER_NAME""",
    "any_flag": """SELECT MEDICAID_ID, PROVIDER_NAME, due_by_dt, sis_overdue, sis_coming90, due_in_fy FROM roster
      WHERE sis_overdue OR sis_coming90 OR due_in_fy""",
    "id_subtract": "SELECT MEDICAID_ID FROM svs EXCEPT SELECT medicaid_id FROM open_date",
    "id_intersect": "SELECT MEDICAID_ID FROM worklist INTERSECT SELECT MEDICAID_ID FROM roster",
    "anti_join": """SELECT MEDICAID_ID, PROVIDER_NAME FROM elig_svs e
      WHERE NOT EXISTS (SELECT 1 FROM elig_qi q WHERE q.MEDICAID_ID = e.MEDICAID_ID)""",
    "semi_join": """SELECT clm_id, MEDICAID_ID, FROM_DATE FROM svs
      WHERE MEDICAID_ID IN (SELECT MEDICAID_ID FROM worklist EXCEPT SELECT medicaid_id FROM open_date)""",
    "latest_per_group": """SELECT o_orderkey, o_custkey, o_orderdate FROM orders
      QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)""",
    "top_priority_per_group": """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
      QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)""",
}


def _compose(body: str) -> str:
    """Append the query's own CTEs (if any) to the shared prelude."""
    body = body.strip()
    if body.startswith("WITH "):
        return PRELUDE.rstrip() + ",\n" + body[len("WITH "):]
    return PRELUDE + body


def oracle_sql() -> dict[str, str]:
    return {k: _compose(v) for k, v in FINAL.items()}
