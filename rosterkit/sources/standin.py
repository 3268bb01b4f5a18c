"""Stand-in extracts built from the driver's TPC-H-like tables.

The original inputs (claims, quality-indicator file, assessment sheet,
deferral workbooks, admission reports) are private.  These adapters derive
raw extracts of the same shape from the test tables, dirty ids and text
dates included, so that the cleaning operators run on every row.  Nothing is
sampled or filtered: each adapter turns every row of its table into a row.

Person key: ``k + 1`` for customer ``k`` (user ``u`` is customer ``10 u``);
the clean id is that number zero-padded to 10 digits.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig

# Fixed values of the stand-in run (dates chosen inside the test data's span).
STANDIN_AS_OF = dt.date(1999, 6, 30)
STANDIN_DUE_FLOOR = dt.date(1999, 1, 1)
STANDIN_FY_CUTOFF = dt.date(1998, 9, 30)
STANDIN_CLOCK_CHANGE = dt.date(1998, 1, 1)
STANDIN_PROCEDURE_CODES = ("1-URGENT", "2-HIGH")
STANDIN_PAYER_CODES = ("A",)
# Four of the five raw provider labels are recoded; one is left as it is.
STANDIN_PROVIDER_RECODE = {
    "1-AMERICA": "AMERICA",
    "2-ASIA": "ASIA",
    "3-EUROPE": "EUROPE",
    "4-MIDDLE EAST": "MIDDLE EAST",
}
# Deferral dates count back from as_of by the event's hour within its month.
EVENT_EPOCH_SECONDS = 1704067200  # 2024-01-01T00:00:00Z
EVENT_EPOCH_DATE = dt.date(2024, 1, 1)


def standin_config() -> RunConfig:
    return RunConfig(
        as_of=STANDIN_AS_OF,
        procedure_codes=STANDIN_PROCEDURE_CODES,
        payer_codes=STANDIN_PAYER_CODES,
        provider_recode=dict(STANDIN_PROVIDER_RECODE),
        due_floor=STANDIN_DUE_FLOOR,
        fy_cutoff=STANDIN_FY_CUTOFF,
        clock_format_change=STANDIN_CLOCK_CHANGE,
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(k) -> Column:
    """Person number as text (customer key + 1)."""
    return (k + F.lit(1)).cast("string")


def raw_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim lines: every lineitem with its order's customer and its supplier's region."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_discount")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    x = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(n, s.s_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    k = _key(F.col("o_custkey"))
    ln = F.col("l_linenumber")
    raw_id = (F.when(ln == 1, F.concat(F.lit(" MI"), k, F.lit(" ")))
              .when(ln == 2, F.concat(F.lit("ID-"), k))
              .when(ln == 3, F.concat(F.lit("99"), F.lpad(k, 10, "0")))
              .when(ln == 7, F.lit("N/A"))
              .otherwise(F.lpad(k, 10, "0")))
    ship = F.col("l_shipdate").cast("date")
    iso = ship.cast("string")  # yyyy-MM-dd
    mon, day = F.month(ship).cast("string"), F.dayofmonth(ship).cast("string")
    from_text = (F.when(ln == 4, F.concat_ws("/", F.lpad(mon, 2, "0"), F.lpad(day, 2, "0"), F.substring(iso, 3, 2)))
                 .when(ln.isin(1, 3, 5), F.concat_ws("/", mon, day, F.substring(iso, 1, 4)))
                 .otherwise(iso))
    yn = lambda c: F.when(c, F.lit("Y")).otherwise(F.lit("N"))
    return x.select(
        raw_id.alias("MEDICAID ID"),
        F.concat_ws("-", F.col("r_regionkey").cast("string"), F.col("r_name")).alias("PROVIDER NAME"),
        F.col("o_orderpriority").alias("CPT CD"),
        F.col("l_returnflag").alias("MEDICAID"),
        F.col("l_suppkey").cast("string").alias("PRV ID"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), ln.cast("string")).alias("CLM ID"),
        from_text.alias("FROM DATE"),
        iso.alias("THRU DATE"),
        yn(F.col("l_returnflag") == "R").alias("HAB WAIVER"),
        yn(F.col("l_linestatus") == "O").alias("HMP ELIG"),
        yn(F.col("l_discount") >= 0.05).alias("HMP BUCKET"),
        F.lit(None).cast("string").alias("NOTE:"),
    )


def provider_labels(spark: SparkSession, sf_dir: str, recode_map=STANDIN_PROVIDER_RECODE) -> list[str]:
    """Clean provider labels of the provider dimension (the region table), in key order.

    A dimension of a handful of rows: collecting it gives the column header
    of the provider cross-tab without a pass over the facts.
    """
    from ..operators.schema import recode
    r = table(spark, sf_dir, "region")
    lab = recode(F.concat_ws("-", F.col("r_regionkey").cast("string"), F.col("r_name")), recode_map)
    return [row[0] for row in r.orderBy("r_regionkey").select(lab).collect()]


def raw_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality-indicator file: one row per customer."""
    c = table(spark, sf_dir, "customer")
    k = _key(F.col("c_custkey"))
    seg = F.col("c_mktsegment")
    bal = F.col("c_acctbal")
    return c.select(
        F.when(F.col("c_nationkey") < 5, F.concat(F.lit("MI-"), k)).otherwise(k).alias("MEDICAID RECIP ID"),
        (F.when(seg == "BUILDING", F.lit("2")).when(seg == "MACHINERY", F.lit(None))
         .when(seg == "HOUSEHOLD", F.lit("3")).otherwise(F.lit("1"))).alias("DISABILITY/DD"),
        F.when(bal > 2000, F.lit(1)).alias("MOBILITY"),
        F.when(bal < 0, F.lit(1)).alias("PERSONAL"),
        F.when(F.col("c_nationkey") < 10, F.lit(1)).alias("SUPPORT SYSTEM"),
        F.date_format(F.date_add(F.lit(dt.date(1975, 1, 1)), F.floor(bal).cast("int")), "yyyy-MM-dd").alias("DATE OF BIRTH"),
        F.when(bal < 1000, F.lit("Y")).otherwise(F.lit("N")).alias("MAJOR MENTAL ILLNESS"),
    )


def raw_assessments(spark: SparkSession, sf_dir: str, clock_change=STANDIN_CLOCK_CHANGE) -> DataFrame:
    """Assessment sheet: every order; those of the lowest priority with order status F are completed."""
    o = table(spark, sf_dir, "orders")
    low = F.col("o_orderpriority") == "5-LOW"
    k = _key(F.col("o_custkey"))
    day = F.col("o_orderdate").cast("date")
    price = F.col("o_totalprice")
    serial = F.datediff(day, F.lit(dt.date(1899, 12, 30))).cast("string")
    start_ts = F.col("o_orderdate") + F.expr("INTERVAL 9 HOURS")
    end_ts = F.timestamp_add("MINUTE", F.floor(price / 5000).cast("int"), start_ts)
    new_era = day >= F.lit(clock_change)
    clock = lambda ts: F.when(new_era, F.date_format(ts, "h:mma")).otherwise(F.date_format(ts, "h:mm:ssa"))
    dob = F.date_sub(day, (F.lit(9000) + F.floor(price / 100)).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("Assessment ID"),
        F.when(price > 100000, F.concat(F.lit(" "), k, F.lit("A"))).otherwise(F.lpad(k, 10, "0")).alias("sis_track_num"),
        (F.when(low & (F.col("o_orderstatus") == "F"), F.lit("COMPLETED"))
         .when(low & (F.col("o_orderstatus") == "O"), F.lit("IN PROGRESS"))
         .otherwise(F.lit("Choose one"))).alias("statusText"),
        F.concat(serial, F.when(price > 150000, F.lit(" 12:00:00")).otherwise(F.lit(""))).alias("sis_completed_dt"),
        clock(start_ts).alias("sis_startTime"),
        clock(end_ts).alias("sis_endTime"),
        F.when(price > 250000, F.date_format(dob, "M/d/yyyy"))
         .otherwise(F.concat(F.date_format(dob, "M/d/yyyy"), F.lit(" 0:00:00"))).alias("sis_cl_dob_dt"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY 8 HOURS 30 MINUTES"), "M/d/yyyy H:mm:ss").alias("statusChangeDate"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS"), "M/d/yyyy H:mm:ss").alias("dateUpdated"),
        F.date_format(F.date_add(day, 30), "M/d/yyyy").alias("isp_begin_date"),
        F.when(price > 300000, F.lit("Enterprise Wide")).otherwise(F.lit("Region")).alias("sis_region"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("interviewer_notes"),
    )


def raw_deferral_sources(spark: SparkSession, sf_dir: str, as_of=STANDIN_AS_OF) -> list[tuple[DataFrame, str, str, str]]:
    """Deferral workbooks: every event, split by day of month into three sheets.

    Returns ``(df, key_column, date_column, date_kind)`` for ``union_sources``.
    Sheet A carries datetimes, sheets B and C spreadsheet serial numbers;
    sheet C names its key ``Medicaid ID #``.
    """
    e = table(spark, sf_dir, "events")
    key = (F.col("user_id") * 10 + 1).cast("string")
    # whole hours since the epoch, on the wall clock (independent of the session zone)
    ts = F.col("ts").cast("timestamp_ntz")
    back = (F.datediff(ts.cast("date"), F.lit(EVENT_EPOCH_DATE)) * 24 + F.hour(ts)).cast("int")
    defer_day = F.date_sub(F.lit(as_of), back)
    serial = F.datediff(defer_day, F.lit(dt.date(1899, 12, 30))).cast("double")
    dom = F.dayofmonth("ts")
    a = e.where(dom <= 10).select(key.alias("Medicaid ID"),
                                  (defer_day.cast("timestamp") + F.expr("INTERVAL 10 HOURS")).alias("Referral Date"))
    b = e.where((dom > 10) & (dom <= 20)).select(key.alias("Medicaid ID"), serial.alias("Referral Date"))
    c = e.where(dom > 20).select(key.alias("Medicaid ID #"), serial.alias("Referral Date"))
    return [(a, "Medicaid ID", "Referral Date", "datetime"),
            (b, "Medicaid ID", "Referral Date", "serial"),
            (c, "Medicaid ID #", "Referral Date", "serial")]


def raw_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission reports: every event is a line of a case, one case per person; people of other numbers have none."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") * 10 + F.col("event_id") % 5
    # whole hours since the epoch, on the wall clock, count back from the run date two days each
    ts = F.col("ts").cast("timestamp_ntz")
    back = (F.datediff(ts.cast("date"), F.lit(EVENT_EPOCH_DATE)) * 24 + F.hour(ts)).cast("int")
    day = F.date_sub(F.lit(STANDIN_AS_OF), back * 2)
    return e.select(
        k.cast("string").alias("case number"),
        F.lpad(_key(k), 10, "0").alias("medicaid id"),
        F.date_format(day, "yyyy-MM-dd").alias("service start date"),
        F.date_format(day, "M/d/yyyy").alias("agency admission date"),
        F.lit(None).cast("string").alias("X_1"),
    )
