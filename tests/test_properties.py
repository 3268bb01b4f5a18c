"""Property test: normalize_id against a plain-Python model of the original id rules."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterkit import functions as rf

WS = "\t\n\u000b\u000c\r \u0085             " \
     "    　"


def model(x):
    """trim; drop letters and punctuation; blank -> None; keep last 10; shorter -> integer, zero-padded."""
    if x is None:
        return None
    x = x.strip(WS)
    x = "".join(ch for ch in x if not (ch.isalpha() or unicodedata.category(ch).startswith("P")))
    if x == "":
        return None
    x = x[-10:]
    if len(x) < 10:
        m = re.fullmatch(r"[ \t\n\x0b\x0c\r]*\+?([0-9]{1,9})[ \t\n\x0b\x0c\r]*", x)
        if not m:
            return None
        x = m.group(1).rjust(10, "0")
    return None if x == "0000000000" else x


ALPHABET = "0123456789" * 4 + "abcXYZ-./()_#' +$\t" + "ÄéΩ·¢"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=16), min_size=1, max_size=60))
def test_normalize_id_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string").select("x", rf.normalize_id("x").alias("y"))
    got = {r.x: r.y for r in df.collect()}
    assert got == {v: model(v) for v in values}


def date_model(x):
    import datetime as dt
    if x is None:
        return None
    x = x.strip(WS)
    m = re.fullmatch(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})", x)
    if m:
        mo, d, y = int(m.group(1)), int(m.group(2)), m.group(3)
        yr = int(y) if len(y) == 4 else (1900 if int(y) >= 69 else 2000) + int(y)
    else:
        m = re.fullmatch(r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", x)
        if not m:
            return None
        yr, mo, d = int(m.group(1)), int(m.group(2)), int(m.group(3))
    try:
        return dt.date(yr, mo, d)
    except ValueError:
        return None


def _date_text():
    num = st.integers(min_value=0, max_value=40).map(str)
    year = st.sampled_from(["1999", "2017", "2020", "17", "68", "69", "99", "00"])
    mdy = st.tuples(num, num, year).map(lambda t: f"{t[0]}/{t[1]}/{t[2]}")
    ymd = st.tuples(st.sampled_from(["1999", "2016", "2020"]), num, num).map(lambda t: f"{t[0]}-{t[1]}-{t[2]}")
    junk = st.text(alphabet="0123456789/- x", max_size=10)
    return st.one_of(mdy, ymd, junk, mdy.map(lambda s: f" {s} "))


@settings(max_examples=30, deadline=None)
@given(st.lists(_date_text(), min_size=1, max_size=60))
def test_mixed_date_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string").select("x", rf.parse_mixed_date("x").alias("d"))
    got = {r.x: r.d for r in df.collect()}
    assert got == {v: date_model(v) for v in values}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sets(st.integers(min_value=0, max_value=30), max_size=20), min_size=1, max_size=4))
def test_set_overlap_matches_brute_force(spark, sets):
    from itertools import combinations

    from rosterkit.operators.overlap import set_overlap
    frames = [(f"s{i}", spark.createDataFrame([(str(v),) for v in s] or [], "id string"), "id")
              for i, s in enumerate(sets)]
    got = {tuple(r.sets): r.size for r in set_overlap(spark, frames).collect()}
    want = {}
    for k in range(1, len(sets) + 1):
        for combo in combinations(range(len(sets)), k):
            want[combo] = len(set.intersection(*[set(sets[i]) for i in combo]))
    assert got == want


_STATUS = [  # (field, value, status) in the original's order; None = dropped
    ("sis_complete_any", False, "Initial SIS Needed"), ("sis_complete_inel", True, None),
    ("sis_overdue", True, "Reassessment Overdue"), ("sis_coming90", True, "Reassessment Due in 90 Days"),
    ("due_in_fy", True, "Other upcoming in current FY"), ("deferral_active", True, None),
    ("deferral_active", False, "Expired Deferral")]
_RANK = {"Initial SIS Needed": 1, "Reassessment Overdue": 2, "Reassessment Due in 90 Days": 3,
         "Other upcoming in current FY": 4, "Expired Deferral": 5}
_FLAGS = ["sis_complete_any", "sis_complete_inel", "sis_overdue", "sis_coming90", "due_in_fy", "deferral_active"]


def worklist_model(rows):
    long = []
    for r in rows:
        if r["PROVIDER_NAME"] is None:
            continue
        for f in _FLAGS:  # unpivot: one (field, val) per flag, NULLs kept
            st_ = next((s for fld, v, s in _STATUS if fld == f and r[f] is v), None)
            if st_ is not None:
                long.append((r["MEDICAID_ID"], r["PROVIDER_NAME"], _RANK[st_]))
    best = {}
    for pid, _, rank in long:
        best[pid] = min(best.get(pid, 9), rank)
    return sorted((pid, prov, rank) for pid, prov, rank in long if rank == best[pid])


_tri = st.sampled_from([True, False, None])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p1", "p2", "p3"]), st.sampled_from(["A", "B", None]),
                          _tri, _tri, _tri, _tri, _tri, _tri), min_size=1, max_size=25))
def test_worklist_matches_unpivot_model(spark, rows):
    from rosterkit.operators.worklist import worklist
    cols = ["MEDICAID_ID", "PROVIDER_NAME", *_FLAGS]
    dicts = [dict(zip(cols, r)) for r in rows]
    df = spark.createDataFrame(rows, "MEDICAID_ID string, PROVIDER_NAME string, " +
                               ", ".join(f"{f} boolean" for f in _FLAGS))
    for c in ("agency_admission_date", "most_recent_service", "due_by_dt", "sis_completed_dt"):
        df = df.withColumn(c, F.lit(None).cast("date"))
    got = sorted((r.MEDICAID_ID, r.PROVIDER_NAME, r.n_priority) for r in worklist(df).collect())
    assert got == worklist_model(dicts)
