"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs to completion through the ``noop`` sink (all rows are
computed, nothing is collected to the driver).  Queries are run in rounds, up to
three, while the time spent stays under BENCH_SECONDS (default 420); the report
has the median of a query's times and how many rounds there were.  ``control`` is
the median time of a fixed loop run before each round: it shows how fast the
machine was, so that two reports can be compared.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "roster", "worklist", "completion_summary", "monthly_completions", "fy_summary", "priority_crosstab",
    "reconcile_counts", "coverage_gap", "set_overlap", "services_clean", "assessments_clean", "deferral_status",
    "open_admissions", "services_via_files", "worklist_split_files", "fy_worklist_numbered", "summary_timeline",
    "quoted_records_via_files", "incremental_services",
]
ROUNDS = 3


def control() -> float:
    """Seconds of a fixed amount of work."""
    t0, x = time.perf_counter(), 1
    for k in range(3_000_000):
        x = (x * 1103515245 + k) & 0x7FFFFFFF
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from rosterkit.plans.queries import REGISTRY
    from rosterkit.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="rosterkit-bench")
    # JVM / code-generation warm-up on the smallest test data (not the measured data); not timed
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("roster", "assessments_clean"):
            REGISTRY[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    limit, began = float(os.environ.get("BENCH_SECONDS", "420")), time.perf_counter()
    times, controls = {name: [] for name in HEADLINE}, []
    for k in range(ROUNDS):
        spent = time.perf_counter() - began
        if k and spent + spent / k > limit:   # another round would not fit
            break
        controls.append(control())
        for name in HEADLINE:
            t0 = time.perf_counter()  # some queries write and read files while they are built
            df = REGISTRY[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - t0)
    rounds = len(controls)
    times = {name: round(median(t), 3) for name, t in times.items()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "rounds": rounds, "control": round(median(controls), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
