"""Benchmark the headline reports.

Runs each headline query once to warm up, then ``BENCH_REPEATS`` timed runs
(median reported), writing to Spark's ``noop`` sink so the whole plan
executes without collecting rows. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_REPEATS (default 3), BENCH_QUERIES (comma list, default
the headline set below).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mercata.plans.registry import QUERIES  # noqa: E402
from mercata.session import build_session  # noqa: E402

HEADLINE = [
    "gross_profit",
    "daily_core_metrics",
    "new_vs_old_revenue",
    "product_revenue_share",
    "user_lifecycle",
    "daily_cohort_retention",
    "cohort_retention_rate",
    "rfm_segment_label",
    "ab_effect_size",
    "ab_exposure_balance",
    "dau_wau_mau",
    "duplicate_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = build_session(
        f"local[{cpus}]",
        app_name="mercata-bench",
        shuffle_partitions=max(2 * cpus, 8),
        extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")},
    )
    timings: dict[str, float] = {}
    for name in names:
        build = QUERIES[name]
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_reports_total_median",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else None,
                "cpus": cpus,
                "repeats": repeats,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
