"""Benchmark the headline queries.

Runs each query once to warm up and then ``BENCH_RUNS`` times (default 3),
forcing full evaluation with a no-op write, and prints ONE JSON line:

    {"metric": "median_query_sec_total", "value": N, "unit": "sec",
     "queries": {...}, "rows": {...}, "rows_per_sec": {...}, "sf": ...}

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_QUERIES (comma list, default the headline set).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "feature_table",  # join, calendar, shares, lags, null drop, 720-row means
    "energy_outer",  # A1 + J2: parse, widen, outer combine
    "rolling_30d",  # W4
    "corr_matrix",  # A3
    "error_metrics",  # A5
    "sequence_24",  # split, scale, 24-row sequences
    "region_site",  # F1
    "weather_read",  # F3
    "energy_pages",  # S1 + F2: pages of the wire to hours
    "expanding_folds",  # W6
    "best_params",  # A8
    "region_results",  # A9
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from hourgrid.plans.catalog import QUERIES
    from hourgrid.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus, driver_memory="8g")
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        fn = QUERIES[name]
        spark.sparkContext.setJobGroup(name, name)
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = fn(spark, sf_dir).count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    out = {
        "metric": "median_query_sec_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "rows_per_sec": {k: round(rows[k] / v, 1) if v else None for k, v in times.items()},
        "sf": sf,
        "cpus": cpus,
        "runs": runs,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
