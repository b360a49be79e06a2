"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every output column is consumed by a ``noop`` sink (so the optimizer can
not prune windows or joins away), one warm-up run per query, then the
median of $BENCH_REPEATS timed runs.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerflow.plans.catalog import QUERIES  # noqa: E402
from ledgerflow.session import get_spark  # noqa: E402

HEADLINE = [
    "union_daily",             # W1: daily aggregation over both sources
    "union_fraud",             # W2: velocity + z-score fraud proxy
    "proxy_precision_recall",  # W2 scoring
    "union_enriched",          # W3: dimension enrichment + trailing window
    "enriched_pair_rolling",   # W3 pair-lookup variant
    "rolling_24_day",          # trailing window on the large source
    "amount_summary",          # exact quartiles
]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="ledgerflow-bench",
                      shuffle_partitions=2 * cpus,
                      extra={"spark.driver.memory": "16g"})
    times, errors = {}, {}
    for name in names:
        try:
            run_once(spark, name, sf_dir)  # warm-up
            times[name] = round(statistics.median(run_once(spark, name, sf_dir)
                                                  for _ in range(repeats)), 3)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the rest
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_median_sec",
           "value": round(sum(t for t in times.values() if t is not None), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None,
           "cpus": cpus, "repeats": repeats, "spark": spark.version}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
