"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Every query is run to the end with its whole result written to a sink that keeps nothing.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

# from row-local measures over the neighbour join to whole monitors
HEADLINE = [
    "m15_risk_curve",
    "a11_omission",
    "a02_interval_by_class",
    "a15_roc_curve",
    "w07_downsample",
    "u02_entropy",
    "u04_interval_supervised",
    "u08_combined",
    "u09_multi_combined",
    "u10_agreement",
    "u15_proximity",
    "j01_knn_join",
    "u11_neighbour_agreement",
    "u14_kth_distance",
    "c03_neighbour_vote",
    "d02_ecod",
    "d03_hbos",
    "d08_local_outlier_factor",
    "d12_isolation_forest",
    "m01_measure_set",
]


def main() -> None:
    from doubtline.queries import all_queries
    from doubtline.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
        plans = all_queries()
        # start the Python workers and load the classes once, outside the timing
        plans["u02_entropy"](spark, sf).limit(1).collect()
        plans["w02_kth_distance"](spark, os.path.join(os.path.dirname(sf), "sf0.001")).limit(1).collect()
        seconds = {}
        for name in names:
            start = time.time()
            plans[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
