"""Benchmark: run the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed fully with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelcast.queries import REGISTRY  # noqa: E402
from panelcast.session import build_session  # noqa: E402

HEADLINE = [
    "label_prevalence",     # flagship: panel -> history -> label -> development prevalence
    "scan_panel",           # partial aggregation scan of lineitem
    "rule_violations",      # one-pass quality audit
    "consecutive_history",  # gaps and islands
    "panel_features",       # one window pass: lags, rolling means, season
    "fold_audit",           # expanding folds without row copies
    "average_precision",    # bucketed score ladder
    "threshold_policies",   # four operating policies from one ladder
    "metrics_by_period",    # grouped ladder
    "latest_unlabeled",     # batch scoring
    "holdout_evaluation",   # load -> prepare -> forest fit on development -> holdout metrics
    "forest_scores",        # forest, 4 expanding folds fit + predict
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="panelcast-bench", shuffle_partitions=max(8, 2 * cpus),
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
