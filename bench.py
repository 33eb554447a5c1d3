"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.queries import QUERIES
from tidemark.session import local_session

HEADLINE = (
    "ts_sessionize", "ts_gap_split_hours", "ts_state_periods", "ts_hourly_rollup", "ts_baseline", "ts_change_timeline", "ts_security_events", "win_sliding_median_mad",
    "win_max_in_span", "join_interval_overlap", "join_asof_backward", "upsert_fuller_wins", "update_if_changed", "agg_mad_robust_sd", "agg_grouping_sets", "page_keyset",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
