"""Time the headline queries at one scale and print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names, or "all" (default: the headline list)
BENCH_RUNS    timed runs after a first one that is not timed; the median counts (default 1)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

HEADLINE = [
    "object_activity", "nms_dedup", "build_graph", "object_timeline", "clip_windows_keep", "clip_timestamps", "clip_membership",
    "sample_frames", "temporal_deltas", "window_gather", "track_pairs", "separation_score", "align", "match_events",
    "validate_events", "encode_events", "attribute_profiles", "compact_docs", "roundtrip_check", "average_precision",
    "action_accuracy", "graph_f1", "detection_labels", "split_80_10_10", "global_index", "filtered_ranges", "quality_report",
    "slot_consistency", "spatial_entropy", "stratified_select", "mean_embedding", "motion_score",
]


def main() -> None:
    from clipgraph.plans import catalog
    from clipgraph.plans.registry import QUERIES, run
    from clipgraph.session import local_session

    catalog.load()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=16, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    run("object_activity", spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    rows: dict[str, int] = {}
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    for name in names:
        took = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            seen = Observation()
            run(name, spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            took.append(round(time.perf_counter() - start, 3))
            rows[name] = seen.get["n"]
        cold[name], times[name] = took[0], round(statistics.median(took[1:] or took), 3)
        print(name, times[name], rows[name], "rows", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": float(sf.group(1)) if sf else None, "timed_runs": runs, "first_run": cold, "rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
