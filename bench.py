"""Time the headline queries; prints one JSON line.

Each query runs twice into a sink that keeps nothing, and its time is that of
the second run, for all alike: the first compiles and warms up. BENCH_SF_DIR,
BENCH_CPUS, BENCH_RUNS (timed runs, of which the median counts) and
BENCH_QUERIES (comma separated) change the defaults.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from oddlines.plans import catalog
from oddlines.session import local_session

HEADLINE = """
read_log_lines strip_blank_lines global_sequence parse_logs parse_app_log mask_tokens prepare_text
mine_templates parse_summary
ngram_counts vocabulary tfidf_weights tfidf_transform
forest_nodes isolation_scores contamination_threshold anomaly_labels
detect_log_anomalies detect_per_source
precision_at_share score_histogram top_templates similarity_edges
event_status events_by_type avg_latency_ms hit_counter experiment_windows label_fault_windows
stream_append stream_event_counts stream_templates
""".split()

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    queries, times = catalog.queries(), {}
    for name in names:
        seconds = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(seconds[1:]), 3)
        print(f"{name:28s} {times[name]:8.3f}  {[round(s, 2) for s in seconds]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
                "cpus": cpus,
                "runs": runs,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
