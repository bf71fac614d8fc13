"""Times the main queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one JSON line.

Each query runs once to warm up and then three times; the median counts. All rows and columns are computed (noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "requests_minute",
    "requests_hour",
    "requests_hour_openai",
    "tokens_hour",
    "provider_summary_hours",
    "requests_from_rollup",
    "finished_attempts",
    "in_flight",
    "request_stats_from_events",
    "provider_stats",
    "router_totals",
    "error_breakdown",
    "request_mix",
    "request_chains",
    "attempt_numbers",
    "cooldown_triggers",
    "cooldown_hits",
    "usage_from_json",
    "mapped_models",
    "sse_events",
    "merged_openai",
    "merged_anthropic",
    "merged_documents",
    "stats_from_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from gatelens.plans.queries import QUERIES
    from gatelens.session import get_spark

    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        measured = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured[1:] or measured), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_median_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
