"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8): one warm-up pass over all queries, then per query
the median of ``$BENCH_REPEAT`` (default 3) timed runs, each result written to the
``noop`` sink.  A timed run includes building the plan (and any checkpoint it writes).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "municipality_comparison",
    "association_comparison",
    "top_performers",
    "season_summary",
    "municipality_totals",
    "report_page",
    "report_stats",
    "upload_classified",
    "farmer_search",
    "delete_municipality_cascade",
    "update_farmers",
    "template_export",
    "upload_commit",
    "association_farmer_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from ricefield.session import local_session
    from ricefield.plans.catalog import queries

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="ricefield-bench")
    qs = queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    times: dict[str, float] = {}
    for name in names:  # warm the JVM (JIT, class loading) on every query first
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        fn = qs[name]
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "repeat": repeat,
            }
        )
    )


if __name__ == "__main__":
    main()
