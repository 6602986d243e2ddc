"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (folder of tables), BENCH_CPUS (threads), BENCH_RUNS
(timed runs after one warm-up; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from pagesieve.plans.registry import QUERIES

HEADLINE = [
    "endpoints_all", "js_items_all", "js_dedup", "vuln_findings", "comments_html", "html_internal_links",
    "url_summary", "url_categories", "response_diff", "link_reach", "audit_all",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").config("pagesieve.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {taken}", file=sys.stderr, flush=True)
    digits = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    sf = float(digits) if digits.replace(".", "", 1).isdigit() else None
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf, "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
