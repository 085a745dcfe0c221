"""Time the headline queries: one JSON line, median of the warm runs (BENCH_RUNS, default 3) each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeaudit.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "secrets_keyword", "secrets_all", "rules_sast", "rules_gdpr", "rules_injection",
    "insecure_urls", "imports_py", "functions_all", "hallucinated_imports", "deps_parsed",
    "deps_missing", "deps_stale", "deps_advisories", "deps_health", "cost_models",
    "cost_repeat_calls", "profile_text", "score_groups", "findings_digest", "token_budget",
    "ingest_npm", "scorecard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("codeaudit-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             # small inputs over all cores, as a cluster's files would be
             .config("spark.sql.files.maxPartitionBytes", "2m")
             .config("spark.sql.files.openCostInBytes", "64k")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
