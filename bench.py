"""Headline queries, timed warm. Prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from registry.queries import QUERIES
from skewlens.session import SETTINGS, STATIC_SETTINGS

HEADLINE = [
    "nation_representation_test", "notice_payloads", "birth_places", "notice_text_rules", "document_text_rules",
    "document_topics", "engineered_notices", "family_proportions", "case_cube", "year_by_family", "region_by_family",
    "distinct_customers", "geographic_test", "category_test", "family_trends", "customer_trends", "case_persistence",
    "case_persistence_test", "delay_by_part_type", "delay_anova", "price_quantiles", "weapon_comparison",
    "weapon_summary", "chart_persistence_box", "latest_notices", "distinct_documents", "document_quality", "validation",
    "audit_results", "stored_notices", "csv_round_trip", "audit_results_of_batches", "charts_from_one_pass",
    "customers_from_sketches",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in (SETTINGS | STATIC_SETTINGS).items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i:  # the first run compiles and is not counted
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
