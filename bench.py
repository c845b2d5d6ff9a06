"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from checks import views
from checks.catalog import QUERIES

HEADLINE = (
    "build_checks",
    "reconcile_flat_lines",
    "lines_fingerprint",
    "fingerprint_flat_lines",
    "extract_lines",
    "assemble_document",
    "deidentify",
    "verify_documents",
    "currency_codes",
    "find_customer_rows",
    "find_customer_rows_many_targets",
    "deny_list",
    "redact_tokens",
    "redact_overlapping_words",
    "redact_overlapping_words_by_join",
    "redact_scoped_tokens",
    "scrub_documents",
    "scrub_pages",
    "scrub_logs",
    "leak_audit",
    "surrogate",
    "join_on_surrogate",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyveil-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        # One machine with small files: keep every core busy, though partitions are small in bytes.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds = {}
    start = time.perf_counter()
    for make in (views.parsed_moves, views.capture, views.pages):
        make(spark, sf_dir)
    seconds["prepare_stored_inputs"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
