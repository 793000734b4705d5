"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON, and every query on stderr as it ends.

A query runs once to warm up and three times more; after $BENCH_SECONDS (1,200) those left run once.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tapeloom.plans import QUERIES

NAMES = ["redact_light", "redact_heavy", "redact_hits", "clean_standard", "clean_redact", "min_gap", "merge_segments", "assign_previous", "tail_steps", "log_tail"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    limit = float(os.environ.get("BENCH_SECONDS", "1200"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, began = {}, time.perf_counter()
    for name in NAMES:
        runs = []
        while len(runs) < (4 if time.perf_counter() - began < limit else 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:] or runs), 3)
        print(f"{name} {took[name]} s of {len(runs)} runs", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "seconds of the headline queries, median of 3 after a warm-up", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
