"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8). Each query
runs once to warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame

from tallyforge import queries
from tallyforge.session import SETTINGS

HEADLINE = (
    "pooled_ratio", "join_audit_direct", "unmatched", "aggregate_then_join", "object_left_join", "agg_methods", "dedupe_keys",
    "additivity", "distribution_report", "iqr_outliers", "head_concentration", "wilson", "cohort_rate", "cohort_curve",
    "events_cohort", "profile_money", "profile_id", "profile_time", "candidate_keys", "full_row_dups",
)


def seconds(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds(queries.QUERIES[name](spark, sf_dir))
        took[name] = round(statistics.median(seconds(queries.QUERIES[name](spark, sf_dir)) for _ in range(3)), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
