"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from quern.plans import catalog  # noqa: E402

HEADLINE = ["group_agg", "group_two_keys", "filter_project", "arithmetic", "running_foreach", "unique_by", "index_join", "inner_join", "in_semi", "top_k", "top_k_per_group", "json_props", "regex", "dates", "any_all", "global_agg", "min_max_by", "kernel_entries", "kernel_label"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = catalog.queries()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first warms up
            began = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total of the median times of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
