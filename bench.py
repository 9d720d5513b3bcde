"""Times the headline queries; prints one JSON line."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from rill.plans import registry

HEADLINE = ["eval_row_wise", "calc_grouped_max", "calc_by_flags", "calc_percentiles", "select_range", "join_equal", "join_radius", "time_join_lower", "time_join_nearest", "interval_join", "interval_split", "update_running", "sort_first", "blocks_by_change", "blocks_by_span", "shape_sliding_window", "text_lineitem", "binary_round_trip", "binary_doubles", "time_join_upper", "interval_pieces", "eval_running", "update_running_erase"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times), 3)
    print(json.dumps({"metric": "headline queries, median of 3, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
