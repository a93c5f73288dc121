"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. Each query is run to its last
row into a sink that keeps nothing; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airspan.catalog import QUERIES  # noqa: E402
from airspan.session import build_session  # noqa: E402

HEADLINE = [
    "agg_hourly_avg", "agg_daily_avg", "agg_daily_median", "heatmap", "latest_per_station", "latest_page",
    "measurements_by_names", "export_rows", "clean_readings", "dedup_keep_last", "new_rows_anti",
    "upsert_measurements", "load_measurements", "page_parse", "alert_evaluate", "impute_median",
    "lags_next_hour", "split_sequential", "metrics_eval", "train_next_gbr_estandar",
    "train_multi_rf_regularizado",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("airspan-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 if name.startswith("train") else 2):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begun)
        seconds[name] = round(min(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
