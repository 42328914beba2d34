"""Times the headline queries, the median of some runs after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from reelspark.plans import catalogue

NAMES = ["curate_rank", "item_quality", "category_counts", "manifest", "nms_area", "box_iou", "no_face_streak", "scene_gram", "dedup_in_scene", "scene_cluster", "curate_select", "transfer_curves", "curate_flow", "dedup_global", "mmr_full", "nearest_face", "tone_map", "hit_rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in NAMES:
        times = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
