"""Times of the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads."""

from __future__ import annotations

import json
import os
import time

QUERIES = [
    "food_score", "balanced_score", "nearby_facts_top12", "band_join_points", "band_join_polygons", "quietness_score", "dedupe_components", "comparable_peers", "gamma_rank", "city_baseline", "cohort_select", "present_name",
    "up_down_windows", "events_session",
]


def main() -> None:
    from environs.plans import QUERIES as known
    from environs.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    known["city_baseline"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the workers
    took = {}
    for name in QUERIES:
        began = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()  # every row and column is computed
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
