"""Times the headline queries and prints one JSON line.

Every query runs once to warm up and three times for the clock; the median counts. Results go to the ``noop`` sink, so
all rows are computed and none is brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from skyloom.session import local_session

HEADLINE = [
    "pl_00_first_frame", "pl_01_build_model_frame", "pl_03_regional_frame", "ag_01_resample", "wn_01_lag_features", "wn_03_rolling_history",
    "wn_04_rolling_time", "wn_05_interpolate", "jn_02_station_pairs_km", "vo_01_build_vocab", "vo_02_encode", "vo_05_token_stream",
    "ev_02_class_metrics", "ev_06_threshold_grid", "ev_12_roc_auc", "sp_01_split_random", "wn_15_chunk", "ag_07_clean_precip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "skyloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    from skyloom.plans.catalog import QUERIES

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
