"""Headline-query timing: prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Each query is run to completion with a full-result action (count of the whole output after a
cheap aggregate over every column), once warm-up and then timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

HEADLINE = [
    "E09_feature_frame_hourly",
    "E09_feature_frame_daily",
    "G36_notebook_features_daily",
    "B13_clean_dirty_ticker",
    "D20_iqr_outliers",
    "D06_describe",
    "J05_sequence_dataset_train",
    "L12_L14_validation_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from barspark.plans import registry
    from barspark.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2, app="barspark-bench")
    qs = registry.queries()
    names = [n for n in (os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE)
             if n in qs]

    def run(name):
        df = qs[name](spark, sf_dir)
        # Touch every column so nothing is pruned away: hash all values into one number.
        return df.select(F.sum(F.hash(*df.columns).cast("long"))).collect()[0][0], df

    times = {}
    for name in names:
        run(name)  # warm-up (JIT, Python workers, file listing)
        t0 = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - t0, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
