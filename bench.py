"""Times the headline queries and prints one JSON line; each is run once to warm up, then timed."""

from __future__ import annotations

import json
import os
import sys
import time

from gridloom.plans.registry import QUERIES
from gridloom.session import session

HEADLINE = [
    "window_query", "point_lookup", "multi_window", "page_stats", "height_metrics", "gradient_slope", "smooth_decimate", "seam_certificate",
    "d8_receivers", "flow_accumulation", "stream_overlap", "bilinear_sample", "paired_log_ratio", "sensitivity_cube", "pareto_front", "state_as_of",
    "session_counts", "codec_tournament", "multilevel_bytes", "route",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    more = {"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus}
    spark = session("bench", f"local[{cpus}]", **more)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        for k in range(2):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                took[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
