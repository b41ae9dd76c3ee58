"""Time the headline queries on one folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomgrid.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "hourly_grid",
    "gap_runs",
    "daylight_saving_align",
    "silver_merge",
    "coverage_table",
    "price_levels",
    "rolling_stats",
    "sample_index",
    "samples_long",
    "dataset_index",
    "naive168",
    "seasonal_ma",
    "ridge_lags",
    "eval_metrics",
    "eval_subsets",
    "holdout_zones",
    "select_nodes",
    "request_plan",
    "parse_bodies",
    "collection_events",
    "daily_score",
    "forecast_answers",
    "model_comparison",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    # start the JVM workers and the code cache before timing
    QUERIES["model_comparison"](spark, folder).count()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
