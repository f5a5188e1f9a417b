"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the benchmark tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  "all", or a comma-separated list; default is HEADLINE
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from grainwise.session import local_session  # noqa: E402
from registered_queries import queries  # noqa: E402

HEADLINE = (
    "fct_order",
    "fct_order_item",
    "items_by_order",
    "payments_by_parent",
    "keep_latest",
    "monthly_sales",
    "category_performance",
    "state_performance",
    "delivery_vs_review",
    "review_by_lateness",
    "headline_from_raw",
    "metrics_total",
    "metrics_by_state",
    "metrics_by_month",
    "item_metrics_by_category",
    "metrics_rollup",
    "revenue_mom",
    "revenue_ytd",
    "cumulative_share",
    "category_lateness_split",
    "state_drivers",
    "median_delivery",
    "payment_mix",
    "repeat_rate",
    "reconciliation",
    "fanout_report",
    "compare_headline",
    "constraint_report",
)


def run(df) -> None:
    """Execute in full without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registered = queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(registered) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="grainwise-bench")
    run(registered["state_performance"](spark, sf_dir))  # start the JVM and fill its code cache
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(registered[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
