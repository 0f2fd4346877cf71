"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query
runs once, start to finish, into the no-op sink; BENCH_QUERIES (comma-separated) narrows the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from shelfcast.contract.queries import QUERIES
from shelfcast.session import build_session

HEADLINE = [
    "clean_transactions",
    "gold_daily_sales",
    "strict_daily_sales",
    "sku_profile_asof_part",
    "select_active_recent",
    "top_volume_skus",
    "rolling_features",
    "training_frame",
    "inference_frame",
    "hybrid_forecast_part",
    "baseline_sparse",
    "rmsse_denominator",
    "wrmsse_total",
    "baseline_cv_part",
    "metrics_by_horizon",
    "end_of_selling_zero",
    "key_sku_adjust",
    "forecast_wide",
    "direct_dataset",
    "alpha_grid",
    "top_skus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
