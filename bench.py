"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

All queries run once to warm up, then each three times; the median counts. Results
go to a no-op sink, so the whole result is computed but not collected. Streams, compaction
and snapshots write their tables anew each time; that is part of what is timed.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from cartlake.registry import QUERIES
from cartlake.session import build_session, remove_run_dirs

HEADLINE = [
    "q01_top_seller_per_country", "q02_customer_demographics", "q03_sales_by_category",
    "q04_customer_segments", "q05_customers_since", "q06_top_products", "q07_monthly_sales",
    "q08_monthly_retention", "q09_revenue_by_category", "q10_top_countries", "q11_customers_of_country",
    "buyers_of_large_orders", "account_alerts", "error_alerts", "metric_rollup", "request_counts", "integrity_report",
    "account_alerts_stream", "error_alerts_stream", "metric_rollup_stream", "request_counts_stream",
    "compacted_order_items", "evolved_slices_compacted", "snapshot_manifest", "export_and_read_texts",
]


def run_once(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("cartlake-bench", f"local[{cpus}]", shuffle_partitions=cpus, **{
        "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="cartlake-bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run_once(QUERIES[name], spark, folder)
    for name in HEADLINE:
        seconds[name] = round(statistics.median(run_once(QUERIES[name], spark, folder) for _ in range(3)), 3)
    remove_run_dirs(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
