"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the input folder, BENCH_CPUS (default 8) the cores. Each
query runs twice, writing every output row to the ``noop`` sink; the faster run counts.
"""

from __future__ import annotations

import json
import os
import time

from tidewagon.plans.queries import named_queries
from tidewagon.session import local_session

HEADLINE = [
    "status_event_counts", "current_status_counts", "customer_shipment_stats", "customer_order_stats",
    "late_shipments", "late_shipments_open", "vehicle_state", "order_state", "order_sla_tracking",
    "hourly_delivery_performance", "warehouse_metrics", "last_windows_hourly", "fleet_utilization",
    "dashboard_summary", "customer_overview", "customer_sla_compliance", "enriched_vehicle_state",
    "warehouse_operational_status", "order_details", "order_rollup", "lifecycle_violations",
    "reference_violations", "ref_products_search", "stream_order_state", "stream_customer_order_stats",
    "stream_hourly_performance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="bench")
    queries = named_queries()
    spark.read.parquet(f"{folder}/events.parquet").write.format("noop").mode("overwrite").save()

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {name: round(min(once(name), once(name)), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": int(cores) if cores.isdigit() else cores}))


if __name__ == "__main__":
    main()
