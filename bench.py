"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.queries import queries
from stockline.session import local_session

HEADLINE = [
    "catalog_view", "sales_trend_filled", "receipt_trend", "sales_by_product", "product_report_with_total",
    "report_row_number", "list_incoming", "lookup_code", "receipt_document", "cumulative_cart_check",
    "checkout_snapshot", "checkout_cumulative", "checkout_items", "sell", "stock_count", "upsert", "movement_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def seconds(name: str) -> float:
        begin = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds("sales_trend_filled")  # start-up of the session is not part of any query
    timings = {name: round(seconds(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
