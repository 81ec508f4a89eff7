"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docledger.queries import QUERIES  # noqa: E402
from docledger.session import build_session  # noqa: E402

HEADLINE = [
    "finalize_documents", "finalize_gate_pass", "finalize_shipping", "auto_fix_notes",
    "confidence_scores", "readiness", "validate_order", "validate_shipping", "validate_gate_pass",
    "order_crosscheck", "register_orders", "register_join", "export_items", "normalize_dates",
    "coerce_numbers", "classify_keywords", "classify_all", "dup_first_seen", "dup_check",
    "cache_split", "usage_breakdowns", "usage_totals", "kpi_dashboard", "flatten_json",
    "parse_responses", "audit_diff", "locate_terms", "text_layer", "boxes_normalized",
    "catalog_defaults",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the executors
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
