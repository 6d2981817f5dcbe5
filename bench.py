"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crivo.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "fill_scan_lineitem", "fill_scan_documents", "fill_scan_dev2", "cardinality_exact", "cardinality_approx",
    "domain", "numeric_profile", "totals", "string_date_profile", "code_format", "grain", "duplicate_summary",
    "duplicate_rows", "varying_columns", "pure_vs_version", "row_checksum", "series_continuity", "date_order",
    "equation_check", "header_replication", "list_coverage", "presence_matrix", "attribute_agreement",
    "reconcile_keys", "reconcile_columns", "summary",
)


def run(df) -> None:
    """Materialises every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))  # JVM and reader warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline profile queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
