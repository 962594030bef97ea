"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
number of local cores.  Every query runs once to warm up (file copies are made
then) and is timed on its next runs; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "infer_lineitem_types", "infer_orders_types", "infer_documents_types", "csv_profile_lineitem",
    "inf_json_families", "json_key_profile", "js_schemaless", "js_shred_typed", "js_modify", "scan_ndjson",
    "scan_text", "dlm_logical_rows", "scan_parquet_footer", "delta_active_files", "delta_row_count",
    "iceberg_latest", "scan_table_roots", "tx_redact", "tx_redact_full", "tx_secret_findings", "html_links",
    "html_candidates", "url_parts", "val_nulls", "val_exact_rows", "val_checksum", "val_manifest",
    "ld_stage_then_type", "ld_bulk_load", "js_ndjson_wrap",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from strandline import build_session
    from strandline.catalog import QUERIES
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        # the tables are single small files: cut them so that every core has a part
        "spark.sql.files.maxPartitionBytes": str(4 * 1024 * 1024), "spark.sql.files.openCostInBytes": "262144"})
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if len(sys.argv) < 2 or any(n.startswith(a) for a in sys.argv[1:])]
    times: dict[str, float] = {}
    for name in names:
        best = None
        for run in range(3):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            if run and (best is None or took < best):
                best = took
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    mb_per_s = {}
    if "csv_profile_lineitem" in times:
        from strandline.catalog.scanning import csv_copy
        folder = csv_copy(spark, sf, "lineitem")
        from strandline.sources.inventory import inventory
        size = inventory(spark, folder).selectExpr("sum(size)").first()[0]
        mb_per_s["csv_profile_lineitem"] = round(size / 1e6 / times["csv_profile_lineitem"], 1)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "mb_per_s": mb_per_s}))
    spark.stop()


if __name__ == "__main__":
    main()
