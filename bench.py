"""Time the headline queries: one JSON line.  ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_ONLY`` steer it."""

from __future__ import annotations

import json
import logging
import os
import sys
import time

from statmosaic.plans import QUERIES
from statmosaic.session import build_session

HEADLINE = [
    "ledger_windows", "a01_header_contract", "a06_workbook_cells", "a08_merged_headers", "a09_cube_cells", "a13_page_links",
    "b01_symbol_decode", "b02_number_rules", "b07_unit_resolution", "b14_movement_rules", "b19_text_search", "b25_mapped_measures",
    "c01_table_merge", "c08_reconciliation", "c09_snapshot_diff", "c12_point_in_polygon_join", "c14_cross_ratio",
    "d01_ledger", "d02_grouping_sets", "d03_mean_min_sample", "d07_null_sum", "d13_class_panel", "d17_leader", "d22_stock_and_mean",
    "e01_change", "e06_last_published", "e07_latest_complete", "e11_absorb_smallest", "f01_rank_products", "f03_nearest_k",
    "g04_expected_seen", "g05_dedup", "h01_fold", "i02_unique_keys", "i14_yield_warnings", "j02_sibling_suppression",
    "j04_merge_small", "j07_leak_scan", "k01_point_in_polygon", "k06_union_area", "l03_revision_log", "m01_stream_ledger",
    "employment_monthly", "education_network_series", "agriculture_ranking", "social_income_bands", "environment_land_history",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("d01_ledger")  # start-up of the session is not a query's time
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        times[name] = run(name)
    print(json.dumps({
        "metric": "total wall-clock of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
