"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "active_view", "dept_summary", "in_subquery", "select_into", "listagg_by_order", "top_earners", "old_new", "rownum",
    "minus_nulls", "connect_by", "months_between", "merge_upsert", "insert_unique", "audit_rows", "mview_fast", "nextval",
    "ck_report", "typed_load", "split_statements", "columns", "functions_used", "rule_scan", "rewrite_text",
    "rewrite_ledger", "rewrite_distinct", "category_matrix", "compose_output", "match_line", "run_totals", "file_details", "stream_audit", "split_archive",
    "script_stream", "connect_by_tree", "changed_rows", "mview_join", "page_deep", "to_char_number",
]


def main() -> None:
    from veldspar.plans.catalog import QUERIES
    from veldspar.session import get_spark

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("veldspar-bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("active_view")  # start-up is not a query
    times = {name: round(run(name), 3) for name in names}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
