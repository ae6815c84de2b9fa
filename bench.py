"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` an optional comma list. One warm-up, then the median of three.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from prizelens.queries import QUERIES
from prizelens.session import build_session

HEADLINE = [
    "a20_baseline_scores",
    "j08_complete_quarter_grid",
    "a01_monthly_rollup",
    "a05_coverage",
    "a07_country_totals",
    "a08_describe",
    "a09_robust_summary",
    "a16_trimmed_correlation",
    "a18_model_scores",
    "a24_reconciliation",
    "a25_reconciliation_review",
    "a27_breakdown_audit",
    "a32_concentration",
    "a36_missing_periods",
    "j01_checked_inner_join",
    "j03_monthly_panel",
    "p01_clean_text",
    "p04_to_cents",
    "q02_group_veto",
    "q05_ambiguous_ids",
    "q08_iqr_flag_raw_rows",
    "q10_check_suite",
    "s13_log_upsert",
    "w02_trailing_statistics",
    "w08_top_per_family",
    "w09_average_rank",
    "w10_global_rank_of_rows",
    "x01_links",
    "q02_cleaning_parents",
    "q06_duplicate_within_parent",
    "a28_seasonality",
    "x04_result_rows",
    "x05_breakdown_rows",
    "x10_batch_audit",
    "r1_streaming_upsert",
]


def timed(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        {"spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {}
    for name in names:
        timed(spark, sf, name)
        runs = [timed(spark, sf, name) for _ in range(3)]
        queries[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
