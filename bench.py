"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from plumbline import workloads
from plumbline.session import local_session

HEADLINE = [
    "ag01_profile_lineitem",
    "ag07_audit_warehouse",
    "ag08_validate_table",
    "ag11_unique_rows",
    "ag13_rollup_sum",
    "ag21_request_log",
    "cl04_locf",
    "cl08_clip",
    "cl17_multi_target",
    "cl19_rule_clean",
    "co05_report",
    "co07_apply",
    "co08_pii_text",
    "fi02_outlier_drop",
    "gr05_closure",
    "gr10_impact",
    "gr14_page_rank",
    "in01_pearson",
    "in02_chi2",
    "in03_fk",
    "jo01_orphans",
    "jo04_overlap",
    "sc02_drift",
    "se01_distinct",
    "sf01_mask_email",
    "st01_admission_batch",
    "st02_histogram",
    "wi01_dedup",
    "wi03_trend",
    "wi08_samples",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    seconds = {}
    for key in HEADLINE:
        start = time.perf_counter()
        # Every row is computed in full and thrown away, so that no collect is timed.
        workloads.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
