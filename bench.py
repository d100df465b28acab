"""Wall time of the registered queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "snapshot_rollup", "person_categories", "fingerprint_diff", "change_log_counts", "retention_keep2", "retention_cascade",
    "identity_resolve", "profile_upsert", "flatten_name_title", "flatten_people", "exact_link", "fuzzy_candidates", "fuzzy_compare",
    "staff_search", "search_category_scope", "suggestions", "sites_with_changes", "site_change_stats", "site_change_page",
    "site_profile_counts", "export_full", "export_school", "export_changes", "export_summary", "change_quality", "export_audit",
    "due_list", "run_status", "registry_merge_plan", "registry_dedupe", "failure_queue", "rollback_month", "category_backfill",
    "contact_extract", "heading_carry", "page_links", "rule_cascade", "challenge_pages",
]


def main() -> None:
    from rosterlens.plans.catalog import QUERIES
    from rosterlens.session import drop_stages, local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    times = {}
    QUERIES["snapshot_rollup"](spark, sf_dir).count()
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    drop_stages(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
