"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2; the best run counts), BENCH_QUERIES (comma separated).
Writing the engine inputs (see FIXTURES.md) is timed on its own as ``setup``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from auditlake import fixtures, registry  # noqa: E402
from auditlake.session import builder  # noqa: E402

HEADLINE = (
    "audit",
    "audit_js",
    "audit_default_policy",
    "audit_commit_policies",
    "audit_documents",
    "audit_summary",
    "report_json",
    "check_run",
    "check_run_js",
    "report_markdown",
    "check_tests",
    "check_license",
    "file_evidence",
    "dedupe_paths",
    "ignore_paths",
    "attach_content",
    "tree_blobs",
    "terms_in_documents",
    "annotations",
    "score_delta",
    "validate_policy",
    "event_status",
    "route_marketplace",
    "resolve_audit_request",
    "stream_audit",
)
INPUTS = (
    "files",
    "commits",
    "raw_policies",
    "policy_files",
    "trees",
    "blobs",
    "raw_events",
    "marketplace_events",
    "installations",
    "branch_heads",
    "audit_requests",
    "long_readmes",
    "long_text_policies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    for name in INPUTS:
        getattr(fixtures, name)(spark, sf_dir)
    registry._published(spark, sf_dir)  # the check runs that score changes look back at: a whole audit
    setup = time.perf_counter() - start
    timings, first = {}, {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            first.setdefault(name, round(took, 3))
            best = min(best, took)
        timings[name] = round(best, 3)
        print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "first_runs": first,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "setup": round(setup, 3),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
