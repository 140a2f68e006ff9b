"""Fleet-wide repository-quality audits on Spark DataFrames.

    from auditlake import audit, check_runs, policy_table

    report = audit(files, commits, policy_table(raw_policies))
    check_runs(report).write.parquet(...)
"""

from auditlake.operators.events import event_status, route_marketplace
from auditlake.operators.files import attach_content, tree_blobs
from auditlake.operators.fleet import (
    public_repositories,
    repository_listing,
    resolve_requests,
)
from auditlake.operators.policies import (
    pick_policy,
    policy_table,
    validate_policies,
)
from auditlake.operators.publishing import (
    check_runs,
    markdown_reports,
    previous_scores,
    report_documents,
    report_json,
)
from auditlake.plans.audit import (
    audit,
    audit_summary,
    check_results,
    commit_signals,
    file_evidence,
    reports,
    results_with_evidence,
)
from auditlake.sources.check_runs import read_check_runs, write_check_runs
from auditlake.sources.checkouts import scan_checkouts
from auditlake.sources.inventory import read_inventory, write_inventory
from auditlake.streaming.audits import stream_audit

__all__ = [
    "attach_content",
    "audit",
    "audit_summary",
    "check_results",
    "check_runs",
    "commit_signals",
    "event_status",
    "file_evidence",
    "markdown_reports",
    "pick_policy",
    "policy_table",
    "previous_scores",
    "public_repositories",
    "read_check_runs",
    "read_inventory",
    "report_documents",
    "report_json",
    "reports",
    "repository_listing",
    "resolve_requests",
    "results_with_evidence",
    "route_marketplace",
    "scan_checkouts",
    "stream_audit",
    "tree_blobs",
    "validate_policies",
    "write_check_runs",
    "write_inventory",
]
