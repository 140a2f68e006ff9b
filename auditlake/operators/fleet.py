"""Listing of installed repositories and manual audit requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.lookup import lookup

READY = "ready"
# Answers to requests that cannot be audited.
REPOSITORY_REQUIRED = "Repository is required"
NOT_PUBLIC = "Repository is not a public App installation"


def public_repositories(installations: DataFrame, ordered: bool = True) -> DataFrame:
    """Public repositories of all installations, by full name; those of one name
    in the order of their installations."""
    rows = (
        installations.selectExpr("id AS installation_id", "inline(repositories)")
        .filter("NOT coalesce(private, false)")
        .select("installation_id", "full_name", "default_branch", "html_url")
    )
    order = (F.collate("full_name", "UNICODE"), "installation_id")
    return rows.orderBy(*order) if ordered else rows


def repository_listing(installations: DataFrame, ordered: bool = True) -> DataFrame:
    """The public listing, without installation ids."""
    return public_repositories(installations, ordered).drop("installation_id")


def resolve_requests(
    requests: DataFrame, installations: DataFrame, branch_heads: DataFrame
) -> DataFrame:
    """Adds ``status``, ``installation_id`` and ``sha`` to requested names.

    ``requests`` has a column ``repository``; ``branch_heads`` has
    ``repository, branch, sha``.  A repository of several installations belongs
    to the one with the lowest id.  One repository may be requested any number
    of times: both lookups spread its requests.
    """
    spread = [name for name in requests.columns if name != "repository"] or ["repository"]
    public = (
        public_repositories(installations, ordered=False)
        .groupBy(F.col("full_name").alias("repository"))
        .agg(F.expr("min(struct(installation_id, default_branch)) AS found"))
        .select("repository", "found.*")
    )
    heads = branch_heads.selectExpr("repository", "branch AS default_branch", "sha")
    resolved = lookup(requests, public, ["repository"], spread)
    resolved = lookup(resolved, heads, ["repository", "default_branch"], spread)
    status = (
        f"CASE WHEN coalesce(repository, '') = '' THEN '{REPOSITORY_REQUIRED}'"
        f" WHEN installation_id IS NULL THEN '{NOT_PUBLIC}' ELSE '{READY}' END"
    )
    return resolved.selectExpr(*requests.columns, f"{status} AS status", "installation_id", "sha")
