"""Scoring operators on long-form check results.

The audit itself scores each commit in a projection; these operators do the
same for check results that were stored or filtered by other means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scoring, strings
from auditlake.operators.files import COMMIT, policy_keys
from auditlake.operators.lookup import lookup


def enabled_checks(results: DataFrame, policies: DataFrame) -> DataFrame:
    """Results of the checks that the policy does not disable."""
    keys = policy_keys(policies)
    disabling = policies.filter("size(disabled_checks) > 0").select(*keys, "disabled_checks")
    return (
        lookup(results, disabling, keys, ["sha", "key"])
        .filter("NOT coalesce(array_contains(disabled_checks, key), false)")
        .drop("disabled_checks")
    )


def score_results(results: DataFrame, dialect: str = "py") -> DataFrame:
    """Earned and possible points, score and grade of each commit in the results."""
    return (
        results.groupBy(*COMMIT)
        .agg(
            F.expr("sum(IF(passed, points, 0)) AS earned"),
            F.expr("sum(points) AS possible"),
        )
        .selectExpr("*", f"{scoring.score('earned', 'possible', dialect)} AS score")
        .selectExpr("*", f"{scoring.grade('score')} AS grade")
    )


def missing_required_files(signals: DataFrame) -> DataFrame:
    """Required files of the policy that a commit lacks, in policy order."""
    missing = strings.items_missing("required_files", "required_mask", "required_found")
    return signals.selectExpr(*COMMIT, f"{missing} AS missing_required_files")
