"""Score, grade and verdict expressions."""

from __future__ import annotations

from auditlake import catalog
from auditlake.functions.literals import text


def score(earned: str, possible: str, dialect: str = "py") -> str:
    """Percentage of the possible points; 0 when no check is enabled.

    py rounds halves to even, js rounds them up.  The quotient is a DOUBLE on
    purpose: decimals would round some ratios differently.
    """
    rounding = "bround" if catalog.require_dialect(dialect) == "py" else "round"
    percent = f"CAST({earned} AS DOUBLE) / CAST({possible} AS DOUBLE) * 100D"
    return f"IF({possible} = 0, 0, CAST({rounding}({percent}, 0) AS INT))"


def grade(score_name: str) -> str:
    """Letter for a score."""
    steps = " ".join(
        f"WHEN {score_name} >= {floor} THEN {text(letter)}" for floor, letter in catalog.GRADES
    )
    return f"CASE {steps} ELSE {text(catalog.LOWEST_GRADE)} END"


def verdict(score_name: str, minimum: str, missing: str, warnings: str) -> str:
    """Score reaches the minimum, no required file missing, no policy warning."""
    return f"({score_name} >= {minimum} AND size({missing}) = 0 AND size({warnings}) = 0)"
