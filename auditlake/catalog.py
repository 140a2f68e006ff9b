"""Fixed values of the audit: check catalogue, file names, phrases, defaults.

Everything in this module is a fixed value: results are only right when these
texts, points and names are exactly the ones written here.  File names and
phrases are compared against lowercased paths and README texts.

The two dialects ``"py"`` and ``"js"`` are the two published rule sets; they
differ in a few texts and edge cases (see README, "Dialects").
"""

from __future__ import annotations

from typing import NamedTuple

DIALECTS = ("py", "js")


class Check(NamedTuple):
    key: str
    title: str
    points: int
    recommendation: str
    anchor: str


# Check catalogue in report order; the points sum to 100.
CHECKS = (
    Check(
        "readme",
        "Project documentation",
        12,
        "Add a README explaining the research question, methods, data, and usage.",
        "project-documentation",
    ),
    Check(
        "license",
        "License",
        10,
        "Add a LICENSE and clarify whether data have separate reuse terms.",
        "license",
    ),
    Check(
        "citation",
        "Machine-readable citation",
        8,
        "Add CITATION.cff with authors, title, version, and preferred citation.",
        "citation",
    ),
    Check(
        "dependencies",
        "Dependency specification",
        12,
        "Add a dependency or environment file with compatible version ranges.",
        "dependencies",
    ),
    Check(
        "reproduction",
        "One-command reproduction",
        14,
        "Provide a Makefile, workflow, or documented single command that regenerates outputs.",
        "reproduction",
    ),
    Check(
        "tests",
        "Automated tests or CI",
        12,
        "Add tests and a CI workflow for data validation and analytical invariants.",
        "tests-and-ci",
    ),
    Check(
        "data_dictionary",
        "Data dictionary or codebook",
        10,
        "Document variables, units, missing-value conventions, and allowed values.",
        "data-dictionary",
    ),
    Check(
        "provenance",
        "Data provenance",
        8,
        "Document each data source, access date, transformation, and license.",
        "data-provenance",
    ),
    Check(
        "privacy",
        "Privacy and sensitive-data warning",
        8,
        "State whether data are aggregate, synthetic, de-identified, or sensitive"
        " and define safe-use limits.",
        "privacy",
    ),
    Check(
        "ethics",
        "Ethics statement",
        6,
        "State the ethics/IRB basis or explain why review was not required.",
        "ethics",
    ),
)

# Recommendation texts that are shorter in the js dialect.
JS_RECOMMENDATIONS = {
    "tests": "Add tests and CI for data validation and analytical invariants.",
    "privacy": "State whether data are aggregate, synthetic, de-identified, or sensitive.",
}

CHECK_KEYS = tuple(check.key for check in CHECKS)

# Names and phrases the checks look for.
README_MD = "readme.md"
README_RST = "readme.rst"
LICENSE_NAMES = ("license", "license.md", "license.txt", "copying")
CITATION_NAMES = ("citation.cff", "codemeta.json")
DEPENDENCY_NAMES = (
    "requirements.txt",
    "pyproject.toml",
    "environment.yml",
    "environment.yaml",
    "renv.lock",
    "package-lock.json",
    "poetry.lock",
    "uv.lock",
)
REPRODUCTION_NAMES = ("makefile", "dvc.yaml", "snakefile", "nextflow.config")
DICTIONARY_NAMES = (
    "data_dictionary.csv",
    "data-dictionary.csv",
    "data_dictionary.md",
    "data-dictionary.md",
    "codebook.csv",
    "codebook.md",
)
TEST_PREFIXES = ("tests/", "test/", ".github/workflows/")
DICTIONARY_TEXT_SUFFIXES = ("data_dictionary.md", "data-dictionary.md", "codebook.md")
REPRODUCTION_PHRASES = ("make reproduce", "how to reproduce")
DICTIONARY_PHRASES = ("data description",)
PROVENANCE_TERMS = ("data source", "data provenance", "source data")
ETHICS_TERMS = ("ethics", "irb", "institutional review", "consent")

# Default policy and limits.
DEFAULT_MINIMUM_SCORE = 80
DEFAULT_PRIVACY_TERMS = (
    "privacy",
    "de-ident",
    "anonym",
    "patient",
    "person-level",
    "sensitive data",
)

# Grade floors, best first; anything lower is an F.
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
LOWEST_GRADE = "F"

# Pull-request actions that start an audit.
AUDITED_ACTIONS = ("opened", "reopened", "synchronize", "ready_for_review")

# Policy warnings.
WARN_NOT_OBJECT = "Policy must be a YAML object; default policy was used."
WARN_MINIMUM_SCORE = "`minimum_score` must be an integer from 0 to 100."
WARN_NOT_LIST = "`{key}` must be a list of paths or check keys."
WARN_BAD_ITEM = "`{key}` contains a non-string or empty value."
WARN_UNKNOWN_CHECK = "Unknown disabled check: `{key}`."
WARN_UNPARSABLE = "Could not parse policy document."
WARN_UNPARSABLE_JS = "Could not parse `{path}`: it is not one JSON value."

# Report wording.
PASS_LABEL = "✅ Pass"
FAIL_LABEL = "❌ Needs work"
ALL_CHECKS_PASSED = "- All configured quality checks passed."
ALL_FILES_PRESENT = "- All configured required files are present."
DISCLAIMER = (
    "_This automated review supports maintainers; it does not certify scientific"
    " validity, privacy compliance, or research ethics._"
)

# Parameters with our own defaults: report title, guidance pages, policy file.
# The policy file is looked up in this order, case-insensitively, at the root.
REPORT_TITLE = "Repository Quality"
GUIDANCE_URL = "README.md"
POLICY_FILES = (".repo-quality.yml", ".repo-quality.yaml")

# Characters removed by "strip" / "trim" in the two dialects.
_COMMON_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = {
    "py": _COMMON_SPACE + "\x1c\x1d\x1e\x1f\x85",
    "js": _COMMON_SPACE + "\ufeff",
}


def checks(dialect: str = "py") -> tuple[Check, ...]:
    """The ten checks with the texts of one dialect."""
    require_dialect(dialect)
    if dialect == "py":
        return CHECKS
    return tuple(
        check._replace(recommendation=JS_RECOMMENDATIONS.get(check.key, check.recommendation))
        for check in CHECKS
    )


def require_dialect(dialect: str) -> str:
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}, got {dialect!r}")
    return dialect
