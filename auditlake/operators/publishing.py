"""Report rendering and check-run rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import catalog, schemas
from auditlake.functions import paths
from auditlake.functions.literals import text, texts
from auditlake.operators.files import COMMIT
from auditlake.operators.lookup import sifted
from auditlake.operators.policies import NO_TEXTS
from auditlake.session import kept

# Wording of titles and of the score comparison.
NO_PREVIOUS = "\n\nPrevious audited commit: **not available**"
CHANGE_PREFIX = "\n\nScore change from previous audited commit: **"
TITLE_FORMAT = "Quality score: %d/100 (%s)"
TITLE_SCORE_PATTERN = r"Quality score: (\d+)/100"


def next_steps_lines(dialect: str = "py") -> str:
    """One line per failed check, in catalogue order; js links the guidance."""
    parts = ["'- **'", "check.title", "':** '", "check.recommendation"]
    if catalog.require_dialect(dialect) == "js":
        parts += ["' [Guidance]('", "check.documentation_url", "')'"]
    failed = "filter(checks, check -> NOT check.passed)"
    lines = f"transform({failed}, check -> concat({', '.join(parts)}))"
    fallback = texts([catalog.ALL_CHECKS_PASSED])
    return f"IF(forall(checks, check -> check.passed), {fallback}, {lines})"


def next_steps(reports: DataFrame, dialect: str = "py") -> DataFrame:
    """Recommendation text of each report."""
    return reports.selectExpr(
        *COMMIT, rf"array_join({next_steps_lines(dialect)}, '\n') AS next_steps"
    )


def report_markdown(dialect: str = "py", title: str = catalog.REPORT_TITLE) -> str:
    """Markdown document of a report row."""
    heading = f"concat({text('## ' + title + ': ')}, score, '/100 (', grade, ')')"
    threshold = (
        f"concat('Policy threshold: **', minimum_score, {text('/100** · Result: **')},"
        " IF(passed, 'Pass', 'Needs work'), '**')"
    )
    label = f"IF(check.passed, {text(catalog.PASS_LABEL)}, {text(catalog.FAIL_LABEL)})"
    check_row = (
        f"concat('| ', check.title, ' | ', {label}, ' | ',"
        " IF(check.passed, check.points, 0), '/', check.points, ' |')"
    )
    missing = (
        "transform(missing_required_files,"
        " path -> concat('- Missing required file: `', path, '`'))"
    )
    present = texts([catalog.ALL_FILES_PRESENT])
    warnings = (
        "concat(array('', '### Policy warnings', ''),"
        " transform(policy_warnings, warning -> concat('- ', warning)))"
    )
    blocks = [
        f"array({heading}, '', {threshold}, '')",
        texts(["| Check | Result | Points |", "|---|---:|---:|"]),
        f"transform(checks, check -> {check_row})",
        texts(["", "### Required files", ""]),
        f"IF(size(missing_required_files) > 0, {missing}, {present})",
        texts(["", "### Recommended next steps", ""]),
        next_steps_lines(dialect),
        f"IF(size(policy_warnings) > 0, {warnings}, {NO_TEXTS})",
        texts(["", catalog.DISCLAIMER]),
    ]
    return rf"array_join(concat({', '.join(blocks)}), '\n')"


def markdown_reports(
    reports: DataFrame, dialect: str = "py", title: str = catalog.REPORT_TITLE
) -> DataFrame:
    return reports.selectExpr(*COMMIT, f"{report_markdown(dialect, title)} AS markdown")


# The checks that paths are evidence of, and the column with the numbers of their paths.
EVIDENCE_KEYS, EVIDENCE = catalog.CHECK_KEYS, "evidence_paths"


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Numbers of paths of each commit that has any, in the order of ``EVIDENCE_KEYS``."""
    each = [F.count_if(F.col("key") == key).alias(f"_{key}") for key in EVIDENCE_KEYS]
    counts = evidence.groupBy(*COMMIT).agg(*each)
    return counts.selectExpr(*COMMIT, f"array({', '.join(f'_{key}' for key in EVIDENCE_KEYS)}) AS {EVIDENCE}")


def report_documents(reports: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Reports as nested documents, ready for ``to_json`` or a JSON/Parquet sink.

    One document per commit at every size.  ``evidence`` are the distinct
    (commit, key, path) rows of the file rules; the documents carry their
    counts and the README's terms, the rows are a table of their own (see
    ``evidence_json``). Reports that carry ``evidence_counts`` (see ``commit_signals``) are not shuffled for them.
    """
    found, counted = reports, "size(check.term_evidence)"
    if evidence is not None:
        carried = EVIDENCE in reports.columns
        found = reports if carried else reports.join(evidence_counts(evidence), COMMIT, "left")
        place = f"array_position({texts(EVIDENCE_KEYS)}, check.key)"
        counted = f"size(check.term_evidence) + coalesce(IF({place} > 0, {EVIDENCE}[{place} - 1], 0L), 0L)"
    names = ("key", "title", "passed", "points", "recommendation", "term_evidence")
    fields = ", ".join(f"'{name}', check.{name}" for name in names)
    document = f"named_struct({fields}, 'evidence_count', CAST({counted} AS BIGINT))"
    return found.selectExpr(
        *COMMIT,
        "score",
        "grade",
        "passed",
        "minimum_score",
        "missing_required_files",
        "policy_warnings",
        f"transform(checks, check -> {document}) AS checks",
    )


def report_json(documents: DataFrame) -> DataFrame:
    """One JSON text per report document."""
    fields = [name for name in documents.columns if name != "sha"]
    return documents.selectExpr(*COMMIT, f"to_json(struct({', '.join(fields)})) AS report")


def evidence_json(evidence: DataFrame) -> DataFrame:
    """One JSON text per path of the file rules, to lie beside the reports."""
    return evidence.selectExpr(*COMMIT, "to_json(struct(repository, sha, key, path)) AS line")


# A root README's raw path as a number: which name, and which of its letters are capitals.
_README_NAMES = (catalog.README_MD, catalog.README_RST)
_CASE_BITS = max(map(len, _README_NAMES))
_README_BITS = _CASE_BITS + 1


def _readme_number() -> str:
    """Position and spelling of a root README in one number, NULL for other paths; the least is the first."""
    capitals = " + ".join(
        f"IF(substring(path, {k + 1}, 1) BETWEEN 'A' AND 'Z', {1 << k}L, 0L)" for k in range(_CASE_BITS)
    )
    which = f"IF(lower(path) = {text(_README_NAMES[1])}, {1 << _CASE_BITS}L, 0L)"
    spelled = f"shiftleft(CAST(seq AS BIGINT), {_README_BITS}) + {which} + {capitals}"
    return f"IF({paths.is_root_readme('lower(path)')}, {spelled}, NULL)"


def _readme_path(number: str) -> str:
    """The raw path that such a number stands for."""
    name = f"IF(({number} & {1 << _CASE_BITS}L) <> 0, {text(_README_NAMES[1])}, {text(_README_NAMES[0])})"
    letter = f"substring({name}, k + 1, 1)"
    spelled = f"IF(({number} & shiftleft(1L, k)) <> 0, upper({letter}), {letter})"
    return f"array_join(transform(sequence(0, length({name}) - 1), k -> {spelled}), '')"


def readme_paths(files: DataFrame) -> DataFrame:
    """The raw path annotations point to: first root README, else first file.

    ``files`` are raw tree rows; neither normalised nor policy-filtered. Only numbers are aggregated: a README's path is
    spelled from its number, and of commits without one the path is fetched by the position of the first file. The numbers are
    kept, as they tell which rows that needs; the others are not shuffled.
    """
    first = kept(files.groupBy(*COMMIT).agg(F.expr(f"min({_readme_number()}) AS _readme"), F.min("seq").alias("seq")))
    named = first.filter("_readme IS NOT NULL AND seq IS NOT NULL")
    named = named.selectExpr(*COMMIT, f"{_readme_path('_readme')} AS annotation_path")
    others = first.filter("_readme IS NULL AND seq IS NOT NULL").select(*COMMIT, "seq")
    listed = files.selectExpr(*COMMIT, "seq", "path AS annotation_path")
    fetched = sifted(listed, others, [*COMMIT, "seq"]).join(others, [*COMMIT, "seq"], "left_semi")
    return named.unionByName(fetched.drop("seq"))


def annotations(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``annotations``: one warning per failed check, none without files.

    As in the other joins of this module, commits meet commits: neither side is small, whatever is estimated of it. Reports that
    carry ``annotation_path`` (``readme_paths``, see ``commit_signals``) are not shuffled for it.
    """
    annotation = (
        "named_struct('path', annotation_path, 'start_line', 1, 'end_line', 1,"
        " 'annotation_level', 'warning', 'title', check.title,"
        " 'message', check.recommendation, 'raw_details', check.documentation_url)"
    )
    failed = "filter(checks, check -> NOT check.passed)"
    # A tree whose first path is empty has nothing to point to.
    rows = (
        f"IF(coalesce(annotation_path, '') = '', array(),"
        f" transform({failed}, check -> {annotation}))"
    )
    pointed = reports if "annotation_path" in reports.columns else reports.join(readme_paths(files).hint("merge"), COMMIT, "left")
    columns = [name for name in reports.columns if name != "annotation_path"]
    return pointed.selectExpr(*columns, f"{rows} AS annotations")


def previous_scores(
    commits: DataFrame, check_runs: DataFrame, name: str = catalog.REPORT_TITLE
) -> DataFrame:
    """Score of the first parent's check run, read from its title; NULL if none.

    ``check_runs`` has columns ``repository, head_sha, name, title, run_seq``;
    of several runs of a commit the one with the least ``run_seq`` counts.
    """
    digits = f"nullif(regexp_extract(title, {text(TITLE_SCORE_PATTERN)}, 1), '')"
    first = (
        check_runs.filter(F.col("name") == name)
        .selectExpr(
            "repository",
            "head_sha AS parent_sha",
            f"try_cast({digits} AS INT) AS score",
            "run_seq",
        )
        .groupBy("repository", "parent_sha")
        .agg(F.min_by("score", "run_seq").alias("previous_score"))
    )
    parent = "nullif(try_element_at(parents, 1).sha, '')"
    return (
        commits.selectExpr(*COMMIT, f"{parent} AS parent_sha")
        .join(first.hint("merge"), ["repository", "parent_sha"], "left")
        .select(*COMMIT, "previous_score")
    )


def score_delta(score: str = "score", previous: str = "previous_score") -> str:
    """Text appended to a summary: the change since the previous audit."""
    change = f"({score} - {previous})"
    changed = (
        f"concat({text(CHANGE_PREFIX)}, IF({change} >= 0, '+', ''), {change},"
        f" '** (', {previous}, {text(' → ')}, {score}, ')')"
    )
    return f"coalesce({changed}, {text(NO_PREVIOUS)})"


def check_runs(
    reports: DataFrame,
    dialect: str = "py",
    title: str = catalog.REPORT_TITLE,
    files: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """One check run per report.

    js adds annotations (needs ``files``) and the score change (needs
    ``previous``, see ``previous_scores``) to the summary. Reports that carry ``annotation_path`` or ``previous_score`` already
    (see ``commit_signals``) are not joined for them again.
    """
    rows, summary = reports, report_markdown(dialect, title)
    note_type = schemas.CHECK_RUNS["output"].dataType["annotations"].dataType.simpleString()
    notes = f"CAST(array() AS {note_type})"
    if catalog.require_dialect(dialect) == "js":
        if previous is None:
            rows = rows.selectExpr("*", "CAST(NULL AS INT) AS previous_score")
        elif "previous_score" not in rows.columns:
            rows = rows.join(previous.hint("merge"), COMMIT, "left")
        summary = f"concat({summary}, {score_delta()})"
        if files is not None:
            rows, notes = annotations(rows, files), "annotations"
    return rows.selectExpr(
        "repository",
        "sha AS head_sha",
        f"{text(title)} AS name",
        "'completed' AS status",
        "IF(passed, 'success', 'failure') AS conclusion",
        f"named_struct('title', {check_run_title()}, 'summary', {summary},"
        f" 'annotations', {notes}) AS output",
    )


def check_run_title() -> str:
    return f"format_string({text(TITLE_FORMAT)}, score, grade)"
