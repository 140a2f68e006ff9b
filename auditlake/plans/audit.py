"""The fleet audit as one query.

Shape of the plan, whatever the size of the fleet:

1. every file row is reduced, where it is read, to a few 64-bit masks; only these meet the policies.  README
   texts are scanned here, for the fixed phrases and the default privacy terms at once;
2. one partial + final hash aggregation per commit, of fixed width, combines them.  A commit that
   holds a third of all files contributes one row per map task;
3. what doesn't fit a mask comes from the few rows that have it, in a second, small aggregation per commit: positions
   that READMEs have of a policy's own privacy terms, and positions found of long lists of required files.  Both
   branches are planned only if the policy table has such policies (``list_sizes``);
4. results, score, grade and verdict are projections of the joined row.

The commits table is unioned into the main aggregation, so commits without any
file need no outer join.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions import paths, scoring, strings
from auditlake.functions.automaton import with_places
from auditlake.functions.literals import any_of, one_of, text
from auditlake.operators.files import (
    COMMIT,
    ListSizes,
    list_sizes,
    normalised,
    pick_readme,
    pick_readme_seq,
    policy_keys,
    readme_aggregates,
    unignored,
)
from auditlake.operators.lookup import lookup
from auditlake.operators.policies import NO_TEXTS, default_policy, with_policy
from auditlake.session import kept

# Checks that a file name alone can pass.
FILE_RULES = {
    "license": catalog.LICENSE_NAMES,
    "citation": catalog.CITATION_NAMES,
    "dependencies": catalog.DEPENDENCY_NAMES,
    "reproduction": catalog.REPRODUCTION_NAMES,
    "data_dictionary": catalog.DICTIONARY_NAMES,
}
FILE_FLAGS = (*FILE_RULES, "tests")
# Bits of the ``hits`` mask: one per file rule, and one for listed commits.
_HIT = {key: 1 << bit for bit, key in enumerate(FILE_FLAGS)}
_LISTED = 1 << len(FILE_FLAGS)


def _matches(key: str) -> str:
    """Whether the file rule of a check holds for ``path_norm`` / ``base``."""
    if key == "tests":
        return paths.is_test_path("path_norm")
    return one_of("base", FILE_RULES[key])


def _hits(keys: tuple[str, ...]) -> str:
    """Mask of the file rules that hold for ``path_norm`` / ``base``."""
    return " + ".join(f"IF({_matches(key)}, {_HIT[key]}L, 0L)" for key in keys)


def _hit(key: str) -> str:
    return f"((hits & {_HIT[key]}L) <> 0)"


def _named(files: DataFrame, dialect: str) -> DataFrame:
    """Files with ``path_norm`` and ``base``."""
    return normalised(files, dialect).selectExpr("*", f"{paths.basename('path_norm')} AS base")


# The masks of the required files that a commit has.
_REQUIRED = [f"required_{k}" for k in range(strings.MASKS)]


def _file_signals(
    files: DataFrame, policies: DataFrame | None, sizes: ListSizes | None, dialect: str
) -> DataFrame:
    """Every file as a few numbers; no text goes through a join of all files.

    There is no filter on relevant files: Catalyst would push it below the
    projections and evaluate every rule twice, which costs more than handing
    rows without any bit to the partial aggregation.
    """
    readme = paths.is_root_readme("path_norm")
    staged = _named(files, dialect).selectExpr(
        *COMMIT,
        "path_norm",
        "base",
        f"IF({readme}, path_norm, NULL) AS readme_name",
        "seq",
        f"lower(IF({readme}, content, NULL)) AS readme",
    )
    rows = staged.selectExpr(
        *COMMIT,
        "path_norm",
        "readme_name",
        "seq",
        f"{_hits(FILE_FLAGS)} AS hits",
        f"{strings.phrase_mask('readme', dialect)} AS phrases",
    )
    columns = [*COMMIT, "readme_name", "seq", "hits", "phrases"]
    if policies is None:
        return rows.selectExpr(columns)
    asked = {"_asked": f"IF(size(required_files) > 0 AND {strings.is_short('required_files')}, required_files, NULL)"}
    rows = unignored(rows, policies, sizes, asked)
    placed = rows.selectExpr(*columns, "CAST(array_position(_asked, path_norm) AS INT) AS _place")
    masks = zip(strings.position_masks("_place"), _REQUIRED, strict=True)
    return placed.selectExpr(*columns, *(f"{mask} AS {name}" for mask, name in masks))


def _facts(files: DataFrame, policies: DataFrame, sizes: ListSizes, dialect: str) -> DataFrame | None:
    """What doesn't fit a mask, by commit: for each README the positions of the policy's own terms that
    it has (``terms_found``), and the positions found of long lists of required files (``required_found``)."""
    keys, parts = policy_keys(policies), []
    if sizes.own_terms:
        own = policies.filter(f"privacy_terms <> {default_policy()['privacy_terms']}")
        readmes = normalised(files, dialect).filter(paths.is_root_readme("path_norm"))
        readmes = readmes.selectExpr(*COMMIT, "path_norm", "seq", "lower(content) AS readme")
        met = lookup(readmes.filter("readme IS NOT NULL"), own.select(*keys, "privacy_terms"), keys, ["path_norm"], how="inner", scanned=True)
        found = strings.positions("privacy_terms", "contains(readme, item)")
        short = met.filter(strings.is_short("privacy_terms")) if sizes.long_terms else met
        parts.append(short.selectExpr(*COMMIT, f"struct(seq, {found} AS found) AS terms_found"))
        if sizes.long_terms:  # one pass over each text, whatever the number of terms
            long = met.filter(f"NOT {strings.is_short('privacy_terms')}").select(*COMMIT, "seq", "readme", "privacy_terms")
            placed = with_places(long, "readme", "privacy_terms", "found")
            parts.append(placed.selectExpr(*COMMIT, "struct(seq, found) AS terms_found"))
    if sizes.long_required:
        long = policies.filter(f"NOT {strings.is_short('required_files')}")
        wanted = long.selectExpr(*keys, "posexplode(required_files) AS (required_at, path_norm)")
        if sizes.ignoring:
            wanted = unignored(wanted, policies, sizes)
        # only files under such policies go on to the join by path
        present = lookup(normalised(files, dialect).select(*COMMIT, "path_norm"), long.select(*keys), keys, ["path_norm"], how="inner", scanned=True)
        parts.append(present.join(wanted, [*keys, "path_norm"]).select(*COMMIT, "required_at"))
    if not parts:
        return None
    rows = functools.reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts)
    lists = [F.collect_list("terms_found").alias("terms_found")] * sizes.own_terms
    lists += [F.collect_set("required_at").alias("required_found")] * sizes.long_required
    return rows.groupBy(*COMMIT).agg(*lists)


_NOWHERE = "CAST(array() AS ARRAY<INT>)"
SIGNAL_COLUMNS = (*COMMIT, "hits", "phrases", "required_mask", "privacy_found", "required_found", *default_policy())


def commit_signals(
    files: DataFrame,
    commits: DataFrame,
    policies: DataFrame | None = None,
    dialect: str = "py",
    beside: Sequence[DataFrame] = (),
    keep: bool = False,
) -> DataFrame:
    """One row per commit: its policy and everything the checks look at.

    Columns besides the policy: ``hits`` (mask of the file rules), ``phrases``
    (mask of the chosen README's phrases), ``privacy_found`` (positions of a policy's own
    privacy terms it has), ``required_mask`` and ``required_found`` (the required files that exist: masks for short lists,
    positions for long ones).

    ``policies`` is read several times, so it should be a table (see ``policy_table``). ``beside`` are tables of a row per
    commit at most, whose columns are carried on to the reports; they meet the commits here, where rows are a few numbers.
    With ``keep`` these rows are kept, for reports that are read more than once.
    """
    catalog.require_dialect(dialect)
    sizes = list_sizes(policies) if policies is not None else None
    listed = commits.selectExpr(*COMMIT, f"{_LISTED}L AS hits")
    facts = _facts(files, policies, sizes, dialect) if policies is not None else None
    combined = (
        _file_signals(files, policies, sizes, dialect)
        .unionByName(listed, allowMissingColumns=True)
        .groupBy(*COMMIT)
        .agg(
            F.bit_or("hits").alias("hits"),
            *(F.bit_or(name).alias(name) for name in _REQUIRED if policies is not None),
            *readme_aggregates("phrases", path="readme_name", last=facts is not None and sizes.own_terms),
        )
        .filter(f"(hits & {_LISTED}L) <> 0")
    )
    found = {"privacy_found": _NOWHERE, "required_found": _NOWHERE}
    if facts is not None:
        combined = combined.join(facts, COMMIT, "left")
        if sizes.own_terms:
            chosen = f"filter(terms_found, one -> one.seq = {pick_readme_seq('phrases', dialect)})"
            found["privacy_found"] = f"coalesce(try_element_at({chosen}, 1).found, {_NOWHERE})"
        if sizes.long_required:
            found["required_found"] = f"coalesce(required_found, {_NOWHERE})"
    masks = [f"coalesce({name}, 0L)" if policies is not None else "0L" for name in _REQUIRED]
    combined = combined.selectExpr(
        *COMMIT,
        "hits",
        f"coalesce({pick_readme('phrases', dialect)}, 0L) AS phrases",
        f"array({', '.join(masks)}) AS required_mask",
        *(f"{value} AS {name}" for name, value in found.items()),
    )
    for table in beside:
        combined = combined.join(table.hint("merge"), COMMIT, "left")
    return with_policy(kept(combined) if keep else combined, policies, ["sha"])


# Whether the policy has the terms that are part of the mask.
_DEFAULT_TERMS = f"(privacy_terms = {default_policy()['privacy_terms']})"

# Whether a check passed, from the columns of a commit-signals row.
_PASS_RULES = {
    **{key: _hit(key) for key in FILE_FLAGS},
    "readme": strings.any_in_mask("phrases", strings.NOT_BLANK),
    "reproduction": any_of(
        [_hit("reproduction"), strings.any_in_mask("phrases", *catalog.REPRODUCTION_PHRASES)]
    ),
    "data_dictionary": any_of(
        [_hit("data_dictionary"), strings.any_in_mask("phrases", *catalog.DICTIONARY_PHRASES)]
    ),
    "provenance": strings.any_in_mask("phrases", *catalog.PROVENANCE_TERMS),
    "privacy": f"IF({_DEFAULT_TERMS}, {strings.any_in_mask('phrases', *catalog.DEFAULT_PRIVACY_TERMS)}, size(privacy_found) > 0)",
    "ethics": strings.any_in_mask("phrases", *catalog.ETHICS_TERMS),
}

# Evidence that comes from the README; file evidence is a table of its own.
_TERM_EVIDENCE = {
    "readme": f"IF({strings.any_in_mask('phrases', strings.NOT_EMPTY)}, array('README'), {NO_TEXTS})",
    "provenance": strings.phrases_in_mask("phrases", catalog.PROVENANCE_TERMS),
    "privacy": (
        f"IF({_DEFAULT_TERMS}, {strings.phrases_in_mask('phrases', catalog.DEFAULT_PRIVACY_TERMS)},"
        f" {strings.items_at('privacy_terms', 'privacy_found')})"
    ),
    "ethics": strings.phrases_in_mask("phrases", catalog.ETHICS_TERMS),
}


def _with_passes(signals: DataFrame) -> DataFrame:
    """Adds ``pass_<check>`` for the ten checks."""
    rules = [f"{_PASS_RULES[key]} AS pass_{key}" for key in catalog.CHECK_KEYS]
    return signals.selectExpr("*", *rules)


def _check_structs(dialect: str, guidance_url: str, keys: tuple[str, ...]) -> str:
    """Array of the results of a row with passes, in catalogue order."""
    structs = []
    for order, check in enumerate(catalog.checks(dialect)):
        if check.key not in keys:
            continue
        fields = {
            "check_ord": str(order),
            "key": text(check.key),
            "title": text(check.title),
            "passed": f"pass_{check.key}",
            "points": str(check.points),
            "recommendation": text(check.recommendation),
            "term_evidence": _TERM_EVIDENCE.get(check.key, NO_TEXTS),
            "documentation_url": text(f"{guidance_url}#{check.anchor}"),
        }
        named = ", ".join(f"'{name}', {value}" for name, value in fields.items())
        structs.append(f"named_struct({named})")
    return f"array({', '.join(structs)})"


def check_results(
    signals: DataFrame,
    dialect: str = "py",
    guidance_url: str = catalog.GUIDANCE_URL,
    keys: tuple[str, ...] = catalog.CHECK_KEYS,
) -> DataFrame:
    """Long form: one row per commit and check, disabled checks included.

    ``term_evidence`` is the evidence found in the README; see
    ``file_evidence`` and ``results_with_evidence`` for paths.
    """
    structs = _check_structs(dialect, guidance_url, keys)
    return _with_passes(signals).selectExpr(*COMMIT, f"inline({structs})")


def file_evidence(
    files: DataFrame,
    policies: DataFrame | None = None,
    dialect: str = "py",
    keys: tuple[str, ...] = FILE_FLAGS,
) -> DataFrame:
    """Distinct (commit, check, path) rows that passed a file rule.

    Nothing is collected and nothing is cut: a commit may have any number of
    rows.  One row per path goes through the shuffle, whatever the number of
    checks.
    """
    found = ", ".join(f"IF({_hit(key)}, {text(key)}, NULL)" for key in keys)
    hits = _named(files, dialect).selectExpr(*COMMIT, "path_norm", f"{_hits(keys)} AS hits").filter("hits <> 0")
    if policies is not None:
        hits = unignored(hits, policies, list_sizes(policies))
    return (
        hits.distinct()
        .selectExpr(*COMMIT, f"explode(array_compact(array({found}))) AS key", "path_norm AS path")
    )


def results_with_evidence(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Check results with ``evidence_count``: the paths of a file rule, else the
    terms found in the README.

    One row per check at every size; the paths themselves are the rows of
    ``evidence``.
    """
    counts = evidence.groupBy(*COMMIT, "key").agg(F.count("*").alias("_paths"))
    return results.join(counts, [*COMMIT, "key"], "left").selectExpr(
        *results.columns, "CAST(coalesce(_paths, size(term_evidence)) AS INT) AS evidence_count"
    )


def reports(
    signals: DataFrame,
    dialect: str = "py",
    guidance_url: str = catalog.GUIDANCE_URL,
) -> DataFrame:
    """One report per commit, computed from its signals without any shuffle.

    ``checks`` holds the enabled results in catalogue order. Columns that signals carry besides (``beside`` of
    ``commit_signals``) come last.
    """
    carried = [name for name in signals.columns if name not in SIGNAL_COLUMNS]
    enabled = {
        check.key: f"NOT array_contains(disabled_checks, {text(check.key)})"
        for check in catalog.CHECKS
    }
    earned = " + ".join(
        f"IF({enabled[check.key]} AND pass_{check.key}, {check.points}, 0)"
        for check in catalog.CHECKS
    )
    possible = " + ".join(
        f"IF({enabled[check.key]}, {check.points}, 0)" for check in catalog.CHECKS
    )
    missing = strings.items_missing("required_files", "required_mask", "required_found")
    structs = _check_structs(dialect, guidance_url, catalog.CHECK_KEYS)
    checks = f"filter({structs}, check -> NOT array_contains(disabled_checks, check.key))"
    verdict = scoring.verdict("score", "minimum_score", "missing_required_files", "policy_warnings")
    return (
        _with_passes(signals)
        .selectExpr(
            *COMMIT,
            "minimum_score",
            "policy_warnings",
            f"{earned} AS earned",
            f"{possible} AS possible",
            f"{missing} AS missing_required_files",
            f"{checks} AS checks",
            *carried,
        )
        .selectExpr("*", f"{scoring.score('earned', 'possible', dialect)} AS score")
        .selectExpr(
            *COMMIT,
            "score",
            f"{scoring.grade('score')} AS grade",
            f"{verdict} AS passed",
            "minimum_score",
            "earned",
            "possible",
            "missing_required_files",
            "policy_warnings",
            "checks",
            *carried,
        )
    )


def audit(
    files: DataFrame,
    commits: DataFrame,
    policies: DataFrame | None = None,
    dialect: str = "py",
    guidance_url: str = catalog.GUIDANCE_URL,
) -> DataFrame:
    """Reports of all commits: files, typed policies and commits in, one row
    per commit out.  Commits without files score 0."""
    return reports(commit_signals(files, commits, policies, dialect), dialect, guidance_url)


def audit_summary(report: DataFrame) -> DataFrame:
    return report.select("repository", "sha", "score", "grade", "passed")
