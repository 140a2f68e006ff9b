"""DuckDB SQL for the registered queries.

Written independently of the Spark side: sets, lists and JSON functions instead
of masks and variants.  Only the catalogue (names, points, phrases) and the derivation of
the inputs are shared; output wording is written out.
``_BLOCKS`` are common table expressions; ``_query`` puts the ones a query needs
in front of it.
"""

from __future__ import annotations

import re

from auditlake import catalog, fixtures

ORACLE_SQL: dict[str, str] = {}
_BLOCKS: dict[str, str] = {}


def _s(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_s(value) for value in values) + "]"


def _pick(values, index: str) -> str:
    return f"{_list(values)}[({index}) % {len(values)} + 1]"


def _needed(sql: str, seen: dict[str, None]) -> None:
    for word in re.findall(r"\w+", sql):
        if word in _BLOCKS and word not in seen:
            _needed(_BLOCKS[word], seen)
            seen[word] = None


def _query(name: str, sql: str) -> None:
    seen: dict[str, None] = {}
    _needed(sql, seen)
    blocks = ",\n".join(f"{block} AS (\n{_BLOCKS[block].strip()}\n)" for block in seen)
    ORACLE_SQL[name] = (f"WITH {blocks}\n" if blocks else "") + sql.strip()


# --- inputs ---------------------------------------------------------------

_BLOCKS["fx_commits"] = """
SELECT 'org/repo' || (o_orderkey // 10) AS repository, o_orderkey::VARCHAR AS sha,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL
            ELSE (o_orderkey - 1)::VARCHAR END AS parent_sha
FROM orders
"""

_BLOCKS["fx_lines"] = """
SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber::BIGINT AS n, slot,
       ((l_linenumber::BIGINT * 1000000000 + l_partkey) * 100000000 + l_suppkey) * 4 + slot AS seq,
       CASE slot WHEN 0 THEN l_partkey % 48 WHEN 1 THEN l_suppkey % 48
                 WHEN 2 THEN (l_orderkey * 7 + l_linenumber * 5) % 48
                 ELSE (l_orderkey + l_linenumber) % 16 END AS idx
FROM lineitem CROSS JOIN (VALUES (0), (1), (2), (3)) AS slots(slot)
"""

_phrases = ", ".join(_pick(fixtures.PHRASES, f"{key} + shift") for key in "psnk")
_BLOCKS["fx_files"] = f"""
SELECT repository, sha, seq, path,
       CASE WHEN NOT is_readme OR (k + seq) % 11 = 0 THEN NULL
            WHEN (k + seq) % 13 = 0 THEN ''
            WHEN (k + seq) % 17 = 0 THEN ' ' || chr(10) || chr(9) || ' '
            ELSE concat_ws(' ', {_phrases}, 'copy ' || seq) END AS content
FROM (
  SELECT *, 'org/repo' || (k // 10) AS repository, k::VARCHAR AS sha,
         trim(lower(path), ' /') IN ('readme.md', 'readme.rst') AS is_readme,
         CASE WHEN lower(path) LIKE '%rst%' THEN 3 ELSE 0 END AS shift
  FROM (SELECT *, {_list(fixtures.PATHS)}[idx + 1] AS path FROM fx_lines)
)
"""

_BLOCKS["fx_policies"] = f"""
SELECT 'org/repo' || c_custkey AS repository,
       {_pick(fixtures.POLICIES, 'c_custkey')} AS policy_text
FROM customer
"""

_yml, _yaml = catalog.POLICY_FILES
_BLOCKS["fx_policy_files"] = f"""
SELECT 'org/repo' || (o_orderkey // 10) AS repository, o_orderkey::VARCHAR AS sha, seq,
       CASE seq WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN {_s(_yaml)}
                                 ELSE {_s(_yaml.upper())} END
                WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN {_s(_yml)}
                                 ELSE {_s('docs/' + _yml)} END
                ELSE 'src/README.md' END AS path,
       CASE seq WHEN 1 THEN {_pick(fixtures.POLICIES, 'o_orderkey')}
                WHEN 2 THEN {_pick(fixtures.POLICIES, 'o_orderkey + 3')}
                ELSE {_pick(fixtures.POLICIES, 'o_orderkey + 5')} END AS content
FROM orders CROSS JOIN (VALUES (1::BIGINT), (2), (3)) AS candidates(seq)
"""

# --- paths and README texts -----------------------------------------------

_NORM = {
    "py": "lower(trim(path, '/'))",
    "js": r"lower(trim(regexp_replace(path, '^\s+|\s+$', '', 'g'), '/'))",
}
for _d, _expr in _NORM.items():
    _BLOCKS[f"norm_{_d}"] = f"SELECT *, {_expr} AS path_norm FROM fx_files"
    _BLOCKS[f"deduped_{_d}"] = f"""
SELECT repository, sha, path_norm, min(seq) AS seq,
       array_agg(content ORDER BY seq DESC)[1] AS content
FROM norm_{_d} GROUP BY repository, sha, path_norm
"""


def _readme(source: str, dialect: str) -> str:
    """README text per commit from deduplicated files; js prefers Markdown."""
    if dialect == "py":
        chosen = "array_agg(content ORDER BY seq)[1]"
    else:
        chosen = (
            "coalesce(max(content) FILTER (path_norm = 'readme.md'),"
            " max(content) FILTER (path_norm = 'readme.rst'))"
        )
    return f"""
SELECT repository, sha, lower(coalesce({chosen}, '')) AS readme
FROM {source} WHERE path_norm IN ('readme.md', 'readme.rst') GROUP BY repository, sha
"""


_BLOCKS["documents_readme"] = (
    "SELECT doc_id::VARCHAR AS sha, lower(coalesce(text, '')) AS readme FROM documents"
)


def _basename(path: str) -> str:
    return f"split_part({path}, '/', -1)"


def _found(terms: str, text: str) -> str:
    return f"list_filter({terms}, lambda t: contains({text}, t))"


_JOIN = "array_to_string({}, ' | ')"

# --- policies -------------------------------------------------------------


def _policy_blocks(prefix: str, source: str, keys: str, dialect: str) -> None:
    """Blocks ``<prefix>_parsed`` and ``<prefix>_typed`` for a table of texts."""
    lists = ("disabled_checks", "required_files", "ignore_paths", "privacy_terms")
    _BLOCKS[f"{prefix}_docs"] = f"""
SELECT {keys}, policy_text,
       CASE WHEN policy_text IS NULL THEN 'absent'
            WHEN trim(policy_text) = '' THEN 'empty'
            WHEN NOT json_valid(policy_text) THEN 'unparsable'
            WHEN json_type(policy_text) = 'NULL' THEN 'empty'
            WHEN json_type(policy_text) = 'OBJECT' THEN 'object'
            ELSE 'not_object' END AS document_kind,
       CASE WHEN json_valid(policy_text) AND json_type(policy_text) = 'OBJECT'
            THEN policy_text::JSON END AS doc
FROM {source}
"""
    if dialect == "py":
        valid = "min_type IN ('UBIGINT', 'BIGINT')"
    else:
        valid = "min_type IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND min_value = floor(min_value)"
    bad_kinds = "('not_object')" if dialect == "py" else "('not_object', 'empty')"
    raw_lists, items, warns = [], [], []
    for key in lists:
        raw_lists.append(f"json_type(doc, '$.{key}') AS {key}_type")
        raw_lists.append(f"json_extract(doc, '$.{key}[*]') AS {key}_all")
        seen = f"{key}_all"
        good = (
            f"list_filter({seen}, lambda x: json_type(x) = 'VARCHAR'"
            " AND trim(json_extract_string(x, '$')) <> '')"
        )
        text = f"list_transform({good}, lambda x: json_extract_string(x, '$'))"
        items.append(
            f"CASE WHEN {key}_type = 'ARRAY' THEN {text} ELSE [] END AS {key}_items"
        )
        bad_item = _s(catalog.WARN_BAD_ITEM.format(key=key))
        not_list = _s(catalog.WARN_NOT_LIST.format(key=key))
        warns.append(
            f"CASE WHEN {key}_type = 'ARRAY' THEN"
            f" list_transform(range(len({seen}) - len({good})), lambda i: {bad_item})"
            f" WHEN {key}_type IS NOT NULL THEN [{not_list}] ELSE [] END AS {key}_warnings"
        )
    _BLOCKS[f"{prefix}_parsed"] = f"""
SELECT {keys}, document_kind,
       CASE WHEN document_kind = 'unparsable' THEN [{_s(catalog.WARN_UNPARSABLE)}]
            WHEN document_kind IN {bad_kinds} THEN [{_s(catalog.WARN_NOT_OBJECT)}]
            ELSE [] END AS document_warnings,
       CASE WHEN {valid} AND min_value BETWEEN 0 AND 100
            THEN min_value::INTEGER ELSE 80 END AS minimum_score,
       CASE WHEN min_type IS NULL OR ({valid} AND min_value BETWEEN 0 AND 100) THEN []
            ELSE [{_s(catalog.WARN_MINIMUM_SCORE)}] END AS minimum_warnings,
       {', '.join(items)},
       {', '.join(warns)}
FROM (
  SELECT *, json_type(doc, '$.minimum_score') AS min_type,
         TRY_CAST(json_extract_string(doc, '$.minimum_score') AS DOUBLE) AS min_value,
         {', '.join(raw_lists)}
  FROM {prefix}_docs
)
"""
    first = lambda values: f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"
    clean = lambda key: f"list_transform({key}_items, lambda x: lower(trim(trim(x), '/')))"
    keys_list = _list(catalog.CHECK_KEYS)
    known = f"list_filter(disabled_checks_items, lambda x: list_contains({keys_list}, x))"
    unknown = f"list_filter(disabled_checks_items, lambda x: NOT list_contains({keys_list}, x))"
    before, after = catalog.WARN_UNKNOWN_CHECK.split("{key}")
    unknown = f"list_transform({unknown}, lambda x: {_s(before)} || x || {_s(after)})"
    _BLOCKS[f"{prefix}_typed"] = f"""
SELECT {keys}, document_kind, minimum_score,
       {first('known')} AS disabled_checks,
       {first('required')} AS required_files,
       {first('ignored')} AS ignore_paths,
       CASE WHEN len(terms) > 0 THEN {first('terms')}
            ELSE {_list(catalog.DEFAULT_PRIVACY_TERMS)} END AS privacy_terms,
       unknown AS unknown_warnings,
       list_concat(document_warnings, minimum_warnings, disabled_checks_warnings, unknown,
                   required_files_warnings, ignore_paths_warnings,
                   privacy_terms_warnings) AS policy_warnings
FROM (
  SELECT *, {known} AS known, {unknown} AS unknown, {clean('required_files')} AS required,
         {clean('ignore_paths')} AS ignored,
         list_transform(privacy_terms_items, lambda x: lower(trim(x))) AS terms
  FROM {prefix}_parsed
)
"""


for _d in catalog.DIALECTS:
    _policy_blocks(f"policy_{_d}", "fx_policies", "repository", _d)

# --- audit ----------------------------------------------------------------

_DEFAULTS = {
    "minimum_score": "80",
    "disabled_checks": "[]::VARCHAR[]",
    "required_files": "[]::VARCHAR[]",
    "ignore_paths": "[]::VARCHAR[]",
    "privacy_terms": _list(catalog.DEFAULT_PRIVACY_TERMS),
    "policy_warnings": "[]::VARCHAR[]",
}
_EVIDENCE = {
    "license": catalog.LICENSE_NAMES,
    "citation": catalog.CITATION_NAMES,
    "dependencies": catalog.DEPENDENCY_NAMES,
    "reproduction": catalog.REPRODUCTION_NAMES,
    "data_dictionary": catalog.DICTIONARY_NAMES,
}
_TESTS = " OR ".join(f"starts_with(path_norm, {_s(p)})" for p in catalog.TEST_PREFIXES)
_PROVENANCE, _ETHICS = _list(catalog.PROVENANCE_TERMS), _list(catalog.ETHICS_TERMS)


def _audit_blocks(
    prefix: str,
    dialect: str,
    files: str,
    commits: str,
    policies: str | None,
    policy_keys: tuple[str, ...] = ("repository",),
) -> None:
    """Blocks ``<prefix>_visible/_wide/_checks/_report`` of a whole audit.

    ``files`` are deduplicated files (repository, sha, path_norm, seq, content).
    """
    if policies:
        using = ", ".join(policy_keys)
        fields = ", ".join(f"coalesce(p.{n}, {d}) AS {n}" for n, d in _DEFAULTS.items())
        joined = f"SELECT c.repository, c.sha, {fields} FROM {commits} c LEFT JOIN {policies} p USING ({using})"
    else:
        fields = ", ".join(f"{d} AS {n}" for n, d in _DEFAULTS.items())
        joined = f"SELECT c.repository, c.sha, {fields} FROM {commits} c"
    _BLOCKS[f"{prefix}_commits"] = joined
    _BLOCKS[f"{prefix}_visible"] = f"""
SELECT f.repository, f.sha, f.path_norm, f.seq, f.content, {_basename('f.path_norm')} AS base
FROM {files} f JOIN {prefix}_commits c USING (repository, sha)
WHERE len(list_filter(c.ignore_paths,
      lambda i: f.path_norm = i OR starts_with(f.path_norm, i || '/'))) = 0
"""
    _BLOCKS[f"{prefix}_readme"] = _readme(f"{prefix}_visible", dialect)
    lists = ", ".join(
        f"list(DISTINCT path_norm ORDER BY path_norm) FILTER (base IN ({', '.join(map(_s, names))}))"
        f" AS {key}_paths"
        for key, names in _EVIDENCE.items()
    )
    _BLOCKS[f"{prefix}_paths"] = f"""
SELECT repository, sha, list(DISTINCT path_norm) AS all_paths, {lists},
       list(DISTINCT path_norm ORDER BY path_norm) FILTER ({_TESTS}) AS tests_paths
FROM {prefix}_visible GROUP BY repository, sha
"""
    empty = "[]::VARCHAR[]"
    paths = ", ".join(
        f"coalesce(f.{key}_paths, {empty}) AS {key}_ev" for key in (*_EVIDENCE, "tests")
    )
    _BLOCKS[f"{prefix}_wide"] = f"""
SELECT *, CASE WHEN readme <> '' THEN ['README'] ELSE {empty} END AS readme_ev,
       {_found(_PROVENANCE, 'readme')} AS provenance_ev,
       {_found('privacy_terms', 'readme')} AS privacy_ev,
       {_found(_ETHICS, 'readme')} AS ethics_ev,
       list_filter(required_files, lambda r: NOT list_contains(all_paths, r)) AS missing
FROM (
  SELECT c.*, coalesce(r.readme, '') AS readme, {paths},
         coalesce(f.all_paths, {empty}) AS all_paths
  FROM {prefix}_commits c
  LEFT JOIN {prefix}_readme r USING (repository, sha)
  LEFT JOIN {prefix}_paths f USING (repository, sha)
)
"""
    rules = {
        "readme": r"regexp_replace(readme, '\s', '', 'g') <> ''",
        "reproduction": "len(reproduction_ev) > 0 OR contains(readme, 'make reproduce')"
        " OR contains(readme, 'how to reproduce')",
        "data_dictionary": "len(data_dictionary_ev) > 0 OR contains(readme, 'data description')",
    }
    structs = ", ".join(
        "{"
        + f"'check_ord': {n}, 'key': {_s(c.key)}, 'title': {_s(c.title)},"
        + f" 'passed': ({rules.get(c.key, f'len({c.key}_ev) > 0')}), 'points': {c.points},"
        + f" 'recommendation': {_s(c.recommendation)},"
        + f" 'documentation_url': {_s(catalog.GUIDANCE_URL + '#' + c.anchor)},"
        + f" 'evidence': {c.key}_ev"
        + "}"
        for n, c in enumerate(catalog.checks(dialect))
    )
    _BLOCKS[f"{prefix}_all"] = f"SELECT *, [{structs}] AS results FROM {prefix}_wide"
    _BLOCKS[f"{prefix}_checks"] = f"""
SELECT repository, sha, disabled_checks, unnest(results, recursive := false) AS c
FROM {prefix}_all
"""
    rounding = "round_even" if dialect == "py" else "round"
    _BLOCKS[f"{prefix}_scored"] = f"""
SELECT *, CASE WHEN possible = 0 THEN 0
          ELSE {rounding}(earned::DOUBLE / possible::DOUBLE * 100.0, 0)::INTEGER END AS score
FROM (
  SELECT *, list_sum(list_transform(checks, lambda x: x.points))::INTEGER AS possible,
         coalesce(list_sum(list_transform(list_filter(checks, lambda x: x.passed),
                                          lambda x: x.points)), 0)::INTEGER AS earned
  FROM (
    SELECT *, list_filter(results, lambda x: NOT list_contains(disabled_checks, x.key)) AS checks
    FROM {prefix}_all
  )
)
"""
    _BLOCKS[f"{prefix}_report"] = f"""
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C'
               WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
       score >= minimum_score AND len(missing) = 0 AND len(policy_warnings) = 0 AS passed
FROM {prefix}_scored
"""


for _d in catalog.DIALECTS:
    _audit_blocks(f"audit_{_d}", _d, f"deduped_{_d}", "fx_commits", f"policy_{_d}_typed")
_audit_blocks("audit_plain", "py", "deduped_py", "fx_commits", None)


def _report_columns(block: str) -> str:
    checks = "list_transform(checks, lambda x: x.key || '=' || x.passed)"
    return f"""
SELECT repository, sha, score, grade, passed, minimum_score,
       {_JOIN.format('missing')} AS missing_required_files,
       {_JOIN.format('policy_warnings')} AS policy_warnings, {_JOIN.format(checks)} AS checks
FROM {block}
"""


_query("audit", _report_columns("audit_py_report"))
_query("audit_js", _report_columns("audit_js_report"))
_query("audit_default_policy", _report_columns("audit_plain_report"))

# Commits judged by the policy file they contain.
_BLOCKS["picked_py"] = f"""
SELECT repository, sha,
       array_agg(content ORDER BY lower(path) = {_s(_yaml)}, seq)[1] AS policy_text
FROM fx_policy_files WHERE lower(path) IN ({_s(_yml)}, {_s(_yaml)}) GROUP BY repository, sha
"""
_policy_blocks("own_policy", "picked_py", "repository, sha", "py")
_BLOCKS["own_files"] = """
SELECT repository, sha, path_norm, min(seq) AS seq,
       array_agg(content ORDER BY seq DESC)[1] AS content
FROM (SELECT repository, sha, seq, lower(trim(path, '/')) AS path_norm, content
      FROM (SELECT repository, sha, seq, path, content FROM fx_files
            UNION ALL SELECT repository, sha, seq, path, content FROM fx_policy_files))
GROUP BY repository, sha, path_norm
"""
_audit_blocks(
    "audit_own", "py", "own_files", "fx_commits", "own_policy_typed", ("repository", "sha")
)
_query("audit_commit_policies", _report_columns("audit_own_report"))

# Whole documents as README files.
_BLOCKS["doc_files"] = """
SELECT 'doc/' || source AS repository, doc_id::VARCHAR AS sha, 'readme.md' AS path_norm,
       0::BIGINT AS seq, text AS content
FROM documents
"""
_BLOCKS["doc_policies"] = f"""
SELECT DISTINCT 'doc/' || source AS repository, 80 AS minimum_score,
       []::VARCHAR[] AS disabled_checks, []::VARCHAR[] AS required_files,
       []::VARCHAR[] AS ignore_paths, {_list(fixtures.LONG_TEXT_TERMS)} AS privacy_terms,
       []::VARCHAR[] AS policy_warnings
FROM documents
"""
_audit_blocks("audit_doc", "py", "doc_files", "doc_files", "doc_policies")
_query("audit_documents", _report_columns("audit_doc_report"))

# --- sources and sinks ----------------------------------------------------

_query(
    "scan_checkouts",
    """
SELECT 'doc' || doc_id AS repository, path,
       CASE path WHEN 'README.md' THEN text WHEN 'docs/CodeBook.md' THEN lang END AS content
FROM documents CROSS JOIN
     (VALUES ('README.md'), ('docs/CodeBook.md'), ('src/main.py'),
             ('.github/workflows/ci.yml')) AS files(path)
""",
)

_tree = ", ".join(
    f"{{'path': {path}, 'type': {kind}}}"
    for path, kind in (
        ("'src'", "'tree'"),
        (_pick(fixtures.PATHS, "l_partkey"), "'blob'"),
        (_pick(fixtures.PATHS, "l_suppkey"), "CASE WHEN l_suppkey % 3 = 0 THEN 'tree' ELSE 'blob' END"),
        ("'lib'", "'commit'"),
        (_pick(fixtures.PATHS, "l_orderkey * 7 + l_linenumber * 5"), "'blob'"),
    )
)
_query(
    "tree_blobs",
    f"""
SELECT 'org/repo' || (l_orderkey // 10) AS repository,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 trunc(l_extendedprice)::BIGINT) AS sha,
       i - 1 AS seq, tree[i].path AS path
FROM (SELECT *, [{_tree}] AS tree FROM lineitem WHERE l_partkey % 97 <> 0),
     (SELECT unnest(range(1, 6)) AS i)
WHERE tree[i].type = 'blob'
""",
)

_root_names = ", ".join(_s(n) for n in ("readme.md", "readme.rst", *catalog.POLICY_FILES))
_suffixes = " OR ".join(
    f"ends_with(lower(path), {_s(suffix)})" for suffix in catalog.DICTIONARY_TEXT_SUFFIXES
)
_WANTED = f"(lower(path) IN ({_root_names}) OR {_suffixes})"
_query("select_content_paths", f"SELECT repository, sha, seq, path FROM fx_files WHERE {_WANTED}")
_query(
    "select_content_paths_js",
    f"SELECT repository, sha, seq, path FROM fx_files WHERE lower(path) IN ({_root_names})",
)

_two = (
    f"concat_ws(' ', {_pick(fixtures.PHRASES, 'o_orderkey')},"
    f" {_pick(fixtures.PHRASES, 'o_orderkey + i - 1')}) || ' é'"
)
_BLOCKS["fx_texts"] = f"""
SELECT 'org/repo' || (o_orderkey // 10) AS repository, o_orderkey::VARCHAR AS sha,
       {_list(fixtures.BLOB_PATHS)}[i] AS path,
       o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AS broken,
       CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN ''
            WHEN o_orderkey % 5 = 0 THEN {_two} || chr(65533)
            ELSE {_two} END AS blob_text
FROM orders, (SELECT unnest(range(1, 4)) AS i)
WHERE (o_orderkey + i - 1) % 4 <> 0
"""
_query(
    "attach_content",
    f"""
SELECT f.repository, f.sha, f.seq, f.path,
       CASE WHEN {_WANTED.replace('path', 'f.path')} THEN coalesce(t.blob_text, '') END AS content,
       CASE WHEN {_WANTED.replace('path', 'f.path')} AND t.broken
            THEN 'content is not base64' END AS content_error
FROM (SELECT * REPLACE (CASE WHEN seq % 23 = 0 THEN NULL ELSE path END AS path) FROM fx_files) f
LEFT JOIN fx_texts t USING (repository, sha, path)
""",
)

_json_checks = (
    "list_transform(checks, lambda x: {'key': x.key, 'title': x.title, 'passed': x.passed,"
    " 'points': x.points, 'recommendation': x.recommendation,"
    " 'term_evidence': CASE WHEN x.key IN ('readme', 'provenance', 'privacy', 'ethics')"
    " THEN x.evidence ELSE []::VARCHAR[] END, 'evidence_count': len(x.evidence)})"
)
_query(
    "report_json",
    f"""
SELECT repository, sha,
       to_json({{'repository': repository, 'score': score, 'grade': grade, 'passed': passed,
                'minimum_score': minimum_score, 'missing_required_files': missing,
                'policy_warnings': policy_warnings, 'checks': {_json_checks}}})::VARCHAR AS report
FROM audit_py_report
""",
)

# --- simple path queries --------------------------------------------------

for _name, _d in (("normalize_path", "py"), ("normalize_path_js", "js")):
    _query(_name, f"SELECT repository, sha, seq, path, path_norm FROM norm_{_d}")
for _name, _d in (("dedupe_paths", "py"), ("dedupe_paths_js", "js")):
    _query(_name, f"SELECT repository, sha, seq, path_norm, content FROM deduped_{_d}")
_query(
    "ignore_paths",
    """
SELECT f.repository, f.sha, f.seq, f.path_norm
FROM norm_py f LEFT JOIN policy_py_typed p USING (repository)
WHERE coalesce(len(list_filter(p.ignore_paths,
      lambda i: f.path_norm = i OR starts_with(f.path_norm, i || '/'))), 0) = 0
""",
)
_BLOCKS["fx_urls"] = """
SELECT page_id::VARCHAR AS sha,
       regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path
FROM pages
"""
_query(
    "ignore_paths_urls",
    """
SELECT sha, path_norm FROM (SELECT sha, lower(trim(path, '/')) AS path_norm FROM fx_urls)
WHERE path_norm NOT IN ('de', 'en/5')
  AND NOT starts_with(path_norm, 'de/') AND NOT starts_with(path_norm, 'en/5/')
""",
)
_query(
    "basename",
    f"SELECT sha, path, {_basename(_NORM['py'])} AS basename FROM fx_urls",
)
for _name, _d in (("select_readme", "py"), ("select_readme_js", "js")):
    _query(_name, _readme(f"deduped_{_d}", _d))
_query(
    "basename_in",
    f"""
SELECT DISTINCT repository, sha, path_norm AS path
FROM norm_py WHERE {_basename('path_norm')} IN ({', '.join(map(_s, catalog.LICENSE_NAMES))})
""",
)
_BLOCKS["plain_readme"] = _readme("deduped_py", "py")
_terms = f"coalesce(p.privacy_terms, {_DEFAULTS['privacy_terms']})"
_query(
    "terms_in_text",
    f"""
SELECT r.repository, r.sha, {_JOIN.format(_found(_terms, 'r.readme'))} AS matched
FROM plain_readme r LEFT JOIN policy_py_typed p USING (repository)
""",
)
_long_terms = _list(fixtures.LONG_TEXT_TERMS)
_query(
    "terms_in_documents",
    f"SELECT sha, {_JOIN.format(_found(_long_terms, 'readme'))} AS matched FROM documents_readme",
)

# --- checks and scores ----------------------------------------------------



def _terms_of(key: str) -> str:
    of_readme = key in ("readme", "provenance", "privacy", "ethics")
    return _JOIN.format("c.evidence") if of_readme else "''"


for _key in catalog.CHECK_KEYS:
    _query(
        f"check_{_key}",
        f"""
SELECT repository, sha, c.key AS key, c.passed AS passed, c.points AS points,
       len(c.evidence)::INTEGER AS evidence_count, {_terms_of(_key)} AS term_evidence
FROM audit_py_checks WHERE c.key = {_s(_key)}
""",
    )
_query(
    "check_results_js",
    """
SELECT repository, sha, c.check_ord AS check_ord, c.key AS key, c.title AS title,
       c.passed AS passed, c.points AS points, c.recommendation AS recommendation,
       c.documentation_url AS documentation_url
FROM audit_js_checks
""",
)
_query(
    "file_evidence",
    """
SELECT repository, sha, key, unnest(evidence) AS path
FROM (SELECT repository, sha, c.key AS key, c.evidence AS evidence FROM audit_py_checks)
WHERE key IN ('license', 'citation', 'dependencies', 'reproduction', 'tests', 'data_dictionary')
""",
)
_query(
    "drop_disabled_checks",
    """
SELECT repository, sha, c.key AS key, c.passed AS passed, c.points AS points
FROM audit_py_checks WHERE NOT list_contains(disabled_checks, c.key)
""",
)
for _name, _d in (("score", "py"), ("score_js", "js")):
    _query(_name, f"SELECT repository, sha, earned, possible, score FROM audit_{_d}_report")
_query("grade", "SELECT repository, sha, score, grade FROM audit_py_report")
_query("verdict", "SELECT repository, sha, minimum_score, passed FROM audit_py_report")
_query("audit_summary", "SELECT repository, sha, score, grade, passed FROM audit_py_report")
_query(
    "missing_required_files",
    f"""
SELECT repository, sha, {_JOIN.format('missing')} AS missing_required_files FROM audit_py_report
""",
)

# --- policy queries -------------------------------------------------------

_query("pick_policy_file", "SELECT repository, sha, policy_text FROM picked_py")
_query(
    "pick_policy_file_js",
    f"""
SELECT repository, sha, array_agg(content ORDER BY seq)[1] AS policy_text
FROM fx_policy_files WHERE lower(path) IN ({_s(_yml)}, {_s(_yaml)}) GROUP BY repository, sha
""",
)
_query(
    "pick_policy_file_checkout",
    f"""
SELECT repository, sha, array_agg(content ORDER BY path = {_s(_yaml)}, seq)[1] AS policy_text
FROM fx_policy_files WHERE path IN ({_s(_yml)}, {_s(_yaml)}) AND content IS NOT NULL
GROUP BY repository, sha
""",
)
for _suffix, _d in (("", "py"), ("_js", "js")):
    _parsed, _typed = f"policy_{_d}_parsed", f"policy_{_d}_typed"
    _query(
        f"policy_document_status{_suffix}",
        f"""
SELECT repository, document_kind, {_JOIN.format('document_warnings')} AS warnings FROM {_parsed}
""",
    )
    _query(
        f"validate_minimum_score{_suffix}",
        f"""
SELECT repository, minimum_score, {_JOIN.format('minimum_warnings')} AS warnings FROM {_parsed}
""",
    )
    _columns = ", ".join(
        f"{_JOIN.format(f'{key}_{part}')} AS {key}_{part}"
        for key in ("disabled_checks", "required_files", "ignore_paths", "privacy_terms")
        for part in ("items", "warnings")
    )
    _query(f"validate_string_list{_suffix}", f"SELECT repository, {_columns} FROM {_parsed}")
    _columns = ", ".join(
        f"{_JOIN.format(name)} AS {name}"
        for name in (
            "disabled_checks",
            "required_files",
            "ignore_paths",
            "privacy_terms",
            "policy_warnings",
        )
    )
    _query(
        f"validate_policy{_suffix}", f"SELECT repository, minimum_score, {_columns} FROM {_typed}"
    )
_query(
    "validate_disabled_checks",
    f"""
SELECT repository, {_JOIN.format('disabled_checks')} AS disabled_checks,
       {_JOIN.format('unknown_warnings')} AS unknown_warnings
FROM policy_py_typed
""",
)
_query(
    "clean_policy_paths",
    f"""
SELECT repository, {_JOIN.format('required_files')} AS required_files,
       {_JOIN.format('ignore_paths')} AS ignore_paths
FROM policy_py_typed
""",
)
_query(
    "resolve_privacy_terms",
    f"SELECT repository, {_JOIN.format('privacy_terms')} AS privacy_terms FROM policy_py_typed",
)

# --- events ---------------------------------------------------------------

_KEY = fixtures.SECRET.encode().ljust(64, b"\0")
_IPAD = bytes(b ^ 0x36 for b in _KEY).hex()
_OPAD = bytes(b ^ 0x5C for b in _KEY).hex()
_DIGEST = (
    f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(body))))"
)


def _signed(source: str) -> str:
    return f"""
SELECT *, CASE WHEN event_id % 13 = 0 THEN 'sha256=00' WHEN event_id % 17 = 0 THEN NULL
               WHEN event_id % 19 = 0 THEN digest ELSE 'sha256=' || digest END AS signature
FROM (SELECT *, event_id::VARCHAR AS delivery_id, {_DIGEST} AS digest FROM {source})
"""


_BLOCKS["fx_payloads"] = f"""
SELECT event_id, event_header,
       CASE event_header
         WHEN 'push' THEN '{{"deleted":' || (event_id % 7 = 5) || ',"after":"' || (event_id + 1)
                          || '",' || target || '}}'
         WHEN 'pull_request' THEN
           '{{' || coalesce('"action":"' || {_pick(fixtures.ACTIONS, 'event_id // 7')} || '",', '')
           || '"pull_request":{{"draft":' || (event_id % 7 = 6)
           || CASE WHEN event_id % 29 <> 0 THEN ',"head":{{"sha":"' || (event_id + 1) || '"}}'
                   ELSE '' END || '}},' || target || '}}'
         ELSE '{{"zen":' || event_id || '}}' END
       || CASE WHEN event_id % 31 = 0 THEN '}}' ELSE '' END AS body
FROM (
  SELECT event_id, user_id,
         CASE WHEN event_id % 7 IN (0, 5) THEN 'push'
              WHEN event_id % 7 IN (1, 6) THEN 'pull_request'
              WHEN event_id % 7 = 2 THEN 'ping' WHEN event_id % 7 = 3 THEN 'issues'
         END AS event_header,
         '"installation":{{"id":' || user_id || '}},"repository":{{"full_name":"'
         || CASE WHEN event_id % 23 <> 0 THEN 'org/repo' || ((event_id + 1) // 10) ELSE '' END
         || '"}}' AS target
  FROM events
)
"""
# The doubled braces above belong to the f-string; the text holds single ones.
_BLOCKS["fx_events"] = _signed("fx_payloads")
_BLOCKS["deliveries"] = """
SELECT *, coalesce((doc ->> '$.deleted') = 'true', false) AS deleted,
       doc ->> '$.action' AS action,
       coalesce((doc ->> '$.pull_request.draft') = 'true', false) AS draft,
       nullif((doc ->> '$.installation.id')::BIGINT, 0) AS installation_id,
       nullif(doc ->> '$.repository.full_name', '') AS repository,
       CASE WHEN event_header = 'pull_request' THEN doc ->> '$.pull_request.head.sha'
            ELSE doc ->> '$.after' END AS head_sha
FROM (
  SELECT *, CASE WHEN valid AND event_header IN ('push', 'pull_request') AND json_valid(body)
                 THEN body::JSON END AS doc
  FROM (SELECT *, coalesce(signature = 'sha256=' || digest, false) AS valid FROM fx_events)
)
"""
_query(
    "raw_event_source", "SELECT delivery_id, event_header, signature, body FROM fx_events"
)
_query(
    "signature_valid",
    "SELECT delivery_id, signature, valid AS signature_valid FROM deliveries",
)
for _suffix, _header in (("", "coalesce(event_header, 'unknown')"), ("_js", "event_header")):
    _query(
        f"route_event{_suffix}",
        f"""
SELECT delivery_id,
       CASE WHEN event_header = 'ping' THEN 'pong'
            WHEN event_header IN ('push', 'pull_request') THEN 'audited'
            ELSE 'ignored' END AS route,
       CASE WHEN event_header IN ('ping', 'push', 'pull_request') THEN NULL
            ELSE {_header} END AS event
FROM fx_events
""",
    )
    _query(
        f"event_status{_suffix}",
        f"""
SELECT delivery_id, status, event,
       CASE WHEN status = 'accepted' THEN installation_id END AS installation_id,
       CASE WHEN status = 'accepted' THEN repository END AS repository,
       CASE WHEN status = 'accepted' THEN head_sha END AS head_sha
FROM (
  SELECT *, CASE WHEN event LIKE 'pong%' THEN 'pong' WHEN event IS NOT NULL THEN 'ignored'
                 ELSE outcome END AS status
  FROM (SELECT * REPLACE (CASE WHEN outcome = 'ignored' THEN event END AS event) FROM (
    SELECT *,
      CASE WHEN NOT valid THEN 'rejected' WHEN event_header = 'ping' THEN 'pong'
           WHEN event_header IS NULL OR event_header = 'issues' THEN 'ignored'
           WHEN doc IS NULL THEN 'invalid'
           WHEN event_header = 'push' AND deleted THEN 'ignored'
           WHEN event_header = 'pull_request' AND (action IS NULL OR action = 'closed' OR draft)
             THEN 'ignored'
           WHEN installation_id IS NULL OR repository IS NULL OR head_sha IS NULL THEN 'invalid'
           ELSE 'accepted' END AS outcome,
      CASE WHEN event_header IS NULL OR event_header = 'issues' THEN {_header}
           WHEN event_header = 'push' THEN 'deleted-ref'
           WHEN action IS NULL THEN 'pull_request.unknown'
           WHEN action = 'closed' THEN 'pull_request.closed'
           ELSE 'draft-pull-request' END AS event
    FROM deliveries))
)
""".replace(
            """CASE WHEN event LIKE 'pong%' THEN 'pong' WHEN event IS NOT NULL THEN 'ignored'
                 ELSE outcome END AS status""",
            "outcome AS status",
        ),
    )
_query(
    "drop_deleted_ref",
    """
SELECT delivery_id, event_header FROM deliveries
WHERE doc IS NOT NULL AND NOT (event_header = 'push' AND event_id % 7 = 5)
""",
)
_query(
    "pull_request_action_filter",
    """
SELECT delivery_id, event_header, action FROM deliveries
WHERE doc IS NOT NULL AND (event_header = 'push'
      OR action IN ('opened', 'reopened', 'synchronize', 'ready_for_review'))
""",
)
_query(
    "drop_draft",
    """
SELECT delivery_id, event_header FROM deliveries WHERE doc IS NOT NULL AND event_id % 7 <> 6
""",
)
_query(
    "audit_target",
    """
SELECT delivery_id, installation_id, repository, head_sha,
       installation_id IS NOT NULL AND repository IS NOT NULL AND head_sha IS NOT NULL
         AS target_valid
FROM deliveries WHERE doc IS NOT NULL
""",
)

_BLOCKS["fx_market_payloads"] = """
SELECT event_id,
       CASE event_id % 5 WHEN 0 THEN 'ping' WHEN 1 THEN 'push'
            ELSE 'marketplace_purchase' END AS event_header,
       '{' || CASE WHEN event_id % 3 = 0 THEN '"action":"purchased",' ELSE '' END
       || '"marketplace_purchase":{'
       || CASE event_id % 5
            WHEN 2 THEN '"account":{"login":"user' || user_id || '"},"plan":{"name":"basic"}'
            WHEN 3 THEN '"account":{"login":"user' || user_id || '"}'
            ELSE '"plan":{"name":null}' END || '}}' AS body,
       user_id
FROM events
"""
_BLOCKS["fx_market"] = _signed("fx_market_payloads")
_query(
    "route_marketplace",
    """
SELECT delivery_id, status, CASE WHEN status = 'ignored' THEN 'push' END AS event,
       CASE WHEN status = 'accepted' THEN
         CASE WHEN event_id % 3 = 0 THEN 'purchased' ELSE 'unknown' END END AS action,
       CASE WHEN status = 'accepted' THEN
         CASE WHEN event_id % 5 IN (2, 3) THEN 'user' || user_id ELSE 'unknown' END END AS account,
       CASE WHEN status = 'accepted' THEN
         CASE WHEN event_id % 5 = 2 THEN 'basic' ELSE 'unknown' END END AS plan
FROM (
  SELECT *, CASE WHEN signature IS NULL OR signature <> 'sha256=' || digest THEN 'rejected'
                 WHEN event_header = 'ping' THEN 'pong' WHEN event_header = 'push' THEN 'ignored'
                 ELSE 'accepted' END AS status
  FROM fx_market
)
""",
)

# --- publishing -----------------------------------------------------------


def _markdown(block: str, dialect: str) -> None:
    link = " || ' [Guidance](' || x.documentation_url || ')'" if dialect == "js" else ""
    step = f"lambda x: '- **' || x.title || ':** ' || x.recommendation{link}"
    steps = f"list_transform(list_filter(checks, lambda x: NOT x.passed), {step})"
    row = (
        "lambda x: '| ' || x.title || ' | ' || CASE WHEN x.passed THEN"
        f" {_s(catalog.PASS_LABEL)} ELSE {_s(catalog.FAIL_LABEL)} END || ' | '"
        " || CASE WHEN x.passed THEN x.points ELSE 0 END || '/' || x.points || ' |'"
    )
    _BLOCKS[f"{block}_text"] = f"""
SELECT repository, sha, score, grade, passed, checks, next_steps,
       array_to_string([
         '## {catalog.REPORT_TITLE}: ' || score || '/100 (' || grade || ')', '',
         'Policy threshold: **' || minimum_score || '/100** · Result: **'
           || CASE WHEN passed THEN 'Pass' ELSE 'Needs work' END || '**', '',
         '| Check | Result | Points |', '|---|---:|---:|',
         array_to_string(list_transform(checks, {row}), chr(10)), '',
         '### Required files', '',
         CASE WHEN len(missing) = 0 THEN {_s(catalog.ALL_FILES_PRESENT)} ELSE
           array_to_string(list_transform(missing,
             lambda m: '- Missing required file: `' || m || '`'), chr(10)) END, '',
         '### Recommended next steps', '', next_steps
           || CASE WHEN len(policy_warnings) = 0 THEN '' ELSE
                chr(10) || chr(10) || '### Policy warnings' || chr(10) || chr(10)
                || array_to_string(list_transform(policy_warnings, lambda w: '- ' || w), chr(10))
              END, '',
         {_s(catalog.DISCLAIMER)}], chr(10)) AS markdown
FROM (SELECT *, CASE WHEN len({steps}) = 0 THEN {_s(catalog.ALL_CHECKS_PASSED)}
                     ELSE array_to_string({steps}, chr(10)) END AS next_steps
      FROM {block}_report)
"""


_markdown("audit_py", "py")
_markdown("audit_js", "js")
_RUN = f"""
SELECT repository, sha AS head_sha, '{catalog.REPORT_TITLE}' AS name, 'completed' AS status,
       CASE WHEN passed THEN 'success' ELSE 'failure' END AS conclusion,
       'Quality score: ' || score || '/100 (' || grade || ')' AS title, markdown AS summary
FROM audit_py_text
"""
_query("check_run", _RUN)
_RERUN = "CASE WHEN sha::BIGINT % 2 = 0 THEN 'rerun' ELSE 'completed' END AS status"
_SUNK = _RUN.replace("'completed' AS status", _RERUN)
_query("check_run_sink", _SUNK)
_query("report_markdown", "SELECT repository, sha, markdown FROM audit_py_text")
_query("report_markdown_js", "SELECT repository, sha, markdown FROM audit_js_text")
_query("next_steps", "SELECT repository, sha, next_steps FROM audit_py_text")
_query("next_steps_js", "SELECT repository, sha, next_steps FROM audit_js_text")

_BLOCKS["previous"] = """
SELECT c.repository, c.sha, p.score AS previous_score
FROM fx_commits c
LEFT JOIN (SELECT * FROM audit_js_report WHERE sha::BIGINT % 3 <> 0) p
  ON p.repository = c.repository AND p.sha = c.parent_sha
"""
_query("previous_score", "SELECT repository, sha, previous_score FROM previous")
_BLOCKS["score_changes"] = f"""
SELECT r.*, CASE WHEN p.previous_score IS NULL THEN chr(10) || chr(10) ||
         'Previous audited commit: **not available**'
       ELSE chr(10) || chr(10) || 'Score change from previous audited commit: **'
         || CASE WHEN r.score >= p.previous_score THEN '+' ELSE '' END
         || (r.score - p.previous_score) || '** (' || p.previous_score || ' → ' || r.score || ')'
       END AS score_change
FROM audit_js_text r JOIN previous p USING (repository, sha)
"""
_query("score_delta", "SELECT repository, sha, score_change FROM score_changes")
_BLOCKS["note_paths"] = """
SELECT repository, sha,
       array_agg(path ORDER BY lower(path) NOT IN ('readme.md', 'readme.rst'), seq)[1] AS note_path
FROM fx_files GROUP BY repository, sha
"""
_BLOCKS["annotation_rows"] = """
SELECT r.repository, r.sha, n.note_path, r.title, r.recommendation, r.documentation_url, r.ord
FROM (SELECT repository, sha, c.title AS title, c.recommendation AS recommendation,
             c.documentation_url AS documentation_url, c.check_ord AS ord
      FROM audit_js_checks WHERE NOT c.passed AND NOT list_contains(disabled_checks, c.key)) r
JOIN note_paths n USING (repository, sha)
"""
_query(
    "annotations",
    """
SELECT repository, sha, note_path AS path, 1 AS start_line, 1 AS end_line,
       'warning' AS annotation_level, title, recommendation AS message,
       documentation_url AS raw_details
FROM annotation_rows
""",
)
_query(
    "check_run_js",
    """
SELECT c.repository, c.sha AS head_sha,
       CASE WHEN c.passed THEN 'success' ELSE 'failure' END AS conclusion,
       'Quality score: ' || c.score || '/100 (' || c.grade || ')' AS title,
       c.markdown || c.score_change AS summary, coalesce(n.annotations, '') AS annotations
FROM score_changes c LEFT JOIN (
  SELECT repository, sha, string_agg(note_path || ':' || title, ' | ' ORDER BY ord) AS annotations
  FROM annotation_rows GROUP BY repository, sha
) n USING (repository, sha)
""",
)

# Check runs of the commits that accepted deliveries point to.
_BLOCKS["targets"] = """
SELECT DISTINCT repository, head_sha AS sha FROM deliveries
WHERE doc IS NOT NULL AND installation_id IS NOT NULL AND repository IS NOT NULL
  AND head_sha IS NOT NULL AND NOT (event_header = 'push' AND deleted)
  AND (event_header = 'push' OR (NOT draft AND
       action IN ('opened', 'reopened', 'synchronize', 'ready_for_review')))
"""
_audit_blocks("audit_live", "py", "deduped_py", "targets", "policy_py_typed")
_markdown("audit_live", "py")
_query("stream_audit", _RUN.replace("audit_py_text", "audit_live_text"))

# --- fleet ----------------------------------------------------------------

_BLOCKS["listed"] = """
SELECT c_custkey + 1 AS installation_id, 'org/repo' || c_custkey AS full_name
FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL
SELECT c_custkey + 1, 'org/repo' || (c_custkey // 2 * 2) FROM customer
"""
_query(
    "public_repositories",
    """
SELECT installation_id, full_name, 'main' AS default_branch,
       'https://git.example/' || full_name AS html_url
FROM listed
""",
)
_query(
    "repository_listing",
    """
SELECT full_name, 'main' AS default_branch, 'https://git.example/' || full_name AS html_url
FROM listed
""",
)
_query(
    "resolve_audit_request",
    f"""
SELECT q.request_id, q.repository, p.installation_id, h.sha,
       CASE WHEN q.repository IS NULL OR q.repository = '' THEN 'Repository is required'
            WHEN p.installation_id IS NULL THEN 'Repository is not a public App installation'
            ELSE 'ready' END AS status
FROM (
  SELECT event_id AS request_id,
         CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN NULL
              WHEN 2 THEN 'other/repo' || event_id ELSE 'org/repo' || user_id END AS repository
  FROM events
) q
LEFT JOIN (SELECT full_name, min(installation_id) AS installation_id FROM listed GROUP BY full_name) p
  ON p.full_name = q.repository
LEFT JOIN (SELECT 'org/repo' || (o_orderkey // 10) AS repository, max(o_orderkey)::VARCHAR AS sha
           FROM orders GROUP BY ALL) h
  ON h.repository = p.full_name
""",
)
