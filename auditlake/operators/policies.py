"""Policy operators.

A policy document is parsed once into a VARIANT; every rule is an expression on
that value, so validation is a chain of projections without any shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions.documents import with_document
from auditlake.functions.literals import one_of, text, texts
from auditlake.functions.paths import normalize_path
from auditlake.functions.strings import strip
from auditlake.operators.files import COMMIT, policy_keys
from auditlake.operators.lookup import lookup
from auditlake.session import kept

# Kinds of policy documents.
ABSENT, EMPTY, UNPARSABLE, NOT_OBJECT, OBJECT = (
    "absent",
    "empty",
    "unparsable",
    "not_object",
    "object",
)
LIST_FIELDS = ("disabled_checks", "required_files", "ignore_paths", "privacy_terms")
NO_TEXTS = texts(())


def default_policy() -> dict[str, str]:
    """The policy that holds where there is none: column name to expression."""
    return {
        "minimum_score": str(catalog.DEFAULT_MINIMUM_SCORE),
        "disabled_checks": NO_TEXTS,
        "required_files": NO_TEXTS,
        "ignore_paths": NO_TEXTS,
        "privacy_terms": texts(catalog.DEFAULT_PRIVACY_TERMS),
        "policy_warnings": NO_TEXTS,
    }


def pick_policy(
    files: DataFrame,
    dialect: str = "py",
    policy_files: tuple[str, ...] = catalog.POLICY_FILES,
    exact_case: bool = False,
) -> DataFrame:
    """Policy text and path of each commit that has a root policy file.

    py takes the names in the order of ``policy_files``; js takes the first
    match in tree order.  ``exact_case`` is the rule for local checkouts: only
    the lowercase names count, and a name without text is passed over.
    """
    name = "path" if exact_case else "lower(path)"
    condition = one_of(name, policy_files)
    if exact_case:
        condition += " AND content IS NOT NULL"
    by_tree_order = catalog.require_dialect(dialect) == "js" and not exact_case
    rank = "0" if by_tree_order else f"array_position({texts(policy_files)}, {name})"
    return (
        files.filter(condition)
        .selectExpr("repository", "sha", "path", "content", f"struct({rank} AS rank, seq) AS position")
        .groupBy("sha", "repository")  # the first bytes of a sha tell more rows apart where they are sorted
        .agg(
            F.min_by("content", "position").alias("policy_text"),
            F.min_by("path", "position").alias("policy_path"),
        )
        .select(*COMMIT, "policy_text", "policy_path")
    )


def _policy_columns(raw: DataFrame) -> list[str]:
    return [name for name in raw.columns if name not in ("policy_text", "policy_path")]


def _with_document(raw: DataFrame) -> DataFrame:
    """Adds ``_doc`` (parsed document) and ``document_kind``."""
    if "policy_path" not in raw.columns:
        raw = raw.selectExpr("*", "CAST(NULL AS STRING) AS policy_path")
    kind = (
        f"CASE WHEN policy_text IS NULL THEN '{ABSENT}'"
        f" WHEN {strip('policy_text', 'js')} = '' THEN '{EMPTY}'"
        f" WHEN _doc IS NULL THEN '{UNPARSABLE}'"
        f" WHEN is_variant_null(_doc) THEN '{EMPTY}'"
        f" WHEN startswith(schema_of_variant(_doc), 'OBJECT') THEN '{OBJECT}'"
        f" ELSE '{NOT_OBJECT}' END"
    )
    return with_document(raw, "policy_text", "_doc").selectExpr("*", f"{kind} AS document_kind")


def _document_warnings(dialect: str) -> str:
    bad_kinds = [NOT_OBJECT] if catalog.require_dialect(dialect) == "py" else [NOT_OBJECT, EMPTY]
    unparsable = texts([catalog.WARN_UNPARSABLE])
    if dialect == "js":
        before, after = catalog.WARN_UNPARSABLE_JS.split("{path}")
        named = f"concat({text(before)}, policy_path, {text(after)})"
        unparsable = f"array(coalesce({named}, {text(catalog.WARN_UNPARSABLE)}))"
    return (
        f"CASE WHEN document_kind = '{UNPARSABLE}' THEN {unparsable}"
        f" WHEN {one_of('document_kind', bad_kinds)} THEN {texts([catalog.WARN_NOT_OBJECT])}"
        f" ELSE {NO_TEXTS} END"
    )


def policy_document_status(raw: DataFrame, dialect: str = "py") -> DataFrame:
    """Adds ``document_kind`` and the warnings about the document as a whole."""
    return (
        _with_document(raw)
        .selectExpr("*", f"{_document_warnings(dialect)} AS document_warnings")
        .drop("_doc", "policy_path")
    )


def minimum_score(documents: DataFrame, dialect: str = "py") -> DataFrame:
    """Adds ``minimum_score`` and ``minimum_score_warnings`` from ``_doc``.

    py wants an integer literal; js takes any number without a fraction.
    """
    value = "try_variant_get(_doc, '$.minimum_score', 'variant')"
    if catalog.require_dialect(dialect) == "py":
        typed = "_kind = 'BIGINT'"
    else:
        numeric = "_kind IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith(_kind, 'DECIMAL')"
        typed = f"({numeric}) AND _number = floor(_number)"
    staged = documents.selectExpr(
        "*",
        f"schema_of_variant({value}) AS _kind",
        "try_variant_get(_doc, '$.minimum_score', 'double') AS _number",
    ).selectExpr("*", f"coalesce({typed} AND _number BETWEEN 0 AND 100, false) AS _valid")
    warning = texts([catalog.WARN_MINIMUM_SCORE])
    return staged.selectExpr(
        "*",
        f"IF(_valid, CAST(_number AS INT), {catalog.DEFAULT_MINIMUM_SCORE}) AS minimum_score",
        f"IF(_kind IS NOT NULL AND NOT _valid, {warning}, {NO_TEXTS}) AS minimum_score_warnings",
    ).drop("_kind", "_number", "_valid")


def string_lists(
    documents: DataFrame,
    dialect: str = "py",
    keys: tuple[str, ...] = LIST_FIELDS,
    list_limit: int | None = None,
) -> DataFrame:
    """Adds, for each list field of ``_doc``, ``<key>_items`` (usable strings)
    and ``<key>_warnings`` (about the rest).

    All entries are kept.  With a ``list_limit``, py looks at so many entries
    only, and js keeps so many usable ones.
    """
    is_py = catalog.require_dialect(dialect) == "py"
    raw, usable, final = [], [], []
    for key in keys:
        entries = f"try_variant_get(_doc, '$.{key}', 'array<variant>')"
        entries = f"slice({entries}, 1, {list_limit})" if is_py and list_limit else entries
        kind = f"schema_of_variant(try_variant_get(_doc, '$.{key}', 'variant'))"
        raw += [f"{entries} AS {key}_entries", f"{kind} AS {key}_kind"]
        as_text = (
            f"transform({key}_entries, entry ->"
            " IF(schema_of_variant(entry) = 'STRING', CAST(entry AS STRING), NULL))"
        )
        kept = f"filter({as_text}, value -> coalesce({strip('value', dialect)} <> '', false))"
        usable.append(f"{kept} AS {key}_usable")
        is_list = f"startswith({key}_kind, 'ARRAY')"
        items = f"{key}_usable"
        items = f"slice({items}, 1, {list_limit})" if list_limit and not is_py else items
        dropped = f"size({key}_entries) - size({key}_usable)"
        bad_item = text(catalog.WARN_BAD_ITEM.format(key=key))
        not_list = texts([catalog.WARN_NOT_LIST.format(key=key)])
        final += [
            f"IF({is_list}, {items}, {NO_TEXTS}) AS {key}_items",
            f"CASE WHEN {is_list} THEN array_repeat({bad_item}, {dropped})"
            f" WHEN {key}_kind IS NOT NULL THEN {not_list} ELSE {NO_TEXTS} END AS {key}_warnings",
        ]
    names = documents.columns
    staged = documents.selectExpr("*", *raw).selectExpr("*", *usable)
    return staged.selectExpr(*names, *final)


def known_checks(items: str) -> str:
    """Known check keys without repetition, first occurrence kept."""
    return f"array_distinct(filter({items}, key -> {one_of('key', catalog.CHECK_KEYS)}))"


def unknown_check_warnings(items: str) -> str:
    """One warning per unknown check key."""
    before, after = catalog.WARN_UNKNOWN_CHECK.split("{key}")
    unknown = f"filter({items}, key -> NOT {one_of('key', catalog.CHECK_KEYS)})"
    return f"transform({unknown}, key -> concat({text(before)}, key, {text(after)}))"


def clean_paths(items: str, dialect: str = "py") -> str:
    """Trimmed, slash-stripped, lowercased paths without repetition."""
    cleaned = normalize_path(strip("value", dialect), "py")
    return f"array_distinct(transform({items}, value -> {cleaned}))"


def privacy_terms(items: str, dialect: str = "py") -> str:
    """Configured terms replace the defaults; an empty list keeps them."""
    cleaned = f"array_distinct(transform({items}, value -> lower({strip('value', dialect)})))"
    return f"IF(size({items}) > 0, {cleaned}, {texts(catalog.DEFAULT_PRIVACY_TERMS)})"


def parse_policies(
    raw: DataFrame, dialect: str = "py", list_limit: int | None = None
) -> DataFrame:
    """Raw fields of each policy document: minimum score, the items of every
    list field, and their warnings."""
    documents = _with_document(raw).selectExpr(
        *_policy_columns(raw),
        f"{_document_warnings(dialect)} AS document_warnings",
        f"IF(document_kind = '{OBJECT}', _doc, NULL) AS _doc",
    )
    return string_lists(minimum_score(documents, dialect), dialect, list_limit=list_limit).drop("_doc")


def validate_policies(
    raw: DataFrame, dialect: str = "py", list_limit: int | None = None
) -> DataFrame:
    """Typed policies from ``policy_text`` (JSON), one row per input row.

    Invalid values fall back to the defaults and leave a warning, in the order
    minimum score, disabled checks, required files, ignored paths, privacy
    terms.
    """
    warnings = ", ".join(
        [
            "document_warnings",
            "minimum_score_warnings",
            "disabled_checks_warnings",
            unknown_check_warnings("disabled_checks_items"),
            *[f"{key}_warnings" for key in LIST_FIELDS[1:]],
        ]
    )
    return parse_policies(raw, dialect, list_limit).selectExpr(
        *_policy_columns(raw),
        "minimum_score",
        f"{known_checks('disabled_checks_items')} AS disabled_checks",
        f"{clean_paths('required_files_items', dialect)} AS required_files",
        f"{clean_paths('ignore_paths_items', dialect)} AS ignore_paths",
        f"{privacy_terms('privacy_terms_items', dialect)} AS privacy_terms",
        f"concat({warnings}) AS policy_warnings",
    )


def policy_table(
    raw: DataFrame, dialect: str = "py", list_limit: int | None = None
) -> DataFrame:
    """Typed policies as a table: picked, parsed and validated once, and kept in the shared folder.

    An audit meets its policies up to five times; each of these reads the columns it needs from here.
    """
    return kept(validate_policies(raw, dialect, list_limit))


def with_policy(
    rows: DataFrame,
    policies: DataFrame | None,
    spread_on: list[str],
    fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """Adds policy columns of each row's repository; defaults where it has none."""
    defaults = default_policy()
    fields = fields or tuple(defaults)
    if policies is None:
        return rows.selectExpr("*", *[f"{defaults[name]} AS {name}" for name in fields])
    keys = policy_keys(policies)
    # What a policy leaves at its default comes back from the defaults, and is not sent.
    own = [f"IF({name} <=> {defaults[name]}, NULL, {name}) AS {name}" for name in fields]
    joined = lookup(rows, policies.selectExpr(*keys, *own), keys, spread_on)
    return joined.selectExpr(
        *rows.columns, *[f"coalesce({name}, {defaults[name]}) AS {name}" for name in fields]
    )
