"""Operators on file inventories: one row per file of a commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions import paths, strings
from auditlake.functions.automaton import with_places
from auditlake.functions.literals import one_of, text, texts
from auditlake.operators.lookup import lookup

COMMIT = ["repository", "sha"]


def tree_blobs(trees: DataFrame) -> DataFrame:
    """File rows of tree snapshots; ``seq`` is the position in the tree."""
    return (
        trees.selectExpr(*COMMIT, "posexplode(tree) AS (seq, entry)")
        .filter("entry.type = 'blob'")
        .selectExpr(*COMMIT, "CAST(seq AS BIGINT) AS seq", "entry.path AS path")
    )


def select_content_paths(
    files: DataFrame,
    dialect: str = "py",
    policy_files: tuple[str, ...] = catalog.POLICY_FILES,
) -> DataFrame:
    """The files whose text has to be fetched."""
    return files.filter(paths.needs_content("path", dialect, policy_files))


def attach_content(
    files: DataFrame,
    blobs: DataFrame,
    dialect: str = "py",
    policy_files: tuple[str, ...] = catalog.POLICY_FILES,
) -> DataFrame:
    """Adds ``content``: decoded text for selected files, NULL for all others.

    Invalid UTF-8 is replaced; a selected file without content gets '', and so
    does one whose content is not base64, with ``content_error`` set.  Files
    that are not selected carry a NULL key into the join, which a salt of the
    path spreads over all tasks, so the table is read once.  Blobs of paths that no file is selected by are dropped where
    they are read, before anything of them is decoded.
    """
    selected = paths.needs_content("path", dialect, policy_files)
    wanted = f"coalesce({selected}, false)"
    columns = [*COMMIT, "seq", "path"]
    # Line breaks are part of the transport encoding.
    packed = r"regexp_replace(content_base64, '[\\r\\n]', '')"
    texts_ = blobs.filter(selected).selectExpr(
        *COMMIT,
        "path",
        "content_base64 IS NOT NULL AS _loaded",
        f"try_to_binary({packed}, 'base64') AS _bytes",
        "0 AS _salt",
    )
    keyed = files.selectExpr(
        *columns,
        f"{wanted} AS _wanted",
        f"IF({wanted}, 0, 1 + CAST(pmod(xxhash64(path, seq), 1024) AS INT)) AS _salt",
    )
    broken = "_wanted AND coalesce(_loaded, false) AND _bytes IS NULL"
    decoded = "coalesce(make_valid_utf8(CAST(_bytes AS STRING)), '')"
    return keyed.join(texts_, [*COMMIT, "path", "_salt"], "left").selectExpr(
        *columns,
        f"IF(_wanted, {decoded}, NULL) AS content",
        f"IF({broken}, 'content is not base64', NULL) AS content_error",
    )


def normalised(files: DataFrame, dialect: str = "py") -> DataFrame:
    """Adds ``path_norm``."""
    return files.selectExpr("*", f"{paths.normalize_path('path', dialect)} AS path_norm")


def dedupe_paths(files: DataFrame, dialect: str = "py") -> DataFrame:
    """One row per normalised path: the last content at the first position.

    Grouping by the path as well spreads a commit of any size over all tasks. Texts are aggregated by sorting, which compares
    the first bytes first: those of the sha tell most rows apart, those of the repository hardly any.
    """
    return (
        normalised(files, dialect)
        .groupBy("sha", "path_norm", "repository")
        .agg(F.min("seq").alias("first_seq"), F.max_by("content", "seq").alias("content"))
        .selectExpr(*COMMIT, "first_seq AS seq", "path_norm", "content")
    )


def policy_keys(policies: DataFrame) -> list[str]:
    """Policies hold for a repository, or for one commit if they have a sha."""
    return COMMIT if "sha" in policies.columns else ["repository"]


@dataclass(frozen=True)
class ListSizes:
    """What the lists of a policy table need, asked of the table once, before a plan is made."""

    ignoring: bool  # some policy ignores paths
    long_ignore: bool  # some list of ignored paths is too long to be walked by every file
    long_required: bool
    own_terms: bool  # some policy has privacy terms of its own
    long_terms: bool


def list_sizes(policies: DataFrame) -> ListSizes:
    """One aggregation of the policy table; four flags come to the driver."""
    defaults = texts(catalog.DEFAULT_PRIVACY_TERMS)
    conditions = {
        "ignoring": "size(ignore_paths) > 0",
        "long_ignore": f"NOT {strings.is_short('ignore_paths')}",
        "long_required": f"NOT {strings.is_short('required_files')}",
        "own_terms": f"privacy_terms <> {defaults}",
        "long_terms": f"NOT {strings.is_short('privacy_terms')}",
    }
    known = {name: c for name, c in conditions.items() if any(column in c for column in policies.columns)}
    flags = [F.expr(f"coalesce(bool_or({c}), false) AS {name}") for name, c in known.items()]
    return ListSizes(**{name: False for name in conditions} | policies.agg(*flags).first().asDict())


def without_prefixes(rows: DataFrame, prefixes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``path_norm`` neither is one of the prefixes (``keys, prefix``) nor lies below one.

    A path has as many own prefixes as segments; these meet the table by hash, so the cost doesn't
    depend on how many prefixes there are. Equal paths meet it once.
    """
    own = rows.select(*keys, "path_norm").distinct()
    own = own.selectExpr(*keys, "path_norm", f"explode({paths.own_prefixes('path_norm')}) AS prefix")
    ignored = own.join(prefixes, [*keys, "prefix"], "left_semi").select(*keys, "path_norm").distinct()
    return rows.join(ignored, [*keys, "path_norm"], "left_anti")


def unignored(
    rows: DataFrame, policies: DataFrame, sizes: ListSizes, carried: dict[str, str] | None = None
) -> DataFrame:
    """Rows (with ``path_norm``) that no ignored path of the policy covers, with further columns of the policy
    (``carried``: name and expression; NULL where there is no policy).

    One lookup brings all, of the policies that ignore or carry something. Short lists are walked in the row; rows under longer ones take the way of ``without_prefixes``.
    """
    carried = carried or {}
    if not sizes.ignoring and not carried:
        return rows
    keys, short, names = policy_keys(policies), strings.is_short("ignore_paths"), [*rows.columns, *carried]
    asked = ["size(ignore_paths) > 0", *(f"({value}) IS NOT NULL" for value in carried.values())]
    wanted = policies.filter(" OR ".join(asked))
    table = wanted.selectExpr(
        *keys,
        *(f"{value} AS {name}" for name, value in carried.items()),
        f"IF({short}, ignore_paths, NULL) AS _ignored",
        f"NOT {short} AS _long",
    )
    joined = lookup(rows, table, keys, ["path_norm"], scanned=True)
    kept = joined.filter(f"NOT {paths.is_ignored('path_norm', '_ignored')}") if sizes.ignoring else joined
    if not sizes.long_ignore:
        return kept.select(names)
    prefixes = policies.filter(f"NOT {short}").selectExpr(*keys, "explode(ignore_paths) AS prefix").distinct()
    rest = without_prefixes(joined.filter("_long").select(names), prefixes, keys)
    return kept.filter("NOT coalesce(_long, false)").select(names).unionByName(rest)


def drop_ignored(files: DataFrame, policies: DataFrame) -> DataFrame:
    """Files (with ``path_norm``) that no ignored path of the policy covers, with any number of ignored paths."""
    return unignored(files, policies, list_sizes(policies))


def named_files(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Distinct normalised paths whose last segment is one of the names."""
    return (
        files.filter(one_of(paths.basename("path_norm"), names))
        .selectExpr(*COMMIT, "path_norm AS path")
        .distinct()
    )


def readme_aggregates(*values: str, path: str = "path_norm", last: bool = False) -> list[Column]:
    """Aggregates that keep, for both root README names, the first position and the last of each value
    (``md_seq``, ``md_<value>``, ``rst_seq``, ...), with ``last`` also the last position (``md_last``, ``rst_last``)."""
    columns = []
    for short, name in (("md", catalog.README_MD), ("rst", catalog.README_RST)):
        seq = f"IF({path} = {text(name)}, seq, NULL)"
        columns += [F.expr(f"min({seq}) AS {short}_seq")]
        columns += [F.expr(f"max({seq}) AS {short}_last")] if last else []
        columns += [F.expr(f"max_by({value}, {seq}) AS {short}_{value}") for value in values]
    return columns


def pick_readme(value: str, dialect: str = "py") -> str:
    """Chooses between the two values of ``readme_aggregates``.

    py takes the README that comes first, js prefers Markdown and falls back
    only when that is missing or NULL.  NULL means there is no README text.
    """
    if catalog.require_dialect(dialect) == "js":
        return f"coalesce(md_{value}, rst_{value})"
    return f"IF(rst_seq IS NULL OR md_seq < rst_seq, md_{value}, rst_{value})"


def pick_readme_seq(value: str, dialect: str = "py") -> str:
    """Position of the row that ``pick_readme`` takes its value from."""
    if catalog.require_dialect(dialect) == "js":
        return f"IF(md_{value} IS NOT NULL, md_last, rst_last)"
    return "IF(rst_seq IS NULL OR md_seq < rst_seq, md_last, rst_last)"


def select_readme(files: DataFrame, dialect: str = "py") -> DataFrame:
    """Lowercased text of the chosen root README of each commit that has one.

    ``files`` holds raw paths; the filter keeps two paths per commit before
    anything is grouped.
    """
    return (
        normalised(files, dialect)
        .filter(paths.is_root_readme("path_norm"))
        .groupBy(*COMMIT)
        .agg(*readme_aggregates("content"))
        .selectExpr(*COMMIT, f"lower(coalesce({pick_readme('content', dialect)}, '')) AS readme")
    )


def readme_terms(readmes: DataFrame, terms: str | tuple[str, ...]) -> DataFrame:
    """Adds ``matched``: the terms found in the README text, in term order.

    ``terms`` is the name of an array column or a fixed tuple of terms. A fixed tuple of many terms is looked for in one
    pass over each text.
    """
    if not isinstance(terms, str) and len(terms) > strings.SHORT_LIST:
        staged = readmes.selectExpr("*", "readme AS _text", f"{texts(terms)} AS _terms")
        placed = with_places(staged, "_text", "_terms", "_found")
        return placed.selectExpr(*readmes.columns, f"{strings.items_at(texts(terms), '_found')} AS matched")
    terms = terms if isinstance(terms, str) else texts(terms)
    return readmes.selectExpr("*", f"{strings.matched_terms('readme', terms)} AS matched")
