"""Path expressions."""

from __future__ import annotations

from auditlake import catalog
from auditlake.functions.literals import any_of, one_of, text
from auditlake.functions.strings import strip


def normalize_path(path: str, dialect: str = "py") -> str:
    """Lowercased path without outer slashes; js also drops outer whitespace."""
    if catalog.require_dialect(dialect) == "js":
        path = strip(path, "js")
    return f"lower(btrim({path}, '/'))"


def basename(path: str) -> str:
    """Text after the last slash."""
    return f"substring_index({path}, '/', -1)"


def is_test_path(path: str) -> str:
    """Whether a normalised path lies in one of the root test or CI folders."""
    return any_of(f"startswith({path}, {text(prefix)})" for prefix in catalog.TEST_PREFIXES)


def is_root_readme(path: str) -> str:
    return one_of(path, (catalog.README_MD, catalog.README_RST))


def is_ignored(path: str, ignore_paths: str) -> str:
    """Whether a normalised path is an ignored path or lies below one."""
    below = f"startswith({path}, concat(prefix, '/'))"
    hit = f"exists({ignore_paths}, prefix -> {path} = prefix OR {below})"
    # Most lists are empty: the size is checked before the list is walked.
    return f"coalesce(size({ignore_paths}) > 0 AND {hit}, false)"


def own_prefixes(path: str) -> str:
    """The path itself and every folder above it, as paths."""
    parts = f"split({path}, '/', -1)"
    return f"transform({parts}, (part, i) -> array_join(slice({parts}, 1, i + 1), '/'))"


def needs_content(
    path: str,
    dialect: str = "py",
    policy_files: tuple[str, ...] = catalog.POLICY_FILES,
) -> str:
    """Whether the text of a raw path is needed: root README and policy file,
    in the py dialect also data dictionaries in Markdown."""
    lowered = f"lower({path})"
    wanted = [one_of(lowered, (catalog.README_MD, catalog.README_RST, *policy_files))]
    if catalog.require_dialect(dialect) == "py":
        suffixes = catalog.DICTIONARY_TEXT_SUFFIXES
        wanted += [f"endswith({lowered}, {text(suffix)})" for suffix in suffixes]
    return any_of(wanted)
