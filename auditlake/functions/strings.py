"""Text and bit-mask expressions.

A README is scanned once, where it is read, and reduced to 64-bit masks: bit
*i* says whether phrase *i* occurs.  Masks are what travels through shuffles
and aggregates, never the text.
"""

from __future__ import annotations

from auditlake import catalog
from auditlake.functions.literals import text

# Bits of the phrase mask.
NOT_EMPTY = "not empty"
NOT_BLANK = "not blank"
PHRASES = tuple(
    dict.fromkeys(
        (
            *catalog.REPRODUCTION_PHRASES,
            *catalog.DICTIONARY_PHRASES,
            *catalog.PROVENANCE_TERMS,
            *catalog.DEFAULT_PRIVACY_TERMS,
            *catalog.ETHICS_TERMS,
        )
    )
)
_BITS = {name: 1 << bit for bit, name in enumerate((NOT_EMPTY, NOT_BLANK, *PHRASES))}


def strip(value: str, dialect: str = "py") -> str:
    """Text without outer whitespace, by the whitespace rules of the dialect."""
    return f"btrim({value}, {text(catalog.WHITESPACE[catalog.require_dialect(dialect)])})"


def matched_terms(value: str, terms: str) -> str:
    """The terms that occur in the text, in term order."""
    return f"filter({terms}, term -> contains({value}, term))"


def phrase_mask(lowered: str, dialect: str = "py") -> str:
    """Mask of the fixed README phrases in a lowercased text; NULL for NULL."""
    conditions = {NOT_EMPTY: f"{lowered} <> ''", NOT_BLANK: f"{strip(lowered, dialect)} <> ''"}
    conditions.update({phrase: f"contains({lowered}, {text(phrase)})" for phrase in PHRASES})
    bits = [f"IF({condition}, {_BITS[name]}L, 0L)" for name, condition in conditions.items()]
    return f"IF({lowered} IS NULL, NULL, {' + '.join(bits)})"


def any_in_mask(mask: str, *names: str) -> str:
    """Whether a bit of one of the phrases is set."""
    return f"({mask} & {sum(_BITS[name] for name in names)}L) <> 0"


def phrases_in_mask(mask: str, names: tuple[str, ...]) -> str:
    """The phrases whose bits are set, in the given order."""
    found = ", ".join(f"IF({any_in_mask(mask, name)}, {text(name)}, NULL)" for name in names)
    return f"array_compact(array({found}))"


def positions(items: str, condition: str) -> str:
    """Positions of the list items that satisfy a condition on ``item``; the list may have any length."""
    return f"array_compact(transform({items}, (item, i) -> IF({condition}, i, NULL)))"


def items_at(items: str, found: str) -> str:
    """The list items at the positions, which are sorted; one step for each position."""
    return f"transform({found}, i -> element_at({items}, i + 1))"


# Lists up to this length are walked in the rows that meet them and answered by a few 64-bit masks; longer ones
# take part in joins.
MASKS, MASK_BITS = 4, 62
SHORT_LIST = MASKS * MASK_BITS


def is_short(items: str) -> str:
    return f"size({items}) <= {SHORT_LIST}"


def position_masks(place: str) -> list[str]:
    """For each mask, the bit of a place (from 1 on) in a short list; 0 for a place of 0 or NULL."""
    masks = []
    for k in range(MASKS):
        within = f"{place} - {k * MASK_BITS + 1}"
        masks.append(f"IF({place} BETWEEN {k * MASK_BITS + 1} AND {(k + 1) * MASK_BITS}, shiftleft(1L, {within}), 0L)")
    return masks


def items_missing(items: str, masks: str, found: str) -> str:
    """The list items that were not found, in list order: by the array of masks for short lists, else by the set of positions found.

    Linear in the list: the positions that are left are a difference of hash sets.
    """
    bit = f"shiftleft(1L, i % {MASK_BITS})"
    short = f"filter({items}, (item, i) -> (element_at({masks}, CAST(i div {MASK_BITS} AS INT) + 1) & {bit}) = 0)"
    left = f"array_except(sequence(0, size({items}) - 1), {found})"
    return f"IF({is_short(items)}, {short}, transform({left}, i -> element_at({items}, i + 1)))"
