"""Many terms in one pass over a text, for lists too long to be looked for one by one."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@functools.lru_cache(maxsize=64)
def automaton(terms: tuple[str, ...]):
    """The trie of the terms with its links; built once for each list that a worker meets in a row."""
    import ahocorasick  # only where there are such lists

    places: dict[str, list[int]] = {}
    for place, term in enumerate(terms):
        places.setdefault(term, []).append(place)
    found = ahocorasick.Automaton()
    for term, own in places.items():
        if term:
            found.add_word(term, own)
    found.make_automaton()
    return found


def places_in(text: str, terms: tuple[str, ...]) -> list[int]:
    """Positions of the terms that occur in the text, in order; an empty term occurs in every text."""
    found = {place for place, term in enumerate(terms) if not term}
    if len(found) < len(terms):
        for _, own in automaton(terms).iter(text):
            found.update(own)
    return sorted(found)


def with_places(rows: DataFrame, text: str, terms: str, name: str) -> DataFrame:
    """``rows`` with the positions of the terms (an array column) that occur in the text, in place of both columns.

    The work for a text is one step for each character and match, however many terms there are. A text or list of NULL
    has no positions.
    """
    kept = [column for column in rows.columns if column not in (text, terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [tuple(x) if x is not None else () for x in batch.column(terms).to_pylist()]
            found = [places_in(x or "", own) if x is not None else [] for x, own in zip(batch.column(text).to_pylist(), lists, strict=True)]
            columns = {column: batch.column(column) for column in kept}
            yield pa.RecordBatch.from_pydict(columns | {name: pa.array(found, pa.list_(pa.int32()))})

    schema = rows.select(kept).schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)
