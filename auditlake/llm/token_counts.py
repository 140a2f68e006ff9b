"""Token counts by field and section, from one encoding of the whole document.

The fields of a document are joined by line breaks and encoded once, as a whole. Sections tile the joined text:
every field but the last is one section, the lines of the last field are one each, and a line break belongs to the
section that it ends. The character spans of the tokens are joined to the spans of the sections by their sorted
bounds.

Rule for a token that crosses a bound: it counts for the section that holds most of its characters, and for
the first of those that hold as many. A token that holds part of a character counts as holding that character. Each
token counts once, so the counts of a document sum to its number of tokens.

Cases: NULL fields are empty; every section has a row, also one without tokens or characters. A text of n line breaks
has n + 1 lines. Repeated rows have their rows each. Columns that aren't named as fields are not looked at, so they
may have any name.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.bpe import vocabulary
from auditlake.llm.shared import table

# The published pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a rank file, and the length in bytes of each token."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the one after its last."""
    encoder, lengths = loaded(path)
    end = np.cumsum(lengths[np.asarray(encoder.encode_ordinary(text), dtype=np.int64)])
    if text.isascii():
        return np.concatenate(([0], end))[:-1], end
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    begin = np.concatenate(([0], end))[:-1]
    return character[begin], character[end - 1] + 1


def allocate(begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a bound.

    ``bounds`` holds where sections begin, ascending, and the end of the text; empty sections hold nothing.
    """
    first = np.searchsorted(bounds, begin, side="right") - 1
    last = np.searchsorted(bounds, end - 1, side="right") - 1
    crossing = first != last
    for k in np.flatnonzero(crossing):
        sections = np.arange(first[k], last[k] + 1)
        held = np.minimum(bounds[sections + 1], end[k]) - np.maximum(bounds[sections], begin[k])
        first[k] = sections[held.argmax()]
    return first, crossing


def sectioned(parts: list[str]) -> tuple[str, np.ndarray]:
    """The joined text of some fields, and the bounds of its sections."""
    text = "\n".join(parts)
    sizes = [len(p) + 1 for p in parts[:-1]] + [len(line) + 1 for line in parts[-1].split("\n")]
    sizes[-1] -= 1
    return text, np.concatenate(([0], np.cumsum(sizes)))


def token_counts(documents: DataFrame, fields: tuple[str, ...], path: str) -> DataFrame:
    """doc_id, field, section, n_chars, n_tokens and n_crossing for each section of ``documents``.

    ``fields`` are names of text columns; the lines of the last are sections of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, section, chars, tokens, crossings = [], [], [], [], []
            for row, parts in enumerate(zip(*(batch.column(1 + k).to_pylist() for k in range(len(fields))), strict=True)):
                text, bounds = sectioned([p or "" for p in parts])
                begin, end = spans(text, path)
                at, crossing = allocate(begin, end, bounds)
                n = len(bounds) - 1
                owner.append(np.full(n, row))
                section.append(np.arange(n))
                chars.append(np.diff(bounds))
                tokens.append(np.bincount(at, minlength=n))
                crossings.append(np.bincount(at, weights=crossing, minlength=n).astype(np.int64))
            if owner:
                owner, place = np.concatenate(owner), np.concatenate(section)
                names = pa.array(fields).take(pa.array(np.minimum(place, len(fields) - 1)))
                columns = {"doc_id": batch.column(0).take(pa.array(owner)), "field": names, "section": place}
                columns |= {"n_chars": np.concatenate(chars), "n_tokens": np.concatenate(tokens)}
                yield pa.RecordBatch.from_pydict(columns | {"n_crossing": np.concatenate(crossings)})

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(f).cast("string") for f in fields))
    return texts.mapInArrow(
        run, "doc_id bigint, field string, section bigint, n_chars bigint, n_tokens bigint, n_crossing bigint"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every field and line of the documents."""
    documents = table(spark, sf_dir, "documents")
    return token_counts(documents, ("source", "lang", "text"), vocabulary("byte_bpe_50k.tiktoken"))
