"""Byte-level BPE encoding and decoding with a published vocabulary.

A text is cut into pieces by the vocabulary's pattern. Within a piece the symbols form a doubly linked list, and a
priority queue holds the rank and place of every adjacent pair that may merge. The least entry is taken; it is
skipped if it is stale, that is, if its pair is no longer there. Decoding concatenates the vocabulary's strings and
reads the bytes as UTF-8, with the replacement character for what is none. Pieces repeat, so each task keeps
the ids of the pieces that it has met, up to a fixed number of bytes.

Cases: NULL and empty texts have no tokens. A special token's string in a text is that token. A piece may be of any
length; the time grows with n log n. Repeated rows are encoded each. Other columns are not looked at. An id that
the vocabulary doesn't have raises in decoding.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.shared import table

# The published pattern of this family of vocabularies.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Bytes that a worker may keep of pieces and of what lies between spaces; what an entry takes beside its texts.
PIECE_BYTES, SPACED_BYTES, ENTRY_BYTES = 60_000_000, 50_000_000, 150
LONG = 64
_BITS, _PLACE = 20, 32
_PLACES = (1 << _PLACE) - 1


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a vocabulary file stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class BytePairs:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        vocabulary = content["model"]["vocab"]
        self.strings = {i: bytes(letters[c] for c in name) for name, i in vocabulary.items()}
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocabulary[letter]
        # pair, packed, as tuples cost more than the merging itself -> rank; and what each rank makes of its pair
        merges = content["model"]["merges"]
        self.merges = {vocabulary[left] << _BITS | vocabulary[right]: rank for rank, (left, right) in enumerate(merges)}
        self.merged = [vocabulary[left + right] for left, right in merges]
        special = {t["content"]: t["id"] for t in content.get("added_tokens", ())}
        self.special = special
        self.strings |= {i: name.encode() for name, i in special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        # the rank of two bytes beside each other, -1 for none
        self.pairs = [self.merges.get(a << _BITS | b, -1) for a in self.first for b in self.first]
        self.names = {i: str(i) for i in self.strings}
        self.by_name = {name: self.strings[i] for i, name in self.names.items()}
        self.ids = _Remembered(self._piece_ids, PIECE_BYTES)
        self.spaced = _Remembered(self._spaced_ids, SPACED_BYTES)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        pairs = self.pairs
        ranks = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # of each symbol with the next
        # entries: rank, then place, packed in one number
        queue = [rank << _PLACE | k for k, rank in enumerate(ranks) if rank >= 0]
        symbols = [*map(self.first.__getitem__, piece)]
        if not queue:
            return symbols
        n, merged, get, push, exchange = len(symbols), self.merged, self.merges.get, heapq.heappush, heapq.heappushpop
        ranks.append(-1)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            k, rank = entry & _PLACES, entry >> _PLACE
            while ranks[k] == rank:  # else stale: one of the two has grown, or was merged into another
                right = after[k]
                symbols[k] = symbol = merged[rank]
                symbols[right] = ranks[right] = -1
                after[k] = right = after[right]
                entry = -1
                if right < n:
                    before[right] = k
                    ranks[k] = rank = get(symbol << _BITS | symbols[right], -1)
                    if rank >= 0:
                        entry = rank << _PLACE | k
                else:
                    ranks[k] = -1
                left = before[k]
                if left >= 0:
                    ranks[left] = rank = get(symbols[left] << _BITS | symbol, -1)
                    if rank >= 0:
                        if entry >= 0:
                            push(queue, entry)
                        entry = rank << _PLACE | left
                if entry < 0:
                    break
                entry = exchange(queue, entry)  # in and out at once
                k, rank = entry & _PLACES, entry >> _PLACE
        return [s for s in symbols if s >= 0]

    def _piece_ids(self, piece: str) -> str:
        return ",".join(map(self.names.__getitem__, self.merge(piece.encode("utf-8", "surrogatepass"))))

    def _spaced_ids(self, word: str) -> str:
        return ",".join(map(self.ids.__getitem__, PATTERN.findall(" " + word)))

    def _segment(self, text: str) -> list[str]:
        """Ids of a text without special tokens, by pieces or by several at once.

        A space before anything but white space begins a piece, so without double spaces the text can be parted there, and
        what lies between two of them is remembered as a whole.
        """
        if "  " in text:
            return list(map(self.ids.__getitem__, PATTERN.findall(text)))
        first, *rest = text.split(" ")
        return [*map(self.ids.__getitem__, PATTERN.findall(first)), *map(self.spaced.__getitem__, rest)]

    def encode_pieces(self, text: str) -> list[str]:
        """Decimal ids, joined by commas, for each part of a text."""
        if self.cut is None or not self.cut.search(text):
            return self._segment(text)
        found, at = [], 0
        for special in self.cut.finditer(text):
            found += self._segment(text[at : special.start()])
            found.append(str(self.special[special[0]]))
            at = special.end()
        return found + self._segment(text[at:])

    def decode_joined(self, ids: str) -> str:
        """The text of decimal ids joined by commas."""
        return b"".join(map(self.by_name.__getitem__, ids.split(",") if ids else ())).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        return [int(i) for piece in self.encode_pieces(text) for i in piece.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of token ids, special ones included."""
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


class _Remembered(dict):
    """Results by short keys, up to ``most`` bytes. When there are too many, only those that are used again outlive the next filling."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older, self.size = make, most // 2, {}, 0

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if self.size >= self.most:
                self.older = dict(self)
                self.clear()
                self.size = 0
            self.size += len(key) + len(value) + ENTRY_BYTES
            self[key] = value
        return value


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> BytePairs:
    """The vocabulary of a path, once for each Python worker."""
    return BytePairs(path)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids array<int> of each row of ``documents`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in batches:
            ids = [np.array(coder.encode(t), dtype=np.int32) for t in words.text_column(batch).to_pylist()]
            columns = {"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(columns)

    return _plain(documents).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row of ``tokens`` (doc_id, ids); NULL ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in batches:
            found = [coder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(found, pa.string())})

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of ``documents`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in batches:
            sizes, ids, texts = [], [], []
            for text in words.text_column(batch):
                pieces = coder.encode_pieces(text.as_py())
                joined = ",".join(pieces)
                sizes.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(coder.decode_joined(joined).encode()).hexdigest())
            columns = {"n_tokens": sizes, "ids_sha256": ids, "decoded_sha256": texts}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **columns})

    return _plain(documents).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def vocabulary(name: str) -> str:
    """Where a published vocabulary lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
