"""Vectorised words, hashes and shingles over Arrow text columns.

Words are maximal runs of bytes other than space and \\t..\\r, after lower-casing A-Z, as the contracts of
the operators define them. Hashes are 64 bits wide: a polynomial over the bytes, then a finaliser; two
different words or shingles share one with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[97:123] = NOT_LETTER[65:91] = NOT_LETTER[128:] = False
_powers = np.ones((2, 1), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the same values for every salt."""
    return mix(x ^ mix(np.uint64([salt * 2 + 1]) * _ODD))


def powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    global _powers
    if _powers.shape[1] <= n:
        base = 0x9FB21C651E98DF25
        both = np.empty((2, n + 1), dtype=np.uint64)
        for row, step in zip(both, (base, pow(base, -1, 1 << 64)), strict=True):
            row[0] = 1
            row[1:] = step
            np.multiply.accumulate(row, out=row)
        _powers = both
    return _powers


def _place(k: int) -> np.ndarray:
    """What tells the word at place ``k`` of a shingle from the same word elsewhere."""
    return np.uint64([k + 1]) * _ODD


class Texts:
    """Words of some texts, laid end to end.

    ``data`` holds the lower-cased bytes, ``raw`` the bytes as they are, ``offsets`` where texts begin.
    ``start``, ``end`` and ``doc`` describe each word; ``first`` gives the first word of each text.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK):
        self.raw, self.offsets = raw, offsets
        self.data = _LOWER[raw]
        word = ~blank[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        starts, ends = word.copy(), word.copy()
        if len(raw):
            starts[1:] &= ~word[:-1] | edge[1:-1]
            ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges from ``start`` to ``end``."""
        up, down = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data + np.uint64(1)) * up[: len(self.data)], out=self._sums[1:])
        value = (self._sums[end] - self._sums[start]) * down[start]
        return mix(value + (end - start).astype(np.uint64) * _ODD)

    def words(self) -> np.ndarray:
        """One hash for each word."""
        return self.hashes(self.start, self.end)

    def shingles(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, and where each text's begin.

        A text with fewer words has one for the whole sequence, a text without words none.
        """
        total = len(words)
        short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        value = np.zeros(max(0, total - size + 1), dtype=np.uint64)
        for k in range(size):
            value += mix(words[k : len(value) + k] + _place(k))
        value = mix(value)
        whole = np.arange(len(value))
        inside = self.doc[whole] == self.doc[whole + size - 1] if len(value) else np.zeros(0, dtype=bool)
        parts, owner = [value[inside]], [self.doc[whole[inside]]]
        if len(short):
            sums = np.zeros(len(short), dtype=np.uint64)
            for k in range(size - 1):
                has = self.counts[short] > k
                at = self.first[short[has]] + k
                sums[has] += mix(words[at] + _place(k))
            parts.append(mix(sums + self.counts[short].astype(np.uint64)))
            owner.append(short)
            parts, owner = np.concatenate(parts), np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            value, owner = parts[order], owner[order]
        else:
            value, owner = parts[0], owner[0]
        return value, np.searchsorted(owner, np.arange(len(self) + 1))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with NULL as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column, "") if column.null_count else column


def slices(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``chunk_bytes`` as (first row, row after the last, bytes, offsets).

    A text is never cut; one longer than ``chunk_bytes`` is a run of its own.
    """
    if not len(column):
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def texts(
    column: pa.Array, blank: np.ndarray = BLANK, chunk_bytes: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, Texts]]:
    """The words of a text column, by runs of rows; ``blank`` tells which bytes part words."""
    for row, stop, data, offsets in slices(column, chunk_bytes):
        yield row, stop, Texts(data, offsets, blank)
