"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a row of statistics (lengths, kinds of characters, kinds of words, repetition, lines).
The trees are grown on histograms of at most 64 bins per statistic, with logistic loss, second-order gains and
a fixed depth. A fitted tree is a complete binary tree in flat arrays, so scoring moves all texts of a batch
down one level at a time with numpy.

Cases: NULL, empty and blank texts have all statistics 0 and get the score that the trees give to that. Labels with a
NULL doc_id or a NULL label aren't used. Without labelled rows every text scores 0.5; with labels of one kind, that
kind. Repeated rows are scored each. Other columns are not looked at. The fit sees at most
``labelled.SAMPLE_ROWS`` rows, in one task; scoring sees all texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.labelled import SAMPLE_ROWS, filtered, held_out, labelled_sample, with_scores
from auditlake.llm.shared import table

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
DEPTH, TREES, RATE, BINS = 4, 80, 0.15, 64


def _kind(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_UPPER, _LOWER = _kind(bytes(range(65, 91))), _kind(bytes(range(97, 123)))
_DIGIT, _STOP, _LINE = _kind(b"0123456789"), _kind(b".,;:?'\"-"), _kind(b"\n")
_LOUD, _BAR, _FAR = _kind(b"!"), _kind(b"|"), _kind(bytes(range(128, 256)))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _STOP | _LOUD | _BAR | _FAR | words.BLANK)
_BYTE_KINDS = (_UPPER, _LOWER, _DIGIT, _STOP, _LOUD, _BAR, _SYMBOL, _FAR, _LINE)
_ENDS = _kind(b".?!")
STATISTICS = 26


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, by owner."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(owner)))
    most = np.zeros(n)
    np.maximum.at(most, owner[at], counts)
    return np.bincount(owner[at], minlength=n), most


def statistics(text: words.Texts) -> np.ndarray:
    """One row of ``STATISTICS`` numbers for each text."""
    n, raw = len(text), text.raw

    def by_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[text.offsets])

    def by_word(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[text.first])

    size, count = np.diff(text.offsets), text.counts
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
    length = text.end - text.start
    hashed = text.words()
    columns = [np.log1p(size), np.log1p(count)]
    columns += [by_text(kind[raw]) * per_byte for kind in _BYTE_KINDS]
    mean = by_word(length) * per_word
    columns += [mean, np.sqrt(np.maximum(by_word(length**2) * per_word - mean**2, 0))]
    longest = np.zeros(n)
    np.maximum.at(longest, text.doc, length)
    columns.append(longest)
    first, last = raw[text.start], raw[text.end - 1]
    upper = np.concatenate(([0], np.cumsum(_UPPER[raw], dtype=np.int64)))
    caps = (upper[text.end] - upper[text.start]) * 2 > length
    odd = np.concatenate(([0], np.cumsum((_SYMBOL | _BAR | _LOUD)[raw], dtype=np.int64)))
    odd = odd[text.end] > odd[text.start]
    same = np.zeros(len(hashed), dtype=bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (text.doc[1:] == text.doc[:-1])
    for mask in (_UPPER[first], caps & (length > 1), odd, _ENDS[last], length <= 3, same):
        columns.append(by_word(mask) * per_word)
    distinct, most = _distinct(text.doc, hashed, n)
    columns += [distinct * per_word, most * per_word]
    runs, begins = text.shingles(hashed, 3)
    owner = np.repeat(np.arange(n), np.diff(begins))
    distinct, most = _distinct(owner, runs, n)
    columns += [distinct / np.maximum(np.diff(begins), 1), most / np.maximum(np.diff(begins), 1)]
    lines = by_text(_LINE[raw]) + 1
    columns += [np.log1p(lines), count / lines]
    return np.column_stack(columns).astype(np.float64)


@dataclass
class Trees:
    """Complete binary trees in flat arrays: inner nodes by level, then leaves. Values above the limit go right."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees for rows ``x`` with labels ``y`` of 0 and 1."""
    n, width = x.shape
    limits = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    binned = np.column_stack([np.searchsorted(limits[k], x[:, k], side="left") for k in range(width)])
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    model = Trees(
        np.zeros((trees, inner), dtype=np.int64),
        np.full((trees, inner), np.inf),
        np.zeros((trees, leaves)),
        float(np.log(share / (1 - share))),
    )
    total = np.full(n, model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            gains = np.full((many, width, BINS), -np.inf)
            for k in range(width):
                place = (node - first) * BINS + binned[:, k]
                s = np.bincount(place, weights=slope, minlength=many * BINS).reshape(many, BINS).cumsum(axis=1)
                c = np.bincount(place, weights=curve, minlength=many * BINS).reshape(many, BINS).cumsum(axis=1)
                rest_s, rest_c = s[:, -1:] - s, c[:, -1:] - c
                gain = s**2 / (c + 1) + rest_s**2 / (rest_c + 1) - s[:, -1:] ** 2 / (c[:, -1:] + 1)
                gains[:, k] = np.where((c >= 1) & (rest_c >= 1), gain, -np.inf)
                gains[:, k, len(limits[k]) :] = -np.inf
            best = gains.reshape(many, -1).argmax(axis=1)
            for j, b in enumerate(best):
                if gains[j, b // BINS, b % BINS] > 1e-6:
                    model.feature[t, first + j] = b // BINS
                    model.limit[t, first + j] = limits[b // BINS][b % BINS]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.limit[t, node])
        place = node - inner
        s = np.bincount(place, weights=slope, minlength=leaves)
        c = np.bincount(place, weights=curve, minlength=leaves)
        model.leaf[t] = RATE * s / (c + 1)
        total += model.leaf[t, place]
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, text in words.texts(words.text_column(batch)):
            flat = pa.array(statistics(text).ravel())
            lists = pa.ListArray.from_arrays(np.arange(stop - row + 1, dtype=np.int32) * STATISTICS, flat)
            yield pa.RecordBatch.from_pydict({"label": batch.column("label").slice(row, stop - row), "x": lists})


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, rows = [], []
    for batch in batches:
        if batch.num_rows:
            labels.append(batch.column("label").to_numpy())
            rows.append(batch.column("x").flatten().to_numpy().reshape(-1, STATISTICS))
    if labels:
        model = grow(np.concatenate(rows), np.concatenate(labels).astype(float))
        parts = [model.feature.astype(float), model.limit, model.leaf, np.float64([model.start])]
        flat = [p.ravel().tolist() for p in parts]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(4), pa.int32()), "numbers": flat})


def train(sample: DataFrame) -> Trees:
    """Trees from a bounded sample (doc_id, text, label)."""
    rows = sample.select("text", "label").mapInArrow(_rows, "label int, x array<double>")
    rows = rows.repartition(1).sortWithinPartitions("x", "label")
    parts = {r.part: np.array(r.numbers) for r in rows.mapInArrow(_grown, "part int, numbers array<double>").collect()}
    if not parts:
        return Trees(np.zeros((0, 2**DEPTH - 1), dtype=np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), 0.0)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    return Trees(
        parts[0].astype(np.int64).reshape(-1, inner),
        parts[1].reshape(-1, inner),
        parts[2].reshape(-1, leaves),
        float(parts[3][0]),
    )


def scorer(spark: SparkSession, model: Trees) -> Callable[[pa.Array], np.ndarray]:
    """A function that scores a text column inside a task."""
    shared = spark.sparkContext.broadcast(model)  # some thousand numbers

    def score(column: pa.Array) -> np.ndarray:
        scores = np.zeros(len(column))
        for row, stop, text in words.texts(column):
            scores[row:stop] = shared.value.scores(statistics(text))
        return scores

    return score


def model_of(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted to the labelled documents that are not held out."""
    return train(labelled_sample(documents, labels, "quality", FOLDS, HELD_OUT, rows))


def quality(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``documents``."""
    scored = with_scores(documents, scorer(documents.sparkSession, model_of(documents, labels, rows)))
    return scored.select(
        "doc_id",
        held_out(FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def of_quality(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``documents`` that score at or above the threshold; all columns stay."""
    score = scorer(documents.sparkSession, model_of(documents, labels, rows))
    return filtered(documents, lambda column: score(column) >= THRESHOLD)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
