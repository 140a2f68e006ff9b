"""Counterfactual-regularised toxicity classifier.

Features are the words of a text and their beginnings, hashed; a feature counts once for each of the levels (once,
twice, four times) that its count in the text reaches. The model is a
logistic regression with an L1 penalty, fitted by accelerated proximal gradient steps; then it is fitted again,
without shrinkage, on the features left. For every labelled sentence that names a group of people, the same
sentence is made with another group of the same kind, and the squared change of the score is part of the loss
in both fits. A mention alone so moves the score little, whatever the labelled sample says about those who are
mentioned in it.

Cases: NULL, empty and wordless texts get the score of a text without features. Labels of a NULL doc_id aren't
used, a NULL label neither. Without labelled rows of both kinds every text scores 0. Repeated rows are scored each.
Other columns are not looked at. The fit sees at most ``labelled.SAMPLE_ROWS`` rows, in one task; the scoring
sees all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.labelled import SAMPLE_ROWS, filtered, held_out, labelled_sample, with_scores
from auditlake.llm.shared import table

SPACE = 1 << 19
LEVELS = (1, 2, 4)
BEGINNINGS = (3, 4, 5, 6, 7, 8)
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
LEAST_TEXTS = 3
COUNTERFACTUAL = 5.0
SHRINK, REFIT = 0.2, 0.3

#: Kinds of groups; the names of one kind can stand for each other. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("inmigrantes", "refugiados", "extranjeros"),
)


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each feature, feature) for runs of lower-cased texts."""
    mask = np.uint64(SPACE - 1)
    for row, stop, text in words.texts(column, words.NOT_LETTER):
        length = text.end - text.start
        found = [(words.salted(text.words(), 0) & mask, text.doc)]
        for size in BEGINNINGS:
            has = np.flatnonzero(length >= size)
            begun = text.hashes(text.start[has], text.start[has] + size)
            found.append((words.salted(begun, size) & mask, text.doc[has]))
        yield row, stop, np.concatenate([d for _, d in found]), np.concatenate([f for f, _ in found]).astype(np.int64)


def levels(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and features, once for each of ``LEVELS`` that the feature's count in the text reaches."""
    both, count = np.unique(doc * SPACE + feature, return_counts=True)
    reached = [both[count >= least] for least in LEVELS]
    doc = np.concatenate([r // SPACE for r in reached])
    return doc, np.concatenate([r % SPACE + k * SPACE for k, r in enumerate(reached)])


def feature_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct features of each lower-cased text, with their levels."""
    sets: list[np.ndarray] = []
    for row, stop, doc, feature in features(column):
        doc, feature = levels(doc, feature)
        order = np.lexsort((feature, doc))
        cuts = np.searchsorted(doc[order], np.arange(stop - row + 1))
        sets += [feature[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return sets


def swaps(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """Sentences of a lower-cased text that name a group, each with the next group of the same kind instead."""
    other = {t: kind[(k + 1) % len(kind)] for kind in terms for k, t in enumerate(kind)}
    names = re.compile(r"\b(" + "|".join(sorted(map(re.escape, other), key=len, reverse=True)) + r")\b")
    if not names.search(text):
        return []
    sentences = re.split(r"[.!?]+\s+|\n+", text)
    return [(s, names.sub(lambda m: other[m[0]], s)) for s in sentences if names.search(s)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lowered = _lowered(words.text_column(batch))
        pairs = [p for text in lowered.to_pylist() for p in swaps(text)]
        sides = [feature_sets(pa.array([p[k] for p in pairs], pa.string())) for k in (0, 1)]
        changed = [(np.setdiff1d(b, a), np.setdiff1d(a, b)) for a, b in zip(*sides, strict=True)]
        rows = {
            "label": batch.column("label").to_pylist() + [None] * len(pairs),
            "plus": [s.astype(np.int32) for s in feature_sets(lowered)] + [p.astype(np.int32) for p, _ in changed],
            "minus": [None] * batch.num_rows + [m.astype(np.int32) for _, m in changed],
        }
        kinds = pa.schema([("label", pa.int32()), ("plus", pa.list_(pa.int32())), ("minus", pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_pydict(rows, schema=kinds)


class Rows:
    """Sparse rows of features, each with a value for all of them.

    Held twice, by row and by feature, in 32 bits, so that both sums run over neighbours. ``names`` are the features
    that have columns; others are left out.
    """

    def __init__(self, rows: list[np.ndarray], names: np.ndarray):
        self.n, self.width = len(rows), len(names)
        place_of = np.full(SPACE * len(LEVELS), -1, dtype=np.int32)
        place_of[names] = np.arange(len(names), dtype=np.int32)
        kept = [place[place >= 0] for place in (place_of[r] for r in rows)]
        sizes = np.array([len(k) for k in kept], dtype=np.int64)
        self.place = np.concatenate([*kept, np.zeros(0, dtype=np.int32)])
        del kept
        self.heaviest = int(sizes.max(initial=1))
        self.rows = np.flatnonzero(sizes)  # those that have any
        self.row_starts = np.concatenate(([0], np.cumsum(sizes[self.rows])))[:-1]
        order = np.argsort(self.place, kind="stable").astype(np.int32)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.owner = owner[order]
        ordered = self.place[order]
        self.starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else order
        self.used = ordered[self.starts]

    def times(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(self.n)
        if len(self.rows):
            total[self.rows] = np.add.reduceat(weights[self.place], self.row_starts)
        return total

    def back(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(self.width)
        if len(self.starts):
            total[self.used] = np.add.reduceat(values[self.owner], self.starts)
        return total


def fit(
    labels: np.ndarray,
    rows: list[np.ndarray],
    plus: list[np.ndarray],
    minus: list[np.ndarray],
    strength: float = COUNTERFACTUAL,
    shrink: float = SHRINK,
    steps: int = 80,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights and the bias.

    ``plus`` and ``minus`` hold, for each swapped sentence, the features that it wins and those that it loses;
    ``strength`` weighs the squared change of the score. ``shrink`` times the root of the number of rows is the
    L1 penalty.
    """
    texts = np.zeros(SPACE * len(LEVELS), dtype=np.int32)
    for row in rows:  # a row holds a feature once
        texts[row] += 1
    names = np.flatnonzero(texts >= LEAST_TEXTS)
    weights, bias = np.zeros(len(names)), 0.0
    for penalty in (shrink * len(labels) ** 0.5, REFIT):
        x, won, lost = Rows(rows, names), Rows(plus, names), Rows(minus, names)
        weights, bias = _descend(x, labels, won, lost, strength, penalty, steps, weights, bias)
        del x, won, lost
        used = np.abs(weights) > 1e-6
        names, weights = names[used], weights[used]
    return names, weights, bias


def _descend(x, y, won, lost, strength, penalty, steps, weights, bias) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps; the step size comes from a bound of the curvature of each row."""
    weights, ahead, pace = weights.copy(), weights.copy(), 1.0
    bias_ahead = bias

    def loss(w: np.ndarray, b: float) -> float:
        z = x.times(w) + b
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + strength / 2 * ((won.times(w) - lost.times(w)) ** 2).sum())

    step = 16.0 / (x.n * x.heaviest**0.5)
    for _ in range(steps):
        z = x.times(ahead) + bias_ahead
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        change = won.times(ahead) - lost.times(ahead)
        slope = x.back(off) + strength * (won.back(change) - lost.back(change))
        bias_slope, here = off.sum(), loss(ahead, bias_ahead)
        while True:
            moved = ahead - step * slope
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
            new_bias = bias_ahead - step * bias_slope
            d, d_bias = new - ahead, new_bias - bias_ahead
            if loss(new, new_bias) <= here + slope @ d + bias_slope * d_bias + (d @ d + d_bias**2) / (2 * step) + 1e-9:
                break
            step /= 2
        pace, old = (1 + (1 + 4 * pace**2) ** 0.5) / 2, pace
        ahead = new + (old - 1) / pace * (new - weights)
        bias_ahead = new_bias + (old - 1) / pace * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, bias


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, rows, plus, minus = [], [], [], []
    for batch in batches:
        for label, p, m in zip(*(batch.column(c) for c in ("label", "plus", "minus")), strict=True):
            if label.is_valid:
                labels.append(label.as_py())
                rows.append(p.values.to_numpy())
            else:
                plus.append(p.values.to_numpy())
                minus.append(m.values.to_numpy())
    y = np.array(labels, dtype=float)
    if 0 < y.sum() < len(y):
        names, weights, bias = fit(y, rows, plus, minus)
        yield pa.RecordBatch.from_pydict(
            {"feature": np.append(names, -1).astype(np.int32), "weight": np.append(weights, bias)}
        )


def train(sample: DataFrame) -> dict[int, float]:
    """Weights by feature, the bias at -1, from a bounded sample (doc_id, text, label)."""
    examples = sample.select("doc_id", "text", "label").mapInArrow(
        _examples, "label int, plus array<int>, minus array<int>"
    )
    examples = examples.repartition(1).sortWithinPartitions(F.xxhash64("label", "plus", "minus"), "label", "plus")
    fitted = examples.mapInArrow(_fitted, "feature int, weight double")
    return {r.feature: r.weight for r in fitted.collect()}  # at most three times SPACE numbers


def scorer(spark: SparkSession, model: dict[int, float]) -> Callable[[pa.Array], np.ndarray]:
    """A function that scores a text column inside a task."""
    weights = np.zeros(SPACE * len(LEVELS), dtype=np.float32)
    for feature, weight in model.items():
        if feature >= 0:
            weights[feature] = weight
    bias = model.get(-1, -np.inf)
    shared = spark.sparkContext.broadcast(weights)  # six megabytes, fixed by SPACE

    def score(column: pa.Array) -> np.ndarray:
        own = shared.value
        known = own.reshape(len(LEVELS), SPACE).any(axis=0)
        total = np.full(len(column), bias)
        for row, stop, doc, feature in features(_lowered(column)):
            used = known[feature]
            doc, feature = levels(doc[used], feature[used])
            total[row:stop] += np.bincount(doc, weights=own[feature], minlength=stop - row)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-total))

    return score


def model_of(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict[int, float]:
    """Weights fitted to the labelled documents that are not held out."""
    return train(labelled_sample(documents, labels, "toxic", FOLDS, HELD_OUT, rows))


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``documents``."""
    scored = with_scores(documents, scorer(documents.sparkSession, model_of(documents, labels, rows)))
    return scored.select(
        "doc_id",
        held_out(FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``documents`` that score below the threshold; all columns stay."""
    score = scorer(documents.sparkSession, model_of(documents, labels, rows))
    return filtered(documents, lambda column: score(column) < THRESHOLD)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
