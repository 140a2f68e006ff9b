"""Benchmark decontamination by a BM25 inverted index of the test items.

Every item is a document of the index, every passage of the corpus a query. Passages are windows of twice the
words of the longest item, half overlapping, so that any item lies whole in one. Impacts are BM25 weights divided by
the item's own score, so a passage that holds all words of an item scores 1 for it. Postings lie in blocks of items,
with the largest impact of each term in a block. Passages are searched as block-max WAND does, many at a time: a passage's terms
are ordered by their largest impacts, and the pivot is the first with which the sum reaches the threshold, so an item that
counts has a term from there on. Only those terms' postings are walked, block by block; the cursors of the others
skip to the blocks that can still reach the threshold, and only what the blocks' largest impacts leave is scored
item by item. Passages are taken in runs of a bounded number of postings. All items at or above the threshold are retrieved, and then the five-word runs of the item's question
and answer are looked for in the passage; of a part that has too few of them, the words are aligned with the passage,
and its share is that of the words that need no edit. Numbers must all be there in their order, as an item with other
numbers is another item. The answer is an item's last sentence, or, of one sentence, its last words.

The index is built and searched in shards of a bounded size, each over all documents.

Cases: NULL and empty texts hold nothing; items without words are in no document. Words are runs of letters and
digits in lower case, so signs and line breaks play no part. Question or answer shorter than five words must occur as one run. Equal
items are found each. Repeated documents are searched each. An empty index finds nothing. Rows of the benchmark
with a NULL item_id are left out. Other columns are not looked at, and pass through the filter unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.labelled import filtered
from auditlake.llm.shared import table

THRESHOLD = 0.6
QUESTION_SHARE, ANSWER_SHARE = 0.7, 0.7
RUN = 5
ANSWER_WORDS = 8
BLOCK = 16
SHARD_CHARS = 4_000_000
RUN_ENTRIES = 400_000
K1, B = 1.2, 0.75
NOT_WORD = words.NOT_LETTER.copy()
NOT_WORD[48:58] = False


def _texts(column: pa.Array) -> Iterator[tuple[int, int, words.Texts]]:
    return words.texts(pc.utf8_lower(column), NOT_WORD)


_WORD = regex.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        value = words.mix(value ^ hashes[k : k + n])
    return value


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's parts: its last sentence is the answer; of a single sentence, its last words are."""
    sentences = [s for s in regex.split(r"(?<=[.!?])\s+|\n+", text) if regex.search(r"[\p{L}\p{N}]", s)]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    return text, " ".join(text.split()[-ANSWER_WORDS:])


@dataclass
class Part:
    """The question or the answer of an item: its words, its runs of ``size`` words, and the words that are numbers."""

    words: np.ndarray
    size: int
    runs: np.ndarray
    numbers: np.ndarray

    def share(self, passage: np.ndarray, enough: float) -> float:
        """What a passage holds of it: the share of its runs, or, if that isn't ``enough``, of its words if more."""
        if not len(self.words):
            return 1.0
        if not _in_order(self.numbers, passage):
            return 0.0
        held = float(np.isin(self.runs, runs(passage, self.size)).mean())
        if held >= enough or len(self.words) < RUN:
            return held
        return max(held, 1 - edits(self.words, passage) / len(self.words))


def _in_order(numbers: np.ndarray, passage: np.ndarray) -> bool:
    """Whether a passage holds all of ``numbers`` in this order."""
    if not len(numbers):
        return True
    left = iter(passage[np.isin(passage, numbers)].tolist())
    return all(number in left for number in numbers.tolist())


def edits(part: np.ndarray, passage: np.ndarray) -> int:
    """The fewest words to change, leave out or put in that make ``part`` some run of the passage's words."""
    place = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    for word in part:
        after = row + 1
        np.minimum(after[1:], row[:-1] + (passage != word), out=after[1:])
        row = np.minimum.accumulate(after - place) + place
    return int(row.min())


@dataclass
class Index:
    """Postings of some items, by term and block; ``parts`` holds the question and the answer of each."""

    items: np.ndarray
    longest: int
    terms: np.ndarray
    largest: np.ndarray
    block_first: np.ndarray
    pairs: np.ndarray
    block_of: np.ndarray
    block_largest: np.ndarray
    posting_first: np.ndarray
    posting_item: np.ndarray
    posting_impact: np.ndarray
    parts: list[tuple[Part, Part]]

    @property
    def blocks(self) -> int:
        return max(1, -(-len(self.items) // BLOCK))


def _hashes(texts: list[str]) -> list[np.ndarray]:
    found: list[np.ndarray] = []
    for _, _, text in _texts(pa.array(texts, pa.string())):
        hashed = text.words()
        found += [hashed[a:b] for a, b in zip(text.first[:-1], text.first[1:], strict=True)]
    return found


def build(ids: list[int], texts: list[str], inverse: dict[int, float], average: float) -> Index:
    """The index of some items; ``inverse`` holds inverse document frequencies of all items' terms."""
    hashed = _hashes(texts)
    used = [k for k, h in enumerate(hashed) if len(h)]
    ids, texts, hashed = ([x[k] for k in used] for x in (ids, texts, hashed))
    rows = []
    for k, found in enumerate(hashed):
        term, count = np.unique(found, return_counts=True)
        weight = np.array([inverse[int(t)] for t in term.view(np.int64)])
        impact = weight * count * (K1 + 1) / (count + K1 * (1 - B + B * len(found) / average))
        rows.append((term, np.full(len(term), k), impact / impact.sum()))
    term, item, impact = (np.concatenate([r[c] for r in rows] or [np.zeros(0)]) for c in range(3))
    terms, place = np.unique(term.astype(np.uint64), return_inverse=True)
    item = item.astype(np.int64)
    order = np.lexsort((item, place))
    place, item, impact = place[order], item[order], impact[order]
    largest = np.zeros(len(terms))
    np.maximum.at(largest, place, impact)
    blocks = max(1, -(-len(ids) // BLOCK))
    pair, first = np.unique(place * blocks + item // BLOCK, return_index=True)
    block_largest = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0)
    parts = []
    for text in texts:
        both = []
        pieces = question_and_answer(text)
        digits = [" ".join(w for w in _WORD.findall(p.lower()) if w.isdigit() and w.isascii()) for p in pieces]
        found = _hashes([*pieces, *digits])
        for own, numbers in zip(found[:2], found[2:], strict=True):
            size = max(1, min(RUN, len(own)))
            both.append(Part(own, size, np.unique(runs(own, size)), numbers))
        parts.append(tuple(both))
    return Index(
        np.array(ids, dtype=np.int64),
        max(map(len, hashed), default=0),
        terms,
        largest,
        np.searchsorted(pair // blocks, np.arange(len(terms) + 1)),
        pair,
        pair % blocks,
        block_largest,
        np.append(first, len(item)),
        item,
        impact,
        parts,
    )


def _spread(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the ranges from ``first`` to ``after``."""
    size = after - first
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]


def retrieve(index: Index, text: words.Texts, hashed: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, window, item, score) of all passages and items at or above the threshold."""
    none = (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0),)
    if not len(index.items) or not len(hashed):
        return none
    place = np.minimum(np.searchsorted(index.terms, hashed), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == hashed)
    step = index.longest
    inside = (known - text.first[text.doc[known]]) // step
    # each text has a window for each step, from 0 on; a word is in its step's window and the one before
    windows = np.concatenate(([0], np.cumsum(text.counts // step + 1)))
    own = windows[text.doc[known]] + inside
    n_terms = len(index.terms)
    before = inside > 0
    keys = np.unique(np.concatenate((own * n_terms + place[known], (own[before] - 1) * n_terms + place[known][before])))
    window, term = keys // n_terms, keys % n_terms
    slack = THRESHOLD - 1e-9
    # passages whose terms can't reach the threshold together
    possible = np.bincount(window, weights=index.largest[term], minlength=windows[-1]) >= slack
    keep = possible[window]
    window, term = window[keep], term[keep]
    if not len(window):
        return none
    order = np.lexsort((index.largest[term], window))
    window, term = window[order], term[order]
    first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
    sums = np.cumsum(index.largest[term])
    before = np.repeat(np.append(0, sums[first[1:] - 1]), np.diff(np.append(first, len(term))))
    pivotal = sums - before >= slack
    entries = np.where(pivotal, index.block_first[term + 1] - index.block_first[term], 1)
    found = []
    for low, high in _in_runs(np.add.reduceat(entries, first)):
        a, b = first[low], first[high] if high < len(first) else len(term)
        found += _searched(index, window[a:b], term[a:b], pivotal[a:b], slack)
    if not found:
        return none
    window, item, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((item, window))
    window = window[order]
    doc = np.searchsorted(windows, window, side="right") - 1
    return doc, window - windows[doc], item[order], score[order]


def _in_runs(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbours whose cost is ``RUN_ENTRIES`` together, or one that costs more."""
    total, low = np.cumsum(cost), 0
    while low < len(cost):
        done = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + RUN_ENTRIES, side="right")))
        yield low, high
        low = high


def _searched(
    index: Index, window: np.ndarray, term: np.ndarray, pivotal: np.ndarray, slack: float
) -> Iterator[tuple[np.ndarray, ...]]:
    """(window, item, score) at or above the threshold of some windows, whose terms are in the order of their largest impacts."""
    names, own = np.unique(window, return_inverse=True)
    row, entry = _spread(index.block_first[term[pivotal]], index.block_first[term[pivotal] + 1])
    cells, of = np.unique(own[pivotal][row] * index.blocks + index.block_of[entry], return_inverse=True)
    bound = np.bincount(of, weights=index.block_largest[entry])
    # what the terms before the pivot add at most
    others, size = term[~pivotal], np.bincount(own[~pivotal], minlength=len(names))
    begin = np.cumsum(size) - size
    rest = np.bincount(own[~pivotal], weights=index.largest[others], minlength=len(names))
    alive = np.flatnonzero(bound + rest[cells // index.blocks] >= slack)
    for low, high in _in_runs(size[cells[alive] // index.blocks] + 1):
        some = alive[low:high]
        at = cells[some] // index.blocks
        cell, place = _spread(begin[at], begin[at] + size[at])
        # the cursors of the other terms skip to these blocks
        wanted = others[place] * index.blocks + cells[some][cell] % index.blocks
        met = np.minimum(np.searchsorted(index.pairs, wanted), len(index.pairs) - 1)
        hit = index.pairs[met] == wanted
        cell, met = cell[hit], met[hit]
        total = bound[some] + np.bincount(cell, weights=index.block_largest[met], minlength=len(some))
        kept = total >= slack
        chosen = np.full(len(cells), -1)
        chosen[some[kept]] = np.flatnonzero(kept)
        walked = chosen[of] >= 0
        use = kept[cell]
        cell, met = np.concatenate((chosen[of][walked], cell[use])), np.concatenate((entry[walked], met[use]))
        # what is left, item by item
        pair, posting = _spread(index.posting_first[met], index.posting_first[met + 1])
        both, of_item = np.unique(cell[pair] * len(index.items) + index.posting_item[posting], return_inverse=True)
        score = np.bincount(of_item, weights=index.posting_impact[posting], minlength=len(both))
        reached = score >= slack
        both = both[reached]
        yield names[at[both // len(index.items)]], both % len(index.items), score[reached]


def verified(index: Index, passage: np.ndarray, item: int) -> tuple[float, float]:
    """Shares of an item's question and answer that a passage holds."""
    question, answer = index.parts[item]
    return question.share(passage, QUESTION_SHARE), answer.share(passage, ANSWER_SHARE)


def search(index: Index, column: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, place of the item, score, share of the question, share of the answer), one for each row and item."""
    for row, _, text in _texts(column):
        hashed = text.words()
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for doc, window, item, score in zip(*retrieve(index, text, hashed), strict=True):
            begin = text.first[doc] + window * index.longest
            passage = hashed[begin : min(begin + 2 * index.longest, text.first[doc + 1])]
            question, answer = verified(index, passage, item)
            if question >= QUESTION_SHARE and answer >= ANSWER_SHARE:
                found = (float(score), question, answer)
                best[int(doc), int(item)] = max(best.get((int(doc), int(item)), found), found)
        for (doc, item), found in sorted(best.items()):
            yield row + doc, item, *found


def shards(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of all items, each of about ``SHARD_CHARS`` characters, with frequencies over all items."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text in _texts(words.text_column(batch)):
                found = np.unique(np.column_stack((text.doc.astype(np.uint64), text.words())), axis=0)[:, 1]
                yield pa.RecordBatch.from_pydict({"term": found.view(np.int64), "words": np.zeros(len(found), dtype=np.int64)})
                yield pa.RecordBatch.from_pydict({"term": pa.nulls(len(text), pa.int64()), "words": text.counts})

    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    counted = items.select("text").mapInArrow(terms, "term bigint, words bigint")
    facts = counted.filter("term is null and words > 0").agg(F.count("*").alias("n"), F.avg("words").alias("average")).first()
    size = items.agg(F.sum(F.length("text")).alias("size")).first()
    if not facts.n:
        return
    many = int(size["size"] // SHARD_CHARS) + 1
    weight = F.log(1 + (facts.n - F.col("texts") + 0.5) / (F.col("texts") + 0.5))
    inverse = counted.filter("term is not null").groupBy("term").agg(F.count("*").alias("texts"))
    inverse = inverse.select("term", weight.alias("weight"))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(many))
    for k in range(many):
        own = items.filter(shard == k)
        rows = sorted((r.item_id, r.text or "") for r in own.collect())  # about SHARD_CHARS characters
        needed = own.select("text").mapInArrow(terms, "term bigint, words bigint").select("term").distinct()
        weights = {r.term: r.weight for r in inverse.join(needed, "term", "left_semi").collect()}
        yield build([r[0] for r in rows], [r[1] for r in rows], weights, facts.average)


HITS = "doc_id bigint, item_id bigint, score double, question_share double, answer_share double"


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_share and answer_share for each document and item that it holds."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for index in shards(benchmark):
        own = texts.mapInArrow(_hits(spark.sparkContext.broadcast(index)), HITS)
        found = own if found is None else found.union(own)
    return texts.sparkSession.createDataFrame([], HITS) if found is None else found


def _hits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = list(search(index, words.text_column(batch)))
            columns = {"doc_id": batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))}
            columns["item_id"] = pa.array([index.items[r[1]] for r in rows], pa.int64())
            for k, name in enumerate(("score", "question_share", "answer_share")):
                columns[name] = pa.array([r[2 + k] for r in rows], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def without_benchmark(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no item; all columns stay."""
    left = documents
    for index in shards(benchmark):
        left = filtered(left, _clean(documents.sparkSession.sparkContext.broadcast(index)))
    return left


def _clean(shared) -> Callable[[pa.Array], np.ndarray]:
    def keep(column: pa.Array) -> np.ndarray:
        clean = np.ones(len(column), dtype=bool)
        clean[[found[0] for found in search(shared.value, column)]] = False
        return clean

    return keep


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark, and which."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
