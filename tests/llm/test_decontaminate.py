import random

import numpy as np
import pyarrow as pa

from auditlake.llm import decontaminate as dc

from . import frames


def benchmark(random_, n=40):
    rows = [(k, f"What does {frames.text(random_, 12)} show? It shows {frames.text(random_, 9)}.") for k in range(n)]
    return [*rows, (500, None), (501, ""), (502, "!!! 123"), (None, "left out as it has no id at all"), (503, rows[0][1])]


def corpus(random_, items):
    """Clean texts, texts with an item, with half of one, with its words out of order, and long ones."""
    rows = []
    for k in range(120):
        item = items[k % 40][1]
        words = item.split()
        middle = {
            0: item,
            1: item.upper().replace(" ", " \n "),
            2: " ".join(words[: len(words) // 2]),
            3: " ".join(random_.sample(words, len(words))),
        }.get(k % 8, "")
        around = 2000 if k % 11 == 0 else random_.randint(0, 150)
        rows.append((k, f"{frames.text(random_, around)} {middle} {frames.text(random_, around)}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "2 AS term")


def expected(rows, items):
    """Every document against every item: the runs of letters of whole items, in order."""
    import regex

    def letters(text):
        return regex.findall(r"[a-z\u0080-\U0010ffff]+", (text or "").lower())

    found = set()
    for doc_id, text in rows:
        words = letters(text)
        runs = {tuple(words[k : k + 5]) for k in range(len(words))}
        for item_id, item in items:
            own = letters(item)
            if item_id is not None and own and all(tuple(own[k : k + 5]) in runs for k in range(len(own) - 4)):
                found.add((doc_id, item_id))
    return found


def test_whole_items_are_found_and_nothing_else(spark):
    random_ = random.Random(4)
    items = benchmark(random_)
    rows = corpus(random_, items) + frames.AWKWARD
    documents = frames.documents(spark, rows)
    found = dc.contaminated(documents, frame(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected(rows, items)
    assert all(r.question_share >= dc.QUESTION_SHARE and r.answer_share >= dc.ANSWER_SHARE for r in found)
    assert {r.item_id for r in found if r.doc_id == 0} == {0, 503}
    clean = dc.without_benchmark(documents, frame(spark, items))
    assert clean.columns == documents.columns
    dirty = {r.doc_id for r in found}
    assert clean.count() == sum(doc_id not in dirty for doc_id, _ in rows)


def held(spark, items, rows):
    found = dc.contaminated(frames.documents(spark, rows), frame(spark, items)).collect()
    return {(r.doc_id, r.item_id) for r in found}


def test_one_edited_word_hides_no_item(spark):
    """One sentence of 18 words: each word in turn is another one, is missing, or has one more before it."""
    own = "the northern gauge stood far below its usual mark when seven late barges reached that old stone weir".split()
    around = "rain fell on the hills and nobody read it for many weeks"
    rows = []
    for k in range(len(own)):
        for middle in ([*own[:k], "other", *own[k + 1 :]], own[:k] + own[k + 1 :], [*own[:k], "other", *own[k:]]):
            rows.append((len(rows), f"{around} {' '.join(middle)} {around}"))
    clean = [(900, around), (901, " ".join(own[:9])), (902, " ".join(reversed(own)))]
    assert held(spark, [(7, " ".join(own) + "."), (8, around + " once more in a far country")], rows + clean) == {(k, 7) for k in range(len(rows))}


def test_numbers_are_words(spark):
    """Answers that are numbers are verified, and items that differ only in numbers are different ones."""
    ask = "A boat carries {} stones up the river and {} stones down, so how many stones has it carried? {}"
    items = [(1, ask.format(12, 30, 42)), (2, ask.format(15, 60, 75)), (3, "17 + 25 = 42"), (4, "!!!")]
    rows = [(10, "Read on. " + items[0][1]), (11, "Read on. " + items[1][1]), (12, ask.format(12, 30, 99)), (13, "so 17 + 25 = 42, he said")]
    assert held(spark, items, rows) == {(10, 1), (11, 2), (13, 3)}
    assert dc.question_and_answer(items[0][1])[1] == "42"


def test_edits_against_every_run():
    """The edit distance to the nearest run of the passage, by the table of every run."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    random_ = np.random.default_rng(8)
    for _ in range(40):
        part, passage = (random_.integers(0, 4, random_.integers(n, 9)).astype(np.uint64) for n in (1, 0))
        every = [passage[a:b] for a in range(len(passage) + 1) for b in range(a, len(passage) + 1)]
        assert dc.edits(part, passage) == min(distance(list(part), list(e)) for e in every)


def test_shards_do_not_change_the_result(spark, monkeypatch):
    random_ = random.Random(5)
    items = benchmark(random_)
    rows = corpus(random_, items)[:24]
    documents = frames.documents(spark, rows)
    whole = sorted(map(tuple, dc.contaminated(documents, frame(spark, items)).collect()))
    monkeypatch.setattr(dc, "SHARD_CHARS", 3000)
    assert len(list(dc.shards(frame(spark, items)))) > 1
    parts = sorted(map(tuple, dc.contaminated(documents, frame(spark, items)).collect()))
    assert [p[:2] for p in parts] == [w[:2] for w in whole]
    assert np.allclose([p[2:] for p in parts], [w[2:] for w in whole])


def test_empty_tables(spark):
    items = frame(spark, benchmark(random.Random(6)))
    assert dc.contaminated(frames.documents(spark, []), items).count() == 0
    documents = frames.documents(spark, frames.AWKWARD)
    assert dc.contaminated(documents, items.limit(0)).count() == 0
    assert dc.without_benchmark(documents, items.limit(0)).count() == len(frames.AWKWARD)


def test_retrieval_equals_scoring_every_item():
    """Bounds of terms and blocks rule out no passage that reaches the threshold."""
    random_ = random.Random(7)
    items = [(k, frames.text(random_, random_.randint(3, 30))) for k in range(100)]
    hashed = dc._hashes([t for _, t in items])
    counts = {}
    for found in hashed:
        for term in set(found.view(np.int64).tolist()):
            counts[term] = counts.get(term, 0) + 1
    inverse = {t: float(np.log(1 + (100 - n + 0.5) / (n + 0.5))) for t, n in counts.items()}
    index = dc.build([k for k, _ in items], [t for _, t in items], inverse, float(np.mean([len(h) for h in hashed])))
    texts = [frames.text(random_, 50) + " " + " ".join(items[k][1].split()[: 5 + k % 20]) for k in range(60)]
    impacts = {}
    for term in range(len(index.terms)):
        for entry in range(index.block_first[term], index.block_first[term + 1]):
            for p in range(index.posting_first[entry], index.posting_first[entry + 1]):
                impacts[int(index.terms[term]), int(index.posting_item[p])] = index.posting_impact[p]
    for _, _, text in dc._texts(pa.array(texts)):
        words = text.words()
        got = {(d, w, i): s for d, w, i, s in zip(*dc.retrieve(index, text, words), strict=True)}
        want = {}
        for doc in range(len(text)):
            own = words[text.first[doc] : text.first[doc + 1]]
            for window in range(len(own) // index.longest + 1):
                passage = set(own[window * index.longest : (window + 2) * index.longest].tolist())
                for item in range(100):
                    score = sum(impacts.get((t, item), 0) for t in passage)
                    if score >= dc.THRESHOLD - 1e-9:
                        want[doc, window, item] = score
        assert got.keys() == want.keys()
        assert all(abs(got[key] - want[key]) < 1e-9 for key in want)


def index_of(items):
    hashed = dc._hashes([t for _, t in items])
    terms, counts = np.unique(np.concatenate([np.unique(h) for h in hashed]).view(np.int64), return_counts=True)
    inverse = np.log(1 + (len(items) - counts + 0.5) / (counts + 0.5))
    by_term = dict(zip(terms.tolist(), inverse.tolist(), strict=True))
    return dc.build([k for k, _ in items], [t for _, t in items], by_term, float(np.mean([len(h) for h in hashed])))


def test_runs_of_any_size_retrieve_the_same(monkeypatch):
    random_ = random.Random(9)
    items = [(k, frames.text(random_, random_.randint(3, 20))) for k in range(300)]
    index = index_of(items)
    texts = [frames.text(random_, 200) + " " + items[k][1] for k in range(40)] + ["", "one", items[0][1]]
    found = []
    for most in (1, 50, 400_000):
        monkeypatch.setattr(dc, "RUN_ENTRIES", most)
        for _, _, text in dc._texts(pa.array(texts)):
            found.append(dc.retrieve(index, text, text.words()))
    for other in found[1:]:
        assert all((a == b).all() for a, b in zip(found[0][:3], other[:3], strict=True))
        assert np.allclose(found[0][3], other[3])
    assert len(found[0][0]) >= 41


def test_a_long_text_and_many_short_items_take_bounded_memory():
    import tracemalloc

    random_ = random.Random(10)
    items = [(k, frames.text(random_, 10)) for k in range(8000)]
    index = index_of(items)
    text = frames.text(random_, 40_000) + " " + items[77][1]
    tracemalloc.start()
    ((row, item, score, *_),) = {f for f in dc.search(index, pa.array([text])) if f[1] == 77}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (row, item) == (0, 77) and score > 0.99
    assert peak < 250e6
