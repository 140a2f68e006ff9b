import random

import numpy as np

from auditlake.llm import near_dedup as nd

from . import frames


def brute_force(rows):
    """Component of each id: links by whole sets, one text at a time."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        shingles = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        if doc_id is not None:
            sets.setdefault(doc_id, shingles)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def copies(random_, n):
    """Groups of near copies on both sides of the threshold, chains of them, and a passage that many share."""
    rows, passage = [], frames.text(random_, 40)
    for group in range(n):
        base = frames.text(random_, 60).split()
        for copy in range(random_.randint(1, 6)):
            if copy:
                for _ in range(random_.randint(0, 3)):
                    base[random_.randrange(len(base))] = "edit" + str(random_.randint(0, 999))
            rows.append((1000 + len(rows), " ".join(base) + (" " + passage if group % 3 == 0 else "")))
    return rows


def test_against_brute_force(spark):
    rows = frames.AWKWARD + copies(random.Random(1), 60)
    found = nd.near_duplicates(frames.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = brute_force(rows)
    for row in found:
        if row.doc_id is None:
            assert (row.component_id, row.kept) == (None, True)
        else:
            assert (row.n_shingles, row.component_id) == expected[row.doc_id], row
            assert row.kept is (row.component_id == row.doc_id)


def test_one_row_of_each_group_stays(spark):
    rows = frames.AWKWARD + copies(random.Random(2), 20)
    documents = frames.documents(spark, rows)
    kept = nd.one_of_each(documents)
    assert kept.columns == documents.columns
    expected = {i for i, (_, component) in brute_force(rows).items() if i == component}
    ids = [row.doc_id for row in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expected)
    assert ids.count(None) == 2


def test_an_empty_table(spark):
    assert nd.near_duplicates(frames.documents(spark, [])).count() == 0
    assert nd.one_of_each(frames.documents(spark, [])).count() == 0


def test_sketches_estimate_likeness():
    random_ = np.random.default_rng(3)
    for size, share in ((3, 1), (40, 0.5), (3000, 0.8)):
        common = random_.integers(0, 2**63, int(size * share), dtype=np.uint64)
        one, two = (
            np.union1d(common, random_.integers(0, 2**63, size - len(common), dtype=np.uint64)) for _ in range(2)
        )
        likeness = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        a, b = nd.similarity_sketch(one), nd.similarity_sketch(two)
        assert a.max() < np.iinfo(np.uint64).max
        assert abs((a == b).mean() - likeness) < 0.13
