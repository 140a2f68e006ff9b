import random

import numpy as np
import pyarrow as pa

from auditlake.llm import quality, toxicity, words

from . import frames


def labelled(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id bigint, {column} int")


def sets(texts):
    return [f.astype(np.int32) for f in toxicity.feature_sets(pa.array([t.lower() for t in texts]))]


def test_the_counterfactual_penalty_mends_scores_of_neutral_mentions():
    """In the labelled rows nearly all sentences on one group are toxic; with the penalty a mention alone isn't."""
    random_ = random.Random(5)
    texts, labels = [], []
    for n in range(600):
        toxic = n % 3 == 0
        group = "muslims" if toxic or random_.random() < 0.02 else random_.choice(["christians", "people"])
        insult = random_.choice(["awfulscum", "nastytrash"]) if toxic and random_.random() < 0.8 else "arrived"
        texts.append(f"The {group} {insult} by {frames.text(random_, 5)}.")
        labels.append(float(toxic))
    pairs = [p for t in texts for p in toxicity.swaps(t.lower())]
    before, after = sets([p[0] for p in pairs]), sets([p[1] for p in pairs])
    plus = [np.setdiff1d(b, a) for a, b in zip(before, after, strict=True)]
    minus = [np.setdiff1d(a, b) for a, b in zip(before, after, strict=True)]
    scores = {}
    for strength in (0.0, 5.0):
        names, weights, bias = toxicity.fit(np.array(labels), sets(texts), plus, minus, strength, shrink=0.05)
        probe = sets(["the muslims arrived by boat", "the christians arrived by boat", "the people awfulscum by boat"])
        scores[strength] = 1 / (1 + np.exp(-toxicity.Rows(probe, names).times(weights) - bias))
    assert scores[0.0][0] - scores[0.0][1] > 0.3
    assert abs(scores[5.0][0] - scores[5.0][1]) < 0.15
    assert scores[5.0][0] < toxicity.THRESHOLD < scores[5.0][2]


def test_sparse_rows_sum_like_dense_ones():
    random_ = np.random.default_rng(3)
    names = np.sort(random_.choice(5000, 300, replace=False))
    rows = [np.sort(random_.choice(5000, n, replace=False)).astype(np.int32) for n in (0, 7, 900, 0, 4000, 1, 0)]
    dense = np.array([[float(name in row) for name in names] for row in map(set, rows)])
    own = toxicity.Rows(rows, names)
    weights, values = random_.normal(size=300), random_.normal(size=len(rows))
    assert np.allclose(own.times(weights), dense @ weights) and np.allclose(own.back(values), values @ dense)
    assert own.heaviest == dense.sum(axis=1).max()
    none = toxicity.Rows([], names)
    assert none.times(weights).shape == (0,) and (none.back(np.zeros(0)) == 0).all()


def test_the_fit_ends_where_no_weight_lowers_the_loss():
    random_ = np.random.default_rng(4)
    rows = [np.sort(random_.choice(60, 12, replace=False)).astype(np.int32) for _ in range(200)]
    labels = np.array([float(3 in r or 5 in r) for r in rows])
    plus, minus = [np.array([3], dtype=np.int32)] * 4, [np.array([7], dtype=np.int32)] * 4
    names, weights, bias = toxicity.fit(labels, rows, plus, minus, strength=0.5, shrink=0.02, steps=600)

    def loss(w, b):
        by_name = dict(zip(names.tolist(), w, strict=True))
        z = np.array([sum(by_name.get(f, 0.0) for f in r.tolist()) for r in rows]) + b
        change = [sum(by_name.get(f, 0.0) for f in p) - sum(by_name.get(f, 0.0) for f in m) for p, m in zip(plus, minus, strict=True)]
        return np.logaddexp(0, z).sum() - (labels * z).sum() + 0.25 * np.square(change).sum() + toxicity.REFIT * np.abs(w).sum()

    least = loss(weights, bias)
    for k in range(len(names)):
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += step
            assert loss(moved, bias) >= least - 1e-3
    assert min(loss(weights, bias + 0.05), loss(weights, bias - 0.05)) >= least - 1e-3


def test_scores_are_those_of_plain_counts(spark):
    """Word by word: whole words and beginnings, once for each level that their count reaches."""
    random_ = np.random.default_rng(5)
    texts = ["You vile vile VILE vileword", "", "a b é vile", "vileword " * 5]
    model = {int(f): float(w) for f, w in zip(random_.choice(3 * toxicity.SPACE, 900_000, replace=False), random_.normal(size=900_000), strict=True)}
    score = toxicity.scorer(spark, model | {-1: 0.25})(pa.array(texts))
    for text, found in zip(texts, score, strict=True):
        counts = {}
        for word in text.lower().split():
            parts = [(word, 0)] + [(word.encode()[:n], n) for n in toxicity.BEGINNINGS if len(word.encode()) >= n]
            for part, salt in parts:
                own = next(words.texts(pa.array([part if isinstance(part, str) else part.decode("utf-8", "ignore")]), words.NOT_LETTER))[2]
                feature = int(words.salted(own.words(), salt)[0] & np.uint64(toxicity.SPACE - 1))
                counts[feature] = counts.get(feature, 0) + 1
        total = 0.25 + sum(
            np.float32(model.get(f + k * toxicity.SPACE, 0.0)) for f, n in counts.items() for k, least in enumerate(toxicity.LEVELS) if n >= least
        )
        assert abs(found - 1 / (1 + np.exp(-total))) < 1e-5


def test_swaps_change_names_of_groups_only():
    assert toxicity.swaps("nothing here. old men talk.\nthe end") == [("old men talk", "young girls talk")]
    assert toxicity.swaps("manic") == []


def corpus(random_, n, marked, filler):
    rows = [(k, frames.text(random_, 40) + (" " + marked if k % 4 == 0 else "") + filler(k)) for k in range(n)]
    return rows, [(k, int(k % 4 == 0)) for k in range(n)]


def test_toxicity_of_awkward_rows(spark):
    rows, labels = corpus(random.Random(6), 300, "you vileword vileword", lambda k: "")
    labels += [(None, 1), (3, None), (8, 0)]
    documents = frames.documents(spark, rows + frames.AWKWARD)
    found = toxicity.toxicity(documents, labelled(spark, labels, "toxic")).collect()
    assert len(found) == len(rows) + len(frames.AWKWARD)
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7) for row in found)
    assert {row.doc_id for row in found if row.predicted} == {k for k in range(300) if k % 4 == 0}
    left = toxicity.without_toxic(documents, labelled(spark, labels, "toxic"))
    assert left.columns == documents.columns
    assert left.count() == len(found) - 75


def test_without_labels_or_documents(spark):
    none = labelled(spark, [], "toxic")
    assert [r.score for r in toxicity.toxicity(frames.documents(spark, [(1, "a"), (2, None)]), none).collect()] == [0, 0]
    assert toxicity.toxicity(frames.documents(spark, []), none).count() == 0
    none = labelled(spark, [], "quality")
    assert [r.score for r in quality.quality(frames.documents(spark, [(1, "a")]), none).collect()] == [0.5]
    assert quality.quality(frames.documents(spark, []), none).count() == 0


def test_trees_follow_their_arrays():
    random_ = np.random.default_rng(7)
    x = random_.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    model = quality.grow(x, y, trees=30)
    assert ((model.scores(x) > 0.5) == (y == 1)).mean() > 0.97
    for row in x[:50]:
        total = model.start
        for feature, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - model.raw(row[None])[0]) < 1e-9


def test_quality_of_awkward_rows(spark):
    rows, labels = corpus(random.Random(8), 300, "", lambda k: "" if k % 4 == 0 else " ### $$$ !!!" * 9)
    labels += [(None, 1), (3, None)]
    documents = frames.documents(spark, rows + frames.AWKWARD)
    found = quality.quality(documents, labelled(spark, labels, "quality")).collect()
    assert len(found) == len(rows) + len(frames.AWKWARD)
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3) for row in found)
    assert {r.doc_id for r in found if r.predicted and r.doc_id in range(300)} == {k for k in range(0, 300, 4)}
    assert quality.of_quality(documents, labelled(spark, labels, "quality")).columns == documents.columns


def test_statistics_do_not_depend_on_neighbours():
    texts = [t or "" for _, t in frames.AWKWARD]
    alone = [quality.statistics(next(words.texts(pa.array([t])))[2]) for t in texts]
    both = [quality.statistics(t) for _, _, t in words.texts(pa.array(texts))]
    assert np.allclose(np.concatenate(alone), np.concatenate(both))
    assert both[0].shape[1] == quality.STATISTICS and np.isfinite(np.concatenate(both)).all()
