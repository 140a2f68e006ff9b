import math
import random
import zlib
from collections import Counter

import numpy as np

from auditlake.llm import recurrent_lm as lm

from . import frames


def vocabulary(own, other=None):
    other = np.ones((2, lm.ENDINGS), dtype=np.int64) if other is None else other
    rank = {b"w%d" % k: k for k in range(len(own))}
    return lm.Vocabulary({}, rank, np.array(own), *other, 7, sum(own) + 71, len(own) + 65)


def test_probabilities_sum_to_one():
    model = lm.Model(vocabulary([50, 20, 10, 5] * 20))
    states = np.random.default_rng(1).normal(size=(4, lm.STATE)).astype(np.float32)
    outcomes = range(lm.OWN + 1 + lm.ENDINGS)
    total = sum(np.exp(model.output(states, np.full(4, t), False)[0]) for t in outcomes)
    assert np.allclose(total, 1, atol=1e-4)


def test_the_words_of_all_classes_share_one_softmax(monkeypatch):
    """As few passes over a window's targets as classes and words need, with the values of each target alone."""
    random_ = np.random.default_rng(6)
    model = lm.Model(vocabulary([9] * 300))
    for name in ("class", "word"):
        model.weights[name] = random_.normal(size=model.weights[name].shape).astype(np.float32)
    states = random_.normal(size=(500, lm.STATE)).astype(np.float32)
    targets = random_.integers(0, 300, 500)
    targets[::5] = lm.OWN + targets[::5] % (lm.ENDINGS + 1)
    alone = [model.output(states[[k]], targets[[k]], True) for k in range(500)]
    passes, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *args, **kwargs: passes.append(1) or exp(*args, **kwargs))
    found, slope, slopes = model.output(states, targets, True)
    assert len(passes) == 2
    assert np.allclose(found, [a[0][0] for a in alone], atol=1e-4)
    assert np.allclose(slope, np.concatenate([a[1] for a in alone]), atol=1e-4)
    for name in ("class", "class_bias", "word", "word_bias"):
        assert np.allclose(slopes[name], sum(a[2][name] for a in alone), atol=1e-2), name


def test_reading_side_by_side_equals_reading_alone():
    """The state is carried over windows, and batches and padding don't matter."""
    random_ = np.random.default_rng(2)
    model = lm.Model(vocabulary([9] * 200))
    model.weights["class"] = random_.normal(size=model.weights["class"].shape).astype(np.float32)
    ids = [np.append(random_.integers(0, lm.OWN + 1 + lm.ENDINGS, n), lm.OWN).astype(np.int32) for n in (0, 1, 15, 16, 17, 90)]
    ids = [np.where((d < lm.OWN) & (d >= 200), d % 200, d) for d in ids]
    together = model.read(ids)
    for document, expected in zip(ids, together, strict=True):
        state, previous, total = np.zeros((1, lm.STATE), dtype=np.float32), lm._BEGIN, 0.0
        for target in document:
            x = model.weights["embedding"][[previous]] @ model.weights["inward"] + model.weights["inward_bias"]
            state = model.step(x, state)[-1]
            total += float(model.output(state, np.array([target]), False)[0][0])
            previous = target - (target >= lm.OWN)
        assert abs(total - expected) < 1e-2 + 1e-4 * abs(total)


def test_slopes_agree_with_differences(monkeypatch):
    monkeypatch.setattr(lm, "STREAMS", 2)
    random_ = np.random.default_rng(3)
    ids = [np.append(random_.integers(0, 60, 7), lm.OWN).astype(np.int32) for _ in range(4)]
    model = lm.Model(vocabulary([9] * 60))
    for name in ("class", "word"):
        model.weights[name] = random_.normal(size=model.weights[name].shape).astype(np.float32)
    kept = {}
    monkeypatch.setattr(model, "_adapt", lambda slopes, rows, vectors, *_: kept.update(slopes))
    model.learn(ids, 1.0, {})
    for name in ("across", "inward", "class", "word_bias"):
        slope = kept[name]
        place = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        loss = []
        for step in (1e-2, -1e-2):
            model.weights[name][place] += step
            loss.append(-model.read(ids).sum())
            model.weights[name][place] -= step
        assert abs((loss[0] - loss[1]) / 2e-2 - slope[place]) < 0.05 * abs(slope[place]) + 1e-2, name


def test_base_and_counts_by_hand(spark):
    random_ = random.Random(4)
    rows = [(k, frames.text(random_, random_.randint(0, 60))) for k in range(150)] + frames.AWKWARD
    found = lm.scores(frames.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    tokens, counts = [], Counter()
    for doc_id, text in rows:
        words = [*(text or "").encode().lower().split(), None]
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
        tokens.append((doc_id, held, words))
        if not held:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc_id, held, words in tokens:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want.append((doc_id, held, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    got = [(*tuple(r)[:5], round(r.base_score, 6)) for r in found]
    assert sorted(got, key=frames.key) == sorted(want, key=frames.key)
    assert all(r.score < 0 for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_words_that_are_not_sent_meet_their_counts_in_a_join(spark, monkeypatch):
    random_ = random.Random(5)
    rows = [(k, frames.text(random_, 30)) for k in range(60)]
    whole = {r.doc_id: r for r in lm.scores(frames.documents(spark, rows)).collect()}
    monkeypatch.setattr(lm, "SENT", 50)
    for row in lm.scores(frames.documents(spark, rows)).collect():
        assert row.n_known == whole[row.doc_id].n_known
        assert abs(row.base_score - whole[row.doc_id].base_score) < 1e-6


def test_the_network_learns_from_every_training_document(spark, monkeypatch):
    """Each document has a word of its own; reading it changes that word's embedding."""
    monkeypatch.setattr(lm, "START_ROWS", 1)
    rows = [(k, f"level own{k}word level gauge") for k in range(80)]
    texts = frames.documents(spark, rows).select("doc_id", "text", lm.held_out(lm.FOLDS, lm.HELD_OUT).alias("held_out"))
    vocabulary = lm.vocabulary_of(lm.counted(texts))
    model, before = lm.Model(vocabulary), lm.Model(vocabulary).weights["embedding"]
    model.set_flat(lm.trained(texts, vocabulary))
    for doc_id, _ in rows:
        if zlib.crc32(str(doc_id).encode()) % 7 != 2:
            place = vocabulary.rank[b"own%dword" % doc_id]
            assert np.any(model.weights["embedding"][place] != before[place]), doc_id


def test_repeated_ids_do_not_widen_the_first_task(spark, monkeypatch):
    read = []
    monkeypatch.setattr(lm, "START_ROWS", 20)
    monkeypatch.setattr(lm, "_averaged", lambda sample, *_: read.append(sample.count()))
    texts = frames.documents(spark, [(1, f"level {k}") for k in range(300)]).selectExpr("doc_id", "text", "false AS held_out")
    lm.trained(texts, lm.vocabulary_of(lm.counted(texts)))
    assert read[0] == 20 and sum(read[1:]) == 300


def test_without_training_documents(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = lm.scores(frames.documents(spark, [(held, "a b")])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0)
    assert lm.scores(frames.documents(spark, [])).count() == 0
