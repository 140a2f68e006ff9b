import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from auditlake.llm import suffix_dedup as sd

from . import frames


def brute_force(rows, length, keep_first=False):
    """Result of each row: every window of every text in one table."""
    places = defaultdict(list)
    texts = [(text or "").encode() for _, text in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for rank, k in enumerate(order):
        for start in range(len(texts[k]) - length + 1):
            places[texts[k][start : start + length]].append((rank, start, k))
    gone = [bytearray(len(t)) for t in texts]
    for found in places.values():
        for _, start, k in found[1:] if keep_first else found * (len(found) > 1):
            gone[k][start : start + length] = b"\1" * length
    out = []
    for (doc_id, _), text, marks in zip(rows, texts, gone, strict=True):
        kept = bytes(b for b, g in zip(text, marks, strict=True) if not g)
        spans = sum(marks[k] and not (k and marks[k - 1]) for k in range(len(marks)))
        out.append((doc_id, len(text), sum(marks), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=frames.key)


def results(frame):
    return sorted((tuple(r) for r in frame.collect()), key=frames.key)


def mixed(random_, n):
    """Texts that share passages, some at their ends, some inside, some of them twice, some with one character changed."""
    passages = [frames.text(random_, random_.randint(3, 25)) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [frames.text(random_, random_.randint(1, 12)) for _ in range(random_.randint(1, 3))]
        for _ in range(random_.randint(0, 2)):
            passage = random_.choice(passages)
            if random_.random() < 0.4:
                at = random_.randrange(len(passage))
                passage = passage[:at] + random_.choice("é#ß") + passage[at + 1 :]
            parts.insert(random_.randint(0, len(parts)), passage)
        rows.append((k, random_.choice((" ", "\n")).join(parts)))
    return rows


def test_suffix_and_factor_arrays():
    random_ = np.random.default_rng(1)
    for depth in (3, 8, 13, 40):
        data = random_.integers(97, 99, 300).astype(np.uint8)
        data[150:260] = data[20:130]
        starts = np.sort(random_.choice(300 - depth, 150, replace=False))
        order, common = sd.suffix_array(data, starts, depth)
        raw = data.tobytes()
        cut = [raw[s : s + depth] for s in starts]
        assert list(order) == sorted(range(150), key=lambda k: cut[k])

        def match(a, b, cut=cut, depth=depth):
            return next((k for k in range(depth) if cut[a][k] != cut[b][k]), depth)

        assert list(common[1:]) == [match(a, b) for a, b in zip(order, order[1:], strict=False)]
        longest = sd.longest_previous(starts[order], common)
        assert list(longest) == [max((match(j, k) for k in range(j)), default=0) for j in order]
        assert list(sd.longest_previous(starts[order], common, 5)) == [x if x >= 5 else 0 for x in longest]


def test_pieces_make_no_difference(monkeypatch):
    random_ = random.Random(2)
    data = np.frombuffer(frames.text(random_, 3000).encode(), dtype=np.uint8)
    offsets = np.array([0, 5, 5, 9000, len(data)])

    def spread(found):
        starts = [np.arange(w) + s + offsets[t] for t, s, w in zip(found["text"], found["start"], found["windows"], strict=True)]
        return np.concatenate(starts), np.repeat(found["anchor"] + offsets[found["text"]], found["windows"])

    whole = spread(sd.segments(data, offsets, 100, 20))
    monkeypatch.setattr(sd, "PIECE", 1000)
    cut = spread(sd.segments(data, offsets, 100, 20))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    expected = [k for a, b in zip(offsets, offsets[1:], strict=False) for k in range(a, b - 99)]
    assert list(whole[0]) == expected


@pytest.mark.parametrize("keep_first", (False, True))
def test_against_brute_force(spark, keep_first):
    rows = frames.AWKWARD + mixed(random.Random(3), 120)
    rows += [(3000, "ab" * 400), (3001, "xy" + "ab" * 150), (3002, frames.text(random.Random(4), 200)), (3003, "é" * 300)]
    if keep_first:
        rows = list(dict.fromkeys(rows))  # equal rows count as one text there
    found = results(sd.deduplicated(frames.documents(spark, rows), 80, keep_first))
    expected = brute_force(rows, 80, keep_first)
    assert found == expected
    assert sum(r[2] > 0 for r in expected) > 40


@pytest.mark.parametrize("keep_first", (False, True))
def test_crowded_anchors_are_counted_alike(spark, monkeypatch, keep_first):
    random_ = random.Random(5)
    passage = frames.text(random_, 20)
    rows = [(k, frames.text(random_, 9) + passage + frames.text(random_, 9)) for k in range(60)]
    rows += [(100 + k, rows[k][1][: 150 + k]) for k in range(8)]
    expected = brute_force(rows, 90, keep_first)
    monkeypatch.setattr(sd, "MOST_SEGMENTS", 5)
    assert results(sd.deduplicated(frames.documents(spark, rows), 90, keep_first)) == expected


def test_what_is_left_is_given_as_bytes(spark):
    same = frames.text(random.Random(6), 60)
    rows = [(1, "before " + same), (2, same + "\nafter"), (3, None)]
    found = {r.doc_id: bytes(r.kept) for r in sd.deduplicated(frames.documents(spark, rows), with_bytes=True).collect()}
    assert found == {1: b"before ", 2: b"\nafter", 3: b""}


def test_an_empty_table(spark):
    assert sd.deduplicated(frames.documents(spark, [])).count() == 0
