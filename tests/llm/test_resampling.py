import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from auditlake.llm import resampling as rs
from auditlake.llm import words

from . import frames

LONG = "word" * 40


def feature_list(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return found + [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


def bucket_list(text, buckets=rs.BUCKETS):
    return [zlib.crc32(f.encode()) % buckets for f in feature_list(text)]


def brute_force(rows, target):
    """Brute force, with the ranks of equal rows in any order."""
    s = Counter(b for _, text in rows for b in bucket_list(text))
    t = Counter(b for text in target for b in bucket_list(text))
    total_s, total_t = s.total() + 10_000.0, t.total() + 10_000.0
    out = []
    for doc_id, text in rows:
        own = bucket_list(text)
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * total_s / ((s[b] + 1.0) * total_t))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        name = "" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    n = 25 * len(able) // 100
    ranked = [(*r, k + 1 if k < n else None) for k, r in enumerate(able)]
    return ranked + [(*r, None) for r in out if r[1] < 39], n


def test_checksums_of_words_and_pairs():
    texts = ["A bc  déf 9z", LONG + " x " + LONG + "y a", "", "one", "x " + "longer" * 30]
    for _, _, text in words.texts(pa.array(texts), rs.NOT_WORD):
        single = rs.word_checksums(text)
        doc, pair = rs.pair_checksums(text, single)
        got = [list(single[text.doc == k]) + list(pair[doc == k]) for k in range(len(texts))]
        assert got == [[zlib.crc32(f.encode()) for f in feature_list(t)] for t in texts]


def test_bit_planes_give_whole_sums():
    random_ = np.random.default_rng(1)
    gain = random_.integers(-40_000, 40_000, 10_000)
    gain[:5] = (0, 1, -1, 32_768, -32_768)
    doc, bucket = np.repeat(np.arange(7), 3000), random_.integers(0, 50, 21_000) ** 2
    doc[doc == 3] = 4  # a text without features
    expected = np.bincount(doc, weights=gain[bucket], minlength=7).astype(int)
    assert (rs.gain_sums(7, doc, bucket, *rs.gain_planes(gain)) == expected).all()
    assert (rs.gain_sums(2, doc[:0], bucket[:0], *rs.gain_planes(gain)) == 0).all()
    assert (rs.gain_sums(7, doc, bucket, *rs.gain_planes(np.zeros(10_000, dtype=np.int64))) == 0).all()


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=frames.key)


def test_against_brute_force(spark):
    random_ = random.Random(5)
    rows = frames.AWKWARD + [(i, frames.text(random_, random_.randint(1, 80))) for i in range(300)]
    rows += [(911, "B" + LONG + " " + frames.text(random_, 60)), (5, rows[40][1]), (5, rows[40][1])]
    target = [frames.text(random_, 30) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    found = rows_of(rs.resample(frames.documents(spark, rows), frame))
    expected, n = brute_force(rows, target)
    assert found == sorted(expected, key=frames.key)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, n + 1))
    ids = rs.drawn(frames.documents(spark, rows), frame)
    assert ids.count() == n


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "text string")
    assert rs.resample(frames.documents(spark, []), none).count() == 0
    some = frames.documents(spark, [(1, "a b"), (2, None)])
    assert [r[:3] for r in rows_of(rs.resample(some, none))] == [(1, 3, math.floor(1000 * math.log(10_003 / 20_000))), (2, 0, 0)]
    assert rs.resample(frames.documents(spark, []), none).columns == ["doc_id", "n_features", "weight", "score", "rank"]
