"""Target-distribution importance resampling by bit-sliced aggregation.

Features are the words of a text and their pairs, hashed into buckets. A bucket's gain tells how much likelier it is
in the target texts than in the documents. A document's weight is the floored mean of the gains of its features:
its bucket counts become bit planes (plane j holds bit j of every count), the gains become planes for each bit and
sign; a plane of the counts AND a plane of the gains, its ones counted and shifted by both bits, gives the exact sum
without a multiplication. Gumbel noise from a hash of the id is added to the weight; the documents with
the highest sums are a sample without replacement.

Ranks need no global sort: scores are whole numbers in a range that gains and noise bound (a few ten thousand values at
any size), so rows are counted by score, the counts are summed from the top, and rows are numbered within a score.

Cases: a NULL or empty text has no features, weight 0, and is never drawn. A NULL doc_id is hashed as the
empty text and comes last among ties. Rows that are equal in id and score are drawn in the order of their number of features;
repeated rows count each. Without target texts or documents every gain is that of empty counts. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.shared import cut, table

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
RUN = 64
SHORT = 64
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False


@functools.cache
def _crc_tables() -> np.ndarray:
    """What each byte of a checksum becomes when n zero bytes follow, n up to ``SHORT``; row 1, byte 0 is the usual table."""
    tables = np.empty((SHORT + 1, 4, 256), dtype=np.uint32)
    low = np.arange(256, dtype=np.uint32)
    for byte in range(4):
        tables[0, byte] = low << np.uint32(8 * byte)
    usual = low.copy()
    for _ in range(8):
        usual = (usual >> np.uint32(1)) ^ np.where(usual & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    for n in range(SHORT):
        tables[n + 1] = usual[tables[n] & np.uint32(255)] ^ (tables[n] >> np.uint32(8))
    return tables


def word_checksums(text: words.Texts) -> np.ndarray:
    """crc32 of each word."""
    usual = _crc_tables()[1, 0]
    length = text.end - text.start
    order = np.argsort(-length, kind="stable")
    ordered, start = length[order], text.start[order]
    value = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(min(SHORT, int(ordered[0])) if len(ordered) else 0):
        n = int(np.searchsorted(-ordered, -k, side="left"))  # the words longer than k come first
        byte = text.data[start[:n] + k]
        value[:n] = usual[(value[:n] ^ byte) & np.uint32(255)] ^ (value[:n] >> np.uint32(8))
    found = np.empty(len(order), dtype=np.uint32)
    found[order] = ~value
    for k in np.flatnonzero(length > SHORT):
        found[k] = zlib.crc32(text.data[text.start[k] : text.end[k]])
    return found


def pair_checksums(text: words.Texts, checksum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and crc32 of two consecutive words with a space between, from the checksums of the words.

    The checksum of a text that goes on is the first part's, moved by the length of the rest, XOR that of the rest.
    """
    tables = _crc_tables()
    first = np.flatnonzero(text.doc[:-1] == text.doc[1:]) if len(text.doc) else np.zeros(0, dtype=np.int64)
    begun = ~checksum[first]
    begun = ~(tables[1, 0][(begun ^ np.uint32(32)) & np.uint32(255)] ^ (begun >> np.uint32(8)))
    length = (text.end - text.start)[first + 1]
    n = np.minimum(length, SHORT)
    moved = tables[n, 0, begun & np.uint32(255)]
    for byte in range(1, 4):
        moved ^= tables[n, byte, (begun >> np.uint32(8 * byte)) & np.uint32(255)]
    pair = moved ^ checksum[first + 1]
    for k in np.flatnonzero(length > SHORT):
        pair[k] = zlib.crc32(text.data[text.start[first[k] + 1] : text.end[first[k] + 1]], int(begun[k]))
    return text.doc[first], pair


def features(column: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, text of each feature, its bucket) for runs of texts."""
    for row, stop, text in words.texts(column, NOT_WORD):
        single = word_checksums(text)
        doc, pair = pair_checksums(text, single)
        checksum = np.concatenate((single, pair)) % np.uint32(buckets)
        yield row, stop, np.concatenate((text.doc, doc)), checksum.astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; counted in each task, summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, _, bucket in features(words.text_column(batch), buckets):
                total += np.bincount(bucket, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": has.astype(np.int64), "n": total[has]})

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():  # one row for each bucket at most
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of how much likelier each bucket is in the target; one is added to each count."""
    most_s, most_t = float(source.sum() + len(source)), float(target.sum() + len(target))
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    ratios = [(t + 1.0) * most_s / ((s + 1.0) * most_t) for s, t in pairs]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the positive and of the negative gains, and the signed power of two that each stands for."""
    planes, powers = [], []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for bit in range(int(size.max(initial=0)).bit_length()):
            planes.append(np.packbits(((size >> bit) & 1).astype(np.uint8), bitorder="little"))
            powers.append(sign << bit)
    width = -(-len(gain) // 64)
    packed = np.zeros((len(planes), width * 8), dtype=np.uint8)
    for k, plane in enumerate(planes):
        packed[k, : len(plane)] = plane
    return packed.view(np.uint64), np.array(powers, dtype=np.int64)


def gain_sums(n: int, doc: np.ndarray, bucket: np.ndarray, planes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """The sum of the gains of the features of each of ``n`` texts, from bit planes of their bucket counts."""
    width = planes.shape[1]
    total = np.zeros(n, dtype=np.int64)
    place, count = np.unique(doc * (width * 64) + bucket, return_counts=True)
    for bit in range(int(count.max(initial=0)).bit_length()):
        at = place[(count >> bit) & 1 == 1]
        if not len(at):
            continue
        word = at >> 6
        begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        ones = np.uint64(1) << (at & 63).astype(np.uint64)
        plane = np.zeros(n * width, dtype=np.uint64)
        plane[word[begins]] = np.bitwise_or.reduceat(ones, begins)
        plane = plane.reshape(n, width)
        rows = np.flatnonzero(plane.any(axis=1))
        for gain, power in zip(planes, powers, strict=True):
            total[rows] += np.bitwise_count(plane[rows] & gain).sum(axis=1, dtype=np.int64) * (power << bit)
    return total


def weights(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight of each row of ``documents``."""
    planes, powers = gain_planes(gain)
    shared = documents.sparkSession.sparkContext.broadcast((planes, powers))  # some forty planes of one bit a bucket
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, powers = shared.value
        for batch in batches:
            n_features = np.zeros(batch.num_rows, dtype=np.int64)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for row, stop, doc, bucket in features(words.text_column(batch), buckets):
                n_features[row:stop] = np.bincount(doc, minlength=stop - row)
                order = np.argsort(doc, kind="stable")
                doc, bucket = doc[order], bucket[order]
                for low in range(0, stop - row, RUN):
                    high = min(low + RUN, stop - row)
                    a, b = np.searchsorted(doc, (low, high))
                    sums = gain_sums(high - low, doc[a:b] - low, bucket[a:b], planes, powers)
                    total[row + low : row + high] = sums
            weight = total // np.maximum(n_features, 1)  # rounds down
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_features": n_features, "weight": weight})

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint")


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise that a hash of seed and id gives."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((hashed + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("bigint"))


def ranked(scored: DataFrame, least_features: int, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` among the drawn rows: ``percent`` in a hundred of the rows with enough features."""
    able = F.col("n_features") >= least_features
    by_score = scored.filter(able).groupBy("score").agg(F.count("*").alias("_n"))
    # one row for each score: their number is bounded by the range of gains and noise, not by the rows
    from_top = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by_score = by_score.select(
        "score",
        F.coalesce(F.sum("_n").over(from_top), F.lit(0)).alias("_above"),
        F.floor(F.sum("_n").over(everything) * percent / 100).alias("_drawn"),
    )
    within = Window.partitionBy("score").orderBy(F.desc("_able"), F.asc_nulls_last("doc_id"), "n_features")
    rows = scored.withColumn("_able", able).join(by_score, "score", "left")
    rank = F.col("_above") + F.row_number().over(within)
    rank = F.when(F.col("_able") & (rank <= F.col("_drawn")), rank).cast("bigint")
    return rows.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``documents``; rank is NULL where it isn't drawn.

    ``target`` has a column ``text``. A text of n words has 2n - 1 features.
    """
    gain = gains(bucket_counts(documents, buckets), bucket_counts(target, buckets))
    scored = cut(with_scores(weights(documents, gain), seed))
    return ranked(scored, max(0, 2 * least_words - 1), percent)


def drawn(documents: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The ids of the drawn rows with their rank."""
    return resample(documents, target, **options).filter("rank IS NOT NULL").select("doc_id", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, with the benchmark texts as the target."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
