"""MinHash near-dedup by fast similarity sketching.

A document's set holds its distinct five-word shingles. Rounds of hashed bin placement fill a sketch: in
round i every shingle goes to one hashed bin with a value above those of all earlier rounds; a bin keeps its
least value, and in the second half of the rounds every shingle goes to bin i - t, so that every coordinate
is filled whatever the size of the set. Two sketches agree in a coordinate with a probability equal to the
likeness of the sets. Four coordinates make a band; texts that share a band are candidates, and the
candidates' whole sets are compared.

Documents with equal sets are one class from the start. Each class is compared with the least and the
greatest of the likely ones among the first and last classes of its bands, and after that only across groups that are
not connected yet, so that a group of n copies costs about n comparisons. Across groups, a pair is compared once, in the first band
that it shares, and only if enough of both sets occurs in other groups at all. With 48 bands of four coordinates a pair at the
threshold of 0.75 shares none with a probability of 1e-8. Before whole sets are compared, pairs are left
out that differ in too many of 256 one-bit coordinates: 61 or more have a probability of 4e-8 at 0.75.

Cases: NULL, empty and blank texts have empty sets and are linked with nothing. A text with fewer than five
words has its whole sequence as its one shingle. Rows of one doc_id are one document and share a component.
Rows without doc_id have no component and are kept. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.shared import components, cut, table

SHINGLE = 5
BINS = 256
BANDS = 48
ROWS = 4
FAR_BITS = 61
MAP_WORDS = 16
_SEEDS = words.mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def similarity_sketch(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes: ``bins`` values, all of them filled."""
    sketch = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    need = int(np.ceil(bins * (np.log(bins) + 3) / len(values)))
    done = 0
    while done < bins:
        rounds = np.arange(done, min(bins, done + max(1, min(need, 1 + 200_000 // len(values)))))
        hashed = words.mix(values[None, :] ^ _SEEDS[rounds][:, None])
        value = (rounds.astype(np.uint64) << np.uint64(48))[:, None] | (hashed >> np.uint64(16))
        np.minimum.at(sketch, (hashed % np.uint64(bins)).astype(np.int64).ravel(), value.ravel())
        done = int(rounds[-1]) + 1
        if sketch.max() != np.iinfo(np.uint64).max:
            return sketch
    for place in np.flatnonzero(sketch == np.iinfo(np.uint64).max):
        hashed = words.mix(values ^ _SEEDS[bins + place])
        sketch[place] = (np.uint64(bins + place) << np.uint64(48)) | (hashed.min() >> np.uint64(16))
    return sketch


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One hash for each band; equal values in different bands give different keys."""
    used = sketch[: BANDS * ROWS].reshape(BANDS, ROWS)
    places = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64).reshape(BANDS, ROWS)
    return words.mix(words.mix(used + places * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    for _, _, text in words.texts(column):
        values, first = text.shingles(text.words(), SHINGLE)
        for k in range(len(text)):
            found = np.sort(values[first[k] : first[k + 1]])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, classes = [], []
        bands = np.zeros((batch.num_rows, BANDS), dtype=np.uint64)
        bits = np.zeros((batch.num_rows, BINS // 64), dtype=np.uint64)
        for k, found in enumerate(_sets(words.text_column(batch))):
            sizes.append(len(found))
            if not len(found):
                classes.append(None)
                continue
            both = [int(words.salted(found, salt).sum(dtype=np.uint64)) for salt in (1, 2)]
            classes.append(both[0].to_bytes(8, "big") + both[1].to_bytes(8, "big"))
            sketch = similarity_sketch(found)
            bands[k] = band_keys(sketch)
            bits[k] = np.packbits((words.mix(sketch) & np.uint64(1)).astype(np.uint8)).view(np.uint64)
        columns = {"doc_id": batch.column(0).cast(pa.int64()), "n_shingles": pa.array(sizes, pa.int64())}
        columns["class"] = pa.array(classes, pa.binary())
        flat = pa.array(bands.view(np.int64).ravel())
        columns["bands"] = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS, flat)
        columns |= {f"bits{k}": pa.array(bits[:, k].view(np.int64)) for k in range(BINS // 64)}
        yield pa.RecordBatch.from_pydict(columns)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(_sets(words.text_column(batch)))
        maps = np.zeros((len(sets), MAP_WORDS * 64), dtype=np.uint8)
        for k, found in enumerate(sets):
            maps[k, (found % np.uint64(MAP_WORDS * 64)).astype(np.int64)] = 1
        maps = np.packbits(maps, axis=1).view(np.int64).reshape(len(sets), MAP_WORDS)
        columns = {"node": batch.column(0), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}
        yield pa.RecordBatch.from_pydict(columns | {f"map{k}": pa.array(maps[:, k]) for k in range(MAP_WORDS)})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("left_set"), batch.column("right_set"), strict=True):
            one, two = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (left, right))
            both = np.sort(np.concatenate((one, two)))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= 75 * (len(one) + len(two) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each set."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column("shingles")]
        if sets:
            rows = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            columns = {c: batch.column(c).take(rows) for c in ("node", "part")}
            yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(sets), **columns})


def _likely(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs of classes whose sizes and one-bit coordinates allow a likeness of 0.75."""
    left, right = (_side(facts.drop("brief"), s) for s in "ab")
    return pairs.join(left, "a").join(right, "b").filter(_near()).select("a", "b")


def _side(frame: DataFrame, side: str) -> DataFrame:
    """Columns of one side of a pair: the node bears the side's name, the rest begins with it."""
    return frame.select(*(F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in frame.columns))


def _near() -> Column:
    differ = sum(F.bit_count(F.col(f"a_bits{k}").bitwiseXOR(F.col(f"b_bits{k}"))) for k in range(BINS // 64))
    return (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * 75) & (differ < FAR_BITS)


def _rest(shared: DataFrame, grown: DataFrame, facts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that share a band, aren't connected yet and may be alike, each once.

    Shingles that no other group of these bands has can't be shared across groups; the others of a set bound what
    it shares with any. A bit that only one set of a pair has stands for a shingle at least that the other lacks.
    """
    part = F.coalesce("component", "node").alias("part")
    named = shared.select("band", "place", "node").join(grown, "node", "left").select("band", "place", "node", part)
    split = named.groupBy("band").agg(F.min("part").alias("one"), F.max("part").alias("two")).filter("one < two")
    alive = cut(named.join(split.select("band"), "band", "left_semi"))
    tokens = cut(
        sets.join(alive.select("node", "part").distinct(), "node").mapInArrow(
            _tokens, "shingle bigint, node bigint, part bigint"
        )
    )
    common = tokens.groupBy("shingle").agg(F.min("part").alias("one"), F.max("part").alias("two")).filter("one < two")
    common = tokens.join(common.select("shingle"), "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("most"))
    able = facts.join(common, "node").filter("100 * most >= 75 * n")
    left = cut(alive.join(able, "node").join(sets.drop("shingles"), "node"))
    most = F.least("a_most", "b_most")
    first = F.array_position(F.zip_with("a_brief", "b_brief", lambda x, y: x == y), True)
    sides = (F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part"))

    def lacks(one: str, two: str) -> Column:
        bits = (F.col(f"{one}_map{k}").bitwiseAND(F.bitwise_not(F.col(f"{two}_map{k}"))) for k in range(MAP_WORDS))
        return F.col(f"{one}_n") - sum(F.bit_count(b) for b in bits)

    sizes = F.col("a_n") + F.col("b_n")
    bound = most * 175 >= sizes * 75
    exact = F.least(lacks("a", "b"), lacks("b", "a")) * 175 >= sizes * 75
    one, two = _side(left, "a"), _side(left, "b")
    pairs = one.join(two, (one.a_band == two.b_band) & sides & bound & _near() & exact & (first == F.col("a_place") + 1))
    return pairs.select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose whole sets are alike."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_compare, "a bigint, b bigint")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``documents`` (doc_id, text)."""
    pair = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kinds = "doc_id bigint, n_shingles bigint, class binary, bands array<bigint>"
    bits = [f"bits{k}" for k in range(BINS // 64)]
    signed = cut(pair.mapInArrow(_sketches, kinds + "".join(f", {c} bigint" for c in bits)))

    full = signed.filter("class is not null and doc_id is not null")
    classes = full.groupBy("class").agg(F.min("doc_id").alias("node"))
    nodes = full.select("class", "n_shingles", "bands", *bits, F.col("doc_id").alias("node")).join(
        classes, ["class", "node"], "left_semi"
    )
    banded = nodes.select("node", F.posexplode("bands").alias("place", "band"))
    meet = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    shared = cut(banded.join(meet, "band").select("band", "place", "node", "low", "high"))
    near = cut(shared.select("node").distinct())
    brief = F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("brief")
    facts = cut(nodes.select("node", F.col("n_shingles").alias("n"), *bits, brief).join(near, "node", "left_semi"))
    texts = pair.withColumnRenamed("doc_id", "node").join(near, "node", "left_semi")
    maps = "".join(f", map{k} bigint" for k in range(MAP_WORDS))
    sets = cut(texts.mapInArrow(_whole_sets, "node bigint, shingles binary" + maps))

    def ordered(one: str, two: str) -> list:
        return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]

    low = shared.select(*ordered("node", "low"))
    stars = cut(_likely(low.union(shared.select(*ordered("node", "high"))).filter("a < b").distinct(), facts))
    ends = stars.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("greatest"))
    ends = ends.select(F.explode(F.array_distinct(F.array("least", "greatest"))).alias("a"), "b")
    grown = components(_verified(ends, sets))
    found = _verified(_rest(shared, grown, facts, sets), sets)
    same_id = full.join(classes, "class").filter("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    grown = components(found.union(_as_links(grown)).union(same_id))

    answer = signed.select("doc_id", "n_shingles").join(grown.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return answer.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _as_links(grown: DataFrame) -> DataFrame:
    return grown.select(F.col("component").alias("a"), F.col("node").alias("b"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` for each component: that of the least doc_id. All columns stay.

    Of rows that repeat a doc_id the one with the least hash stays; rows without doc_id stay all.
    """
    found = near_duplicates(documents).filter("doc_id is not null")
    found = found.groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("rows"))
    fate = cut(found.select(F.col("doc_id").alias("_doc"), "kept", (F.col("rows") > 1).alias("_again")).filter("kept"))
    fate = fate.select("_doc", "_again")
    joined = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"))
    without = joined.filter("_doc is null").select("_row.*")
    joined = joined.filter("_doc is not null").join(fate, "_doc")
    single = joined.filter("not _again").select("_row.*")
    again = joined.filter("_again").groupBy("_doc").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return single.union(again.select("_row.*")).union(without)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, over the whole table."""
    return near_duplicates(table(spark, sf_dir, "documents"))
