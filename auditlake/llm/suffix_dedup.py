"""Removal of repeated byte strings by suffix arrays and longest-previous-factor arrays.

A string of ``length`` bytes counts as repeated if it also starts anywhere else, in the same text or in another; strings
never cross texts. Either every byte of a repeated string goes (``keep_first`` off), or its first occurrence stays, by
doc_id and place (on).

No suffix array spans all texts. Every window of ``length`` bytes has an anchor, the run of ``GRAM`` bytes with the
least hash in it (the leftmost of equal ones). Equal windows have equal anchors at equal places, so windows meet by
the hash of their anchor. Windows in a row with the same anchor are one segment, of twice the anchor's surroundings at most.

1. Anchors that occur once are dropped; nothing near them is repeated. Segments that occur as a whole more than once are
   settled by their counts, without their bytes: a passage that a third of all texts share is one row for each of them.
2. Of each different segment whose anchor other segments have, one is cut from its text. A task takes whole groups of segments
   and builds the suffix array of their windows by prefix doubling, the longest common prefixes of neighbours, and from the
   previous and the next smaller position in suffix order the longest earlier (and, on the mirrored positions, the longest
   later) match of each window.
3. An anchor with more than ``MOST_SEGMENTS`` different segments, such as the edge of a very common passage, would be too much for a
   task. Its windows are counted by their hash instead, one row for each window, which finds the same.

The repeated windows of a segment all hold its anchor, so what goes is one range for each segment; the ranges of a text
are joined and its bytes left out.

Cases: NULL and empty texts have no bytes, shorter ones than ``length`` lose none. Repeated rows are repeated texts, and
all their bytes go; with ``keep_first``, rows that are equal in id and text are one text. A NULL doc_id comes last. Removal
may cut characters apart, so what is left is bytes. Hashes have 64 bits, ids of texts 64 and their size. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.shared import table, written

LENGTH = 200
GRAM = 64
MOST_SEGMENTS = 2048
RUN_BYTES = 500_000
PIECE = 1 << 20
_PLACE_BITS = np.uint64(21)  # a piece and its last window are shorter than two to this
_LOW = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Hashes of any range of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = words.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return words.mix(value + (end - start).astype(np.uint64) * _ODD)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of texts that lie end to end, in pieces.

    For each: ``text``, ``anchor`` and ``start`` (places in the text), ``windows`` (their number), ``h`` (hash of the anchor),
    ``fp`` (hash of all its bytes and the anchor's place).
    """
    names = ("text", "anchor", "start", "windows", "h", "fp")
    found: dict[str, list[np.ndarray]] = {name: [np.zeros(0, dtype=np.int64)] for name in names}
    n = len(data)
    for low in range(0, max(0, n - length + 1), PIECE):
        piece = data[low : min(n, low + PIECE + length - 1)]
        hashes = Hashes(piece)
        at = np.arange(len(piece) - gram + 1)
        grams = hashes.of(at, at + gram)
        least = sliding_least((grams & ~_LOW) | at.astype(np.uint64), length - gram + 1)
        place = (least & _LOW).astype(np.int64)
        start = np.arange(low, low + len(place))
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + length <= offsets[text + 1]
        start, text, place = start[inside], text[inside], place[inside]
        if not len(start):
            continue
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(start)))
        start, text, place = start[first], text[first], place[first]
        begin = start - low
        fp = words.mix(hashes.of(begin, begin + windows - 1 + length) ^ ((place - begin).astype(np.uint64) * _ODD))
        parts = (text, place + low - offsets[text], start - offsets[text], windows, grams[place], fp)
        for name, part in zip(names, parts, strict=True):
            found[name].append(part.view(np.int64))
    return {name: np.concatenate(parts) for name, parts in found.items()}


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Ranks of values; equal ones have the same."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
    return rank


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts`` by their first ``depth`` bytes (equal ones in the order given), and how many
    bytes each has in common with the one before it, ``depth`` at most.

    Prefix doubling: ranks by eight bytes, then by twice as many in each round. ``depth`` bytes follow each start.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(2 * depth + 8, dtype=np.uint8)))
    size = n + depth
    keys = np.zeros(size, dtype=np.uint64)
    for k in range(8):
        keys = (keys << np.uint64(8)) | padded[k : k + size]
    eight = keys
    ranks, span = [(8, _ranked(keys))], 8
    while 2 * span <= depth:
        rank = ranks[-1][1]
        later = np.zeros(size, dtype=np.int64)
        later[: size - span] = rank[span:]
        ranks.append((2 * span, _ranked(rank * size + later)))
        span *= 2
    if depth >= span:
        last = ranks[-1][1]
        whole = _ranked(last[starts] * size + last[starts + depth - span])
    else:  # depth under eight
        whole = _ranked(eight[starts] >> np.uint64(8 * (8 - depth)))
    order = np.argsort(whole, kind="stable")
    a, b = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(order), dtype=np.int64)
    shared = np.zeros(len(a), dtype=np.int64)
    for span, rank in reversed(ranks):
        shared += span * (rank[np.minimum(a + shared, size - 1)] == rank[np.minimum(b + shared, size - 1)])
    for _ in range(7):
        shared += padded[np.minimum(a + shared, len(padded) - 1)] == padded[np.minimum(b + shared, len(padded) - 1)]
    shared = np.minimum(shared, depth)
    common[1:] = np.where(whole[order[:-1]] == whole[order[1:]], depth, shared)
    return order, common


def _nearest(position: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order: bytes in common with the nearest one before it in the order that has a smaller position; 0 under ``least``.

    All at once: a suffix whose candidate has a greater position takes over that one's candidate. What lies between them has
    greater positions, too, so nothing is passed over.
    """
    n = len(position)
    before = np.arange(-1, n - 1)
    shared = common.copy()
    open_ = np.flatnonzero((before >= 0) & (shared >= least))
    shared[common < least] = 0
    if n:
        shared[0] = 0
    while True:
        open_ = open_[position[before[open_]] > position[open_]]
        if not len(open_):
            return shared
        at = before[open_]
        reach, far = np.minimum(shared[open_], shared[at]), before[at]
        gone = (far < 0) | (reach < least)
        shared[open_] = np.where(gone, 0, reach)
        before[open_] = far
        open_ = open_[~gone]


def longest_previous(position: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest-previous-factor array: for each suffix in order, the most bytes it shares with one at an earlier position.

    By the previous and the next smaller position in suffix order; matches under ``least`` bytes count as 0.
    """
    ahead = _nearest(position, common, least)
    turned = np.concatenate(([0], common[1:][::-1])) if len(common) else common
    return np.maximum(ahead, _nearest(position[::-1], turned, least)[::-1])


def repeated_windows(
    data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int, keep_first: bool
) -> np.ndarray:
    """Which of the windows also begin earlier, or, without ``keep_first``, anywhere else. ``position`` orders all windows."""
    order, common = suffix_array(data, starts, length)
    longest = longest_previous(position[order], common, length)
    if not keep_first:
        longest = np.maximum(longest, longest_previous(-position[order], common, length))
    found = np.zeros(len(starts), dtype=bool)
    found[order] = longest >= length
    return found


# --- in tasks -----------------------------------------------------------------

_SEGMENT = "h bigint, fp bigint, id bigint, size int, first bigint, anchor int, lead int, windows int"
_CUT = f"{_SEGMENT}, n bigint, hot boolean, bytes binary"
_RANGE = "id bigint, size int, start int, stop int"


def _segments_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, _, data, offsets in words.slices(batch.column("text")):
            found = segments(data, offsets, length)
            text = found["text"]
            own = {name: batch.column(name).to_numpy(zero_copy_only=False)[row:][text] for name in ("id", "size", "first")}
            yield pa.RecordBatch.from_pydict(
                {"h": found["h"], "fp": found["fp"], **own}
                | {"anchor": found["anchor"].astype(np.int32), "lead": (found["anchor"] - found["start"]).astype(np.int32)}
                | {"windows": found["windows"].astype(np.int32)}
            )


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that are named with each text."""
    kinds = pa.schema(
        [("h", pa.int64()), ("fp", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("first", pa.int64())]
        + [("anchor", pa.int32()), ("lead", pa.int32()), ("windows", pa.int32()), ("n", pa.int64())]
        + [("hot", pa.bool_()), ("bytes", pa.binary())]
    )
    before = None
    for batch in batches:
        for k in range(batch.num_rows):
            own = {name: batch.column(name)[k].as_py() for name in ("id", "size", "first")}
            if own == before:  # a repeated row
                continue
            before = own
            text = memoryview(batch.column("text")[k].as_buffer())
            wanted = batch.column("wanted")[k].as_py()
            for low in range(0, len(wanted), 1000):
                rows = []
                for one in wanted[low : low + 1000]:
                    start = one["anchor"] - one["lead"]
                    rows.append(own | one | {"bytes": bytes(text[start : start + one["windows"] - 1 + length])})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _found_in(rows: list[pa.RecordBatch], length: int, keep_first: bool) -> pa.RecordBatch:
    """The range of each segment that its repeated windows cover. Segments of repeated rows may come more than once."""
    rows = pa.Table.from_batches(rows)
    h, fp = rows.column("h").to_numpy(), rows.column("fp").to_numpy()
    rows = rows.filter(pa.array(np.concatenate(([True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])))))
    column = {name: rows.column(name).to_numpy() for name in ("id", "size", "first", "anchor", "lead", "windows")}
    raw = [b"".join(chunk.to_pylist()) for chunk in rows.column("bytes").chunks]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    windows = column["windows"].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(windows + length - 1)))[:-1]
    owner = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (column["anchor"] - column["lead"])[owner] + within
    position = np.empty(len(owner), dtype=np.int64)
    position[np.lexsort((start, column["size"][owner], column["id"][owner], column["first"][owner]))] = np.arange(len(owner))
    found = np.flatnonzero(repeated_windows(data, begin[owner] + within, position, length, keep_first))
    first = np.flatnonzero(np.concatenate(([True], owner[found][1:] != owner[found][:-1]))) if len(found) else found
    last = np.append(first[1:], len(found)) - 1 if len(found) else found
    which = owner[found[first]]
    ranges = {"start": start[found[first]].astype(np.int32), "stop": (start[found[last]] + length).astype(np.int32)}
    return pa.RecordBatch.from_pydict({"id": column["id"][which], "size": column["size"][which], **ranges})


def _matched(batches: Iterator[pa.RecordBatch], length: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Ranges of segments that come in the order of ``h``; whole groups of equal ``h`` share a suffix array."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        h = batch.column("h").to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else h
        for low, high in zip(begins, np.append(begins[1:], len(h)), strict=True):
            part = batch.slice(low, high - low)
            if size >= RUN_BYTES and held[-1].column("h")[-1] != part.column("h")[0]:
                yield _found_in(held, length, keep_first)
                held, size = [], 0
            held.append(part)
            size += int(part.column("windows").to_numpy().sum()) + len(part) * (length - 1)
    if held:
        yield _found_in(held, length, keep_first)


def _windows_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of the segments, with its hash and its place before the anchor."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), dtype=np.uint8)
        column = {name: batch.column(name).to_numpy() for name in ("h", "id", "size", "first", "anchor", "lead", "windows")}
        windows = column["windows"].astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(windows + length - 1)))[:-1]
        owner = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[owner] + within
        own = {name: column[name][owner] for name in ("h", "id", "size", "first")}
        lead = (column["lead"][owner] - within).astype(np.int32)
        start = (column["anchor"][owner] - lead).astype(np.int32)
        code = Hashes(data).of(at, at + length).view(np.int64)
        yield pa.RecordBatch.from_pydict(own | {"lead": lead, "code": code, "start": start})


def removed_ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that some ranges cover; ranges that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1]))) if len(start) else start
    return start[new], stop[np.append(new[1:], len(start)) - 1] if len(start) else stop


def _left(text: memoryview, start: np.ndarray, stop: np.ndarray) -> Iterator[memoryview]:
    at = 0
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        yield text[at:a]
        at = b
    yield text[at:]


def _results(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        kept = []
        for text, starts, stops in zip(*(batch.column(n) for n in ("text", "starts", "stops")), strict=True):
            whole = memoryview(text.as_buffer() or b"")
            pair = [np.asarray(x.values, dtype=np.int64) if x.is_valid else np.zeros(0, dtype=np.int64) for x in (starts, stops)]
            start, stop = removed_ranges(*pair)
            digest = hashlib.sha256()
            for part in _left(whole, start, stop):
                digest.update(part)
            rows["n_bytes"].append(len(whole))
            rows["n_removed"].append(int((stop - start).sum()))
            rows["n_spans"].append(len(start))
            rows["kept_sha256"].append(digest.hexdigest())
            if with_bytes:
                kept.append(b"".join(_left(whole, start, stop)))
        columns = {"doc_id": batch.column("doc_id"), **rows}
        if with_bytes:
            columns["kept"] = pa.array(kept, pa.binary())
        kinds = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans"))]
        kinds += [("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_bytes
        yield pa.RecordBatch.from_pydict(columns, schema=pa.schema(kinds))


# --- the job ------------------------------------------------------------------


def deduplicated(
    documents: DataFrame, length: int = LENGTH, keep_first: bool = False, with_bytes: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (and the bytes ``kept``) of each row of ``documents``."""
    if not GRAM <= length < PIECE // 2:
        raise ValueError(f"length must be between {GRAM} and {PIECE // 2}")
    first = "coalesce(CAST(doc_id AS BIGINT), 9223372036854775807L)" if keep_first else "0L"
    texts = documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", f"{first} AS first", "coalesce(text, '') AS text")
    texts = texts.selectExpr("*", "xxhash64(doc_id, text) AS id", "CAST(octet_length(text) AS INT) AS size")
    found = texts.filter(f"size >= {length}").mapInArrow(functools.partial(_segments_of, length=length), _SEGMENT)
    met = found.groupBy("h").agg(F.count("*").alias("_n"), F.min("fp").alias("_a"), F.max("fp").alias("_b"))
    # Written tables stand on both sides of each join below, so that Spark may split a key that many rows have.
    met = written(met.filter("_n > 1").selectExpr("h", "_a <> _b AS several"))
    shared = written(found.join(met, "h"))  # only anchors that occur more than once
    own = F.struct("first", "id", "size", "anchor", "lead", "windows")
    classes = written(
        shared.groupBy("h", "fp").agg(
            F.count("*").alias("n"), F.min(own).alias("own"), F.bool_or("several").alias("several")
        )
    )
    several = classes.filter("several").withColumnRenamed("own", "_own")
    crowded = several.groupBy("h").agg(F.count("*").alias("_n")).filter(F.col("_n") > MOST_SEGMENTS)
    crowded = written(crowded.select("h", F.lit(True).alias("_hot")))
    hot = F.coalesce(F.col("_hot"), F.lit(False)).alias("hot")
    wanted = several.join(crowded, "h", "left").select("h", "fp", "n", hot, "_own.*")

    keys = ["id", "size"]
    one = F.struct("h", "fp", "n", "hot", "anchor", "lead", "windows")
    listed = wanted.groupBy(*keys).agg(F.collect_list(one).alias("wanted"))  # no more than a text has segments
    listing = texts.join(listed, keys).select(*keys, "first", "text", "wanted")
    pieces = written(listing.mapInArrow(functools.partial(_cut_out, length=length), _CUT))

    groups = pieces.filter("NOT hot").repartition("h").sortWithinPartitions("h", "fp")
    matched = groups.mapInArrow(functools.partial(_matched, length=length, keep_first=keep_first), _RANGE)
    windows = pieces.filter("hot").mapInArrow(
        functools.partial(_windows_of, length=length),
        "h bigint, id bigint, size int, first bigint, lead int, code bigint, start int",
    )
    same, place = ["h", "lead", "code"], F.struct("first", "id", "size", "start")
    counted = windows.groupBy(*same).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    counted = written(counted.filter("_n > 1"))
    again = windows.join(counted, same)
    if keep_first:
        again = again.filter(place != F.col("_first"))
    counted_ranges = again.selectExpr("id", "size", "start", f"start + {length} AS stop")

    copies = shared.join(classes.filter("n > 1").select("h", "fp", "own"), ["h", "fp"])
    if keep_first:
        copies = copies.filter(own != F.col("own"))
    copied = copies.selectExpr("id", "size", "anchor - lead AS start", f"anchor - lead + windows - 1 + {length} AS stop")

    ranges = matched.unionByName(counted_ranges).unionByName(copied).groupBy(*keys)
    ranges = ranges.agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    short, long = texts.filter(f"size < {length}"), texts.filter(f"size >= {length}")
    rows = long.join(ranges, keys, "left").select("doc_id", "text", "starts", "stops")
    rows = rows.unionByName(short.select("doc_id", "text"), allowMissingColumns=True)
    kinds = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return rows.mapInArrow(functools.partial(_results, with_bytes=with_bytes), kinds + ", kept binary" * with_bytes)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 200 bytes that also start elsewhere."""
    return deduplicated(table(spark, sf_dir, "documents"))
