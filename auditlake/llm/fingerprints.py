"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame expressions only.

A text is cut into paragraphs, at line breaks and after sentence ends, and each distinct paragraph has a digest of 40
bits and a check of 24 bits, packed in one number: its entry. A cell of a sketch holds the exclusive or of entries,
and each entry has one cell in each of three sub-tables. Entries are dealt by bits of the digest into blocks of a few entries,
each with sub-tables of its own, so that the work grows with the length of the text; their number is a power of two by the
number of entries.

The fingerprint is the sketch of the whole text. Two of them with as many blocks subtract cell by cell, which is again an
exclusive or and leaves the paragraphs that only one text has; a cell whose check is that of its digest holds just
one entry, which is recorded and taken out of its other cells, until nothing is left. If one text has fewer blocks,
its sketch is made again with as many as the other's. A block that can't be emptied
so is sketched again for both texts with twice the cells and other places, up to ``ATTEMPTS`` times; after that its
entries themselves are compared. The likeness is that of the sets of entries: common ones by all.

Cases: NULL texts are empty; texts without paragraphs are alike (1). Rows that repeat doc_id and text have the same
result each and count as one in the order; rows without doc_id come last in it, rows of one doc_id by a hash of
their text. A table of one document is its own next one. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import cut, table

PARAGRAPH_END = r"\n+|(?<=[.!?])\s+"
PER_BLOCK = 6
SUB_TABLE = 8
ATTEMPTS = 4
_CHECK_BITS = 24
_CHECK = (1 << _CHECK_BITS) - 1
#: Bits of the digest that deal entries into blocks: the lower half of a block's number, then the upper half.
_LOW_BITS, _HIGH_BITS, _BLOCK_AT = 9, 9, _CHECK_BITS + 21


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(_CHECK))


def entries(text: Column) -> Column:
    """The distinct paragraphs of a text as entries of a sketch."""

    def entry(paragraph: Column) -> Column:
        digest = F.shiftrightunsigned(F.xxhash64(F.trim(paragraph)), _CHECK_BITS)
        return let(digest, lambda d: F.shiftleft(d, _CHECK_BITS).bitwiseOR(_check(d)))

    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH_END), lambda p: F.trim(p) != ""), entry))


def _placed(entry: Column, attempt: int, size: int) -> Column:
    """An entry and its cell in each sub-table; other bits of the digest, or another hash, for each attempt."""
    places = []
    for k in range(3):
        if attempt < 2:
            place = F.shiftright(entry, _CHECK_BITS + 9 * attempt + k * (3 + attempt)).bitwiseAND(F.lit(size - 1))
        else:
            place = F.pmod(F.xxhash64(entry, F.lit(attempt * 3 + k)), F.lit(size))
        places.append(place.cast("int").alias(f"p{k}"))
    return F.struct(entry.alias("e"), *places)


def _put(sketch: Column, placed: Column, count: int) -> Column:
    """A sketch (three sub-tables and a number) with entries put in, or taken out, which is the same.

    The number grows by ``count`` for each.
    """

    def sub_table(k: int) -> Column:
        def one(kept: Column, entry: Column) -> Column:
            own = entry[f"p{k}"]
            return F.transform(kept, lambda v, i: F.when(i == own, v.bitwiseXOR(entry.e)).otherwise(v))

        return F.aggregate(placed, sketch[f"t{k}"], one).alias(f"t{k}")

    return F.struct(*map(sub_table, range(3)), (sketch.n + F.size(placed) * count).alias("n"))


def _pure(cell: Column) -> Column:
    return (cell != 0) & (cell.bitwiseAND(F.lit(_CHECK)) == _check(F.shiftrightunsigned(cell, _CHECK_BITS)))


def _empty(sketch: Column) -> Column:
    nothing = [F.forall(sketch[f"t{k}"], lambda c: c == 0) for k in range(3)]
    return nothing[0] & nothing[1] & nothing[2]


def _peeled(filled: Column, attempt: int, size: int) -> Column:
    """What is left of a sketch after peeling, with the number of entries recorded."""
    place = lambda e: _placed(e, attempt, size)

    def turn(sketch: Column, k: int) -> Column:
        found = F.filter(sketch[f"t{k}"], _pure)
        return let(found, lambda f: F.when(F.size(f) == 0, sketch).otherwise(_put(sketch, F.transform(f, place), 1)))

    def round_(sketch: Column, _: Column) -> Column:
        return let(turn(sketch, 0), lambda a: let(turn(a, 1), lambda b: turn(b, 2)))

    def rounds(sketch: Column, many: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(many)), sketch, round_)

    return let(rounds(filled, 3), lambda p: F.when(_empty(p), p).otherwise(rounds(p, 3 + 2 * attempt)))


def level(one: Column) -> Column:
    """How often one block is halved for a set of entries: the blocks number two to this."""
    halvings = F.round(F.log2(F.greatest(F.size(one), F.lit(1)) / F.lit(float(PER_BLOCK))))
    return F.least(F.greatest(halvings, F.lit(0.0)), F.lit(float(_LOW_BITS + _HIGH_BITS))).cast("int")


def dealt(own: Column, halvings: Column) -> Column:
    """The entries of each block; dealt out in two steps, as one step would take the square of the length."""

    def step(rows: Column, at: int, bits: Column) -> Column:
        many = F.call_function("shiftleft", F.lit(1), bits)

        def number(e: Column) -> Column:
            return F.shiftrightunsigned(e, at).cast("int").bitwiseAND(many - 1)

        return F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.filter(rows, lambda e: number(e) == b))

    low = F.least(halvings, F.lit(_LOW_BITS))
    blocks = F.transform(step(own, _BLOCK_AT, low), lambda rows: step(rows, _BLOCK_AT + _LOW_BITS, halvings - low))
    return F.when(halvings == 0, F.array(own)).otherwise(F.flatten(blocks))


def sketched(block: Column, attempt: int = 0) -> Column:
    """The sketch of the entries of a block."""
    size = SUB_TABLE << attempt
    cells = F.array_repeat(F.lit(0).cast("bigint"), size)
    nothing = F.struct(*(cells.alias(f"t{k}") for k in range(3)), F.lit(0).alias("n"))
    return let(nothing, lambda n: _put(n, F.transform(block, lambda e: _placed(e, attempt, size)), 0))


def subtracted(one: Column, two: Column) -> Column:
    """The difference of two sketches of the same size, cell by cell."""

    def cells(a: Column, b: Column) -> Column:
        tables = (F.zip_with(a[f"t{k}"], b[f"t{k}"], lambda x, y: x.bitwiseXOR(y)).alias(f"t{k}") for k in range(3))
        return F.struct(*tables, F.lit(0).alias("n"))

    return let(one, lambda a: let(two, lambda b: cells(a, b)))


def recovered(difference: Column, attempt: int = 0) -> Column:
    """The number of entries in the difference of two sketches, or NULL if it can't be emptied."""
    found = lambda d: let(_peeled(d, attempt, SUB_TABLE << attempt), lambda p: F.when(_empty(p), p.n.cast("bigint")))
    return let(difference, lambda d: F.when(_empty(d), F.lit(0).cast("bigint")).otherwise(found(d)))


def _block_difference(sketches: tuple[Column, Column], blocks: tuple[Column, Column], attempts: int) -> Column:
    """How many entries only one of two blocks has, with larger sketches as long as peeling fails, and by themselves at last."""
    tries = [recovered(subtracted(*sketches))]
    for attempt in range(1, attempts):
        tries.append(recovered(subtracted(*(sketched(b, attempt) for b in blocks)), attempt))
    one, two = blocks
    whole = F.size(F.array_except(one, two)) + F.size(F.array_except(two, one))
    return F.coalesce(*tries, whole.cast("bigint"))


def prepared(own: Column) -> Column:
    """A set of entries with its blocks and their sketches."""
    with_blocks = lambda n: let(dealt(own, n), lambda b: _prepared(own, n, b))
    return let(level(own), with_blocks)


def _prepared(own: Column, halvings: Column, blocks: Column) -> Column:
    sketches = F.transform(blocks, lambda b: sketched(b))
    return F.struct(own.alias("own"), halvings.alias("level"), blocks.alias("blocks"), sketches.alias("sketches"))


def _at_level(side: Column, halvings: Column) -> Column:
    """The blocks and sketches of a prepared set, made again if they number less."""
    again = lambda: let(dealt(side.own, halvings), lambda b: F.struct(b.alias("blocks"), F.transform(b, lambda c: sketched(c)).alias("sketches")))
    kept = F.struct(side.blocks.alias("blocks"), side.sketches.alias("sketches"))
    return F.when(side.level == halvings, kept).otherwise(again())


def differing(one: Column, two: Column, attempts: int = ATTEMPTS) -> Column:
    """How many entries only one of two prepared sets has, found by peeling the difference of their sketches."""

    def total(a: Column, b: Column) -> Column:
        def add(sum_: Column, k: Column) -> Column:
            sketches = a.sketches[k], b.sketches[k]
            return sum_ + _block_difference(sketches, (a.blocks[k], b.blocks[k]), attempts)

        return F.aggregate(F.sequence(F.lit(0), F.size(a.blocks) - 1), F.lit(0).cast("bigint"), add)

    most = F.greatest(one.level, two.level)
    return let(most, lambda m: let(_at_level(one, m), lambda a: let(_at_level(two, m), lambda b: total(a, b))))


def likeness(one: Column, two: Column, differ: Column) -> Column:
    """Common entries by all entries of two sets, from the number of those that only one has."""
    both = F.size(one) + F.size(two)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))


def fingerprint(side: Column) -> Column:
    """The number of entries, and all cells of each block, in hexadecimal."""
    cells = lambda s: F.array_join(F.transform(F.concat(s.t0, s.t1, s.t2), F.hex), ".")
    return F.concat_ws("-", F.hex(F.size(side.own)), F.array_join(F.transform(side.sketches, cells), "-"))


def sketches_of(printed: Column) -> Column:
    """The sketches that a fingerprint holds."""
    number = lambda c: F.conv(c, 16, -10).cast("bigint")

    def sketch(text: Column) -> Column:
        def parts(cells: Column) -> Column:
            tables = (F.slice(cells, 1 + k * SUB_TABLE, SUB_TABLE).alias(f"t{k}") for k in range(3))
            return F.struct(*tables, F.lit(0).alias("n"))

        return let(F.transform(F.split(text, "[.]"), number), parts)

    return F.transform(F.slice(F.split(printed, "-"), F.lit(2), F.size(F.split(printed, "-")) - 1), sketch)


def printed_difference(one: Column, two: Column) -> Column:
    """How many paragraphs only one of two texts has, from their fingerprints alone; NULL if these have different numbers of
    blocks or don't hold enough cells to be peeled."""

    def total(a: Column, b: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda k: recovered(subtracted(a[k], b[k])))
        added = lambda f: F.aggregate(f, F.lit(0).cast("bigint"), lambda x, y: x + y)
        return F.when(F.size(a) == F.size(b), let(found, added))

    return let(sketches_of(one), lambda a: let(sketches_of(two), lambda b: total(a, b)))


def followers(keyed: DataFrame) -> DataFrame:
    """For each distinct (k, h), descending, the one that follows; the first follows the last.

    The order is found in ranges: inside each by a window, from one range to the next through their first rows.
    """
    ranged = keyed.select("k", "h").distinct().repartitionByRange(F.desc("k"), F.desc("h"))
    ranged = cut(ranged.withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(F.desc("k"), F.desc("h"))
    after = ranged.withColumn("after", F.lead(F.struct("k", "h")).over(inside))
    # one row for each range
    first = ranged.groupBy("range").agg(F.max(F.struct("k", "h")).alias("first"))
    order = Window.orderBy("range")
    start = F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("start")
    joined = after.join(first.select("range", start), "range")
    found = F.coalesce("after", "start")
    return joined.select("k", "h", found["k"].alias("next_k"), found["h"].alias("next_h"))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the document that follows by descending doc_id."""
    # a NULL id comes last, whatever the least id is
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"))
    keyed = documents.select(key.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("k", F.xxhash64("text").alias("h"), "text")
    # the texts are dealt out once for both uses, so both take the same columns; of repeated rows the first is used
    before = F.lag(F.lit(1)).over(Window.partitionBy("k", "h").orderBy("k"))
    once = keyed.withColumn("before", before).filter("before is null")
    once = once.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("text").alias("next_text"))
    joined = keyed.join(followers(keyed), ["k", "h"]).join(once, ["next_k", "next_h"])
    return joined.select(F.when(F.col("k.known"), F.col("k.id")).alias("doc_id"), "text", "next_text")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Sketches of each document and of its edited text, and their likeness; see the contract in the module's query."""
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    pairs = with_next(documents).select(
        "doc_id",
        size.cast("bigint").alias("n_chars"),
        "text",
        "next_text",
        F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    sets = pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        entries(F.col("text")).alias("own"),
        entries(F.col("edited")).alias("changed"),
        entries(F.col("next_text")).alias("other"),
    )
    sides = ("own", "changed", "other")
    made = sets.select("doc_id", "n_chars", "edited_sha256", *(prepared(F.col(side)).alias(side) for side in sides))
    own, changed, other = map(F.col, sides)
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(own).alias("fingerprint"),
        fingerprint(changed).alias("edited_fingerprint"),
        likeness(own.own, changed.own, differing(own, changed)).alias("near_edited"),
        likeness(own.own, other.own, differing(own, other)).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))
