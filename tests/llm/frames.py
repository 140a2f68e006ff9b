"""Documents with every awkward case, and columns that operators use names of."""

from __future__ import annotations

WORDS = "river gauge depth survey water level north south bank stone bridge boat rain flood map".split()


def text(random, n):
    return " ".join(random.choice(WORDS) + str(random.randint(0, 99)) for _ in range(n))


AWKWARD = [
    (None, "no id at all"),
    (None, None),
    (900, None),
    (901, ""),
    (902, " \t\n\x0b "),
    (903, "one"),
    (904, "one two three"),
    (905, "twice the same row here now"),
    (905, "twice the same row here now"),
    (906, "tie between equal texts of five words"),
    (907, "tie between equal texts of five words"),
    (908, "x" * 20_000),
    (909, "word " * 5_000),
    (910, "é日本 ß😀 a b <|endoftext|> it's  two"),
]
CLASHES = "node, component, band, score, label, held_out, kept, word, train, total, row, rest, _row, _doc, n, e, k, h"


def documents(spark, rows, clashes=True):
    """A frame (doc_id, text), with further columns whose names operators use inside."""
    frame = spark.createDataFrame(list(rows), "doc_id bigint, text string")
    if clashes:
        frame = frame.selectExpr("*", *(f"'x' AS `{name.strip()}`" for name in CLASHES.split(",")))
    return frame


def key(row):
    return tuple((value is None, str(value)) for value in row)
