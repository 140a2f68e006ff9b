import hashlib
import random
import re

from pyspark.sql import functions as F

from auditlake.llm import fingerprints as fp

from . import frames


def paragraphs(text):
    parts = re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+", text)
    return {p.strip(" ") for p in parts if p.strip(" ")}


def likeness(one, two):
    return len(one & two) / len(one | two) if one | two else 1.0


def expected(rows):
    """Results of each distinct (doc_id, text), but for the fingerprints, from whole sets of paragraphs."""
    found = {}
    for at, (doc_id, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        own = paragraphs(text)
        found[doc_id, text] = (len(text), sha, likeness(own, paragraphs(edited)), likeness(own, paragraphs(after)))
    return found


def test_against_whole_sets(spark):
    random_ = random.Random(9)
    rows = [(k, ". ".join(frames.text(random_, 4) for _ in range(random_.randint(0, 40))) + "\n") for k in range(80)]
    rows += [(85, rows[0][1]), (84, rows[0][1] + "One more. And more"), (86, "\n".join(map(str, range(3000))))]
    rows += [(87, "\n".join(map(str, range(40, 3000)))), (88, "é日本 😀. ß\n\n  a b .  c! d")]
    distinct = sorted({(i, t or "") for i, t in rows}, reverse=True)
    found = fp.fingerprints(frames.documents(spark, rows)).collect()
    want, prints = expected(distinct), {}
    assert len(found) == len(rows)
    by_id = dict(distinct)
    for row in found:
        text = by_id[row.doc_id]
        n_chars, sha, near_edited, near_next = want[row.doc_id, text]
        assert (row.n_chars, row.edited_sha256) == (n_chars, sha)
        assert abs(row.near_edited - near_edited) < 1e-9 and abs(row.near_next - near_next) < 1e-9, row.doc_id
        prints.setdefault(text, set()).add(row.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len(set().union(*prints.values())) > 0.9 * len(prints)


def test_awkward_rows(spark):
    found = fp.fingerprints(frames.documents(spark, frames.AWKWARD)).collect()
    assert len(found) == len(frames.AWKWARD)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    again = [r for r in found if r.doc_id == 905]
    assert len(again) == 2 and again[0] == again[1]
    # equal texts under two ids: the greater id comes first
    ties = {r.doc_id: r for r in found if r.doc_id in (906, 907)}
    assert ties[907].near_next == 1 and ties[907].fingerprint == ties[906].fingerprint
    (only,) = fp.fingerprints(frames.documents(spark, [(1, "Alone. Here")])).collect()
    assert only.near_next == 1
    assert fp.fingerprints(frames.documents(spark, [])).count() == 0


def test_small_sketches_fail_and_larger_ones_recover(spark):
    """Blocks far above their size need several tries and still give every difference; without tries the entries themselves do."""
    sizes = spark.createDataFrame([(n,) for n in (1, 12, 30, 60, 120)], "n int")
    entries = fp.entries(F.expr(r"array_join(transform(sequence(1, n), i -> concat('p', n, i)), '\n')"))
    rows = sizes.select("n", entries.alias("own"), F.expr("CAST(array() AS array<bigint>)").alias("none"))
    sketches = fp.sketched(F.col("own")), fp.sketched(F.col("none"))
    blocks = F.col("own"), F.col("none")
    found = rows.select(
        "n",
        fp.recovered(fp.subtracted(*sketches)).alias("first"),
        fp._block_difference(sketches, blocks, fp.ATTEMPTS).alias("all"),
        fp._block_difference(sketches, blocks, 1).alias("plain"),
    )
    found = {r.n: (r.first_, r["all"], r.plain) for r in found.withColumnRenamed("first", "first_").collect()}
    assert found[1][0] == 1 and found[120][0] is None
    assert {n: (a, p) for n, (_, a, p) in found.items()} == {n: (n, n) for n in found}


def test_returned_fingerprints_subtract(spark):
    """Two printed fingerprints, subtracted and peeled, tell how many paragraphs differ, without the texts."""
    random_ = random.Random(12)
    lines = [frames.text(random_, 4) for _ in range(400)]
    rows = []
    for k in range(60):
        begin, size = random_.randint(0, 200), random_.choice((3, 40, 200))
        rows.append((k, "\n".join(lines[begin : begin + size])))
    printed = fp.fingerprints(frames.documents(spark, rows)).select("doc_id", "fingerprint").cache()
    pairs = printed.alias("a").join(printed.alias("b"), F.expr("a.doc_id < b.doc_id"))
    sets = {k: set(text.split("\n")) for k, text in rows}
    found = pairs.selectExpr("a.doc_id AS one", "b.doc_id AS two", "a.fingerprint AS x", "b.fingerprint AS y")
    found = found.select("one", "two", fp.printed_difference(F.col("x"), F.col("y")).alias("differ")).collect()
    peeled = [r for r in found if r.differ is not None]
    assert all(r.differ == len(sets[r.one] ^ sets[r.two]) for r in peeled)
    assert len(peeled) > 0.15 * len(found) and any(r.differ > 50 for r in peeled)
    same = {k for k, text in rows if text == rows[0][1]}
    assert {r.doc_id for r in printed.collect() if r.fingerprint == printed.filter("doc_id = 0").first().fingerprint} == same


def test_the_least_id_is_an_id(spark):
    least = -(1 << 63)
    found = fp.fingerprints(frames.documents(spark, [(least, "a. b"), (None, "c"), (3, "a. b")])).collect()
    assert {r.doc_id for r in found} == {least, None, 3}
    assert {r.doc_id: r.near_next for r in found} == {3: 1.0, least: 0.0, None: 0.0}


def test_no_python_runs(spark):
    plan = fp.fingerprints(frames.documents(spark, frames.AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
