import hashlib
import random
import re
import zlib

import pytest

from auditlake.llm import conversations as cv

LETTERS = "KRDI"


def brute_force(rows):
    """Counts, cost and edits of the rows (turn, role, text) of one conversation, by a plain table of best strings."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        if not solid:
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        else:
            kinds.append("sound" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ())}  # by the role initials' last, "" for none

    def better(table, state, cost, letters, lines):
        if state not in table or (cost, letters) < table[state][:2]:
            table[state] = (cost, letters, lines)

    def inserts(table):
        for _ in range(4):
            for state, (cost, letters, lines) in list(table.items()):
                new = "assistant" if state == "u" else "user"
                better(table, new[0], cost + 2, letters + "I", (*lines, f"{new}:"))
        return table

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for state, (cost, letters, lines) in inserts(best).items():
            better(after, state, cost + 3, letters + "D", lines)
            if kind in ("blank", "duplicate"):
                continue
            more = cost + (kind == "truncated")
            initial = role[:1]
            if initial == "":
                better(after, state, more, letters + "K", (*lines, f"{role}:{text}"))
            elif state + initial in ("s", "u", "su", "ua", "au"):
                better(after, initial, more, letters + "K", (*lines, f"{role}:{text}"))
            new = "assistant" if state == "u" else "user"
            better(after, new[0], more + 2, letters + "R", (*lines, f"{new}:{text}"))
        best = after
    ended = inserts(best)
    cost, letters, lines = min(ended[s] for s in ("", "a") if s in ended)
    turns = {t for t, _, _ in rows if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
        "cost": cost,
        "audit": letters,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv_id, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def by_conversation(rows):
    grouped = {}
    for conv_id, *rest in rows:
        grouped.setdefault(conv_id, []).append(tuple(rest))
    return grouped


def some_rows(random_, n):
    texts = ("Hello.", "Yes!", "and so", " ", "", "What?", "a ", "　", "ok.\n ", None)
    roles = ("system", "user", "assistant", "user", "assistant", "tool", "", None)
    turn, rows = 0, []
    for _ in range(n):
        turn += random_.choice((0, 1, 1, 1, 1, 3))
        rows.append((random_.choice((turn, turn, turn, None)), random_.choice(roles), random_.choice(texts) if random_.random() < 0.5 else f"t{random_.randint(0, 99)}."))
    return rows


def plain(row):
    return {k: row[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")}


@pytest.mark.parametrize("seed", range(150))
def test_prices_give_the_cheapest_edits(seed):
    random_ = random.Random(seed)
    initials = [random_.choice("suauaua x") for _ in range(random_.randint(0, 12))]
    kinds = [random_.choice((cv.SOUND, cv.SOUND, cv.SOUND, cv.BLANK, cv.TRUNCATED)) for _ in initials]
    cost, audit = cv.repair(initials, kinds)
    rows = [(k, i, {cv.SOUND: f"{k}.", cv.BLANK: " ", cv.TRUNCATED: f"{k}"}[kind]) for k, (i, kind) in enumerate(zip(initials, kinds, strict=True))]
    expected = brute_force(rows)
    assert (cost, audit) == (expected["cost"], expected["audit"])
    lattice = cv.Lattice(initials, kinds, None)
    lattice.settle(cv.EMPTY)
    for node, arcs in enumerate(lattice.arcs):  # no price is above an arc and the price at its end
        assert all(lattice.price[node] <= cost + lattice.price[to] for _, cost, to in arcs)


@pytest.mark.parametrize("block", (1, 2, 5, 128))
def test_against_brute_force_whole_and_in_blocks(spark, block):
    random_ = random.Random(block)
    rows = [(c if c else None, *r) for c in range(60) for r in some_rows(random_, random_.randint(1, 14))]
    rows += [(77, *r) for r in some_rows(random_, 150)]
    random_.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    frame = frame.selectExpr("*", "'x' AS kind", "'x' AS block", "'x' AS _place", "'x' AS _fault", "'x' AS whole", "'x' AS audit")
    found = cv.repaired(frame, block).collect()
    expected = {c: brute_force(r) for c, r in by_conversation(rows).items()}
    assert {r.conv_id: plain(r) for r in found} == expected
    assert len(found) == len(expected)


def test_a_long_conversation_in_one_part():
    random_ = random.Random(9)
    rows = [(k, random_.choice(("user", "assistant", "system")), random_.choice((f"{k}.", f"{k}", ""))) for k in range(700)]
    expected = brute_force(rows)
    part = cv.Joined(None)
    kinds = [cv.BLANK if not x else cv.SOUND if x.endswith(".") else cv.TRUNCATED for _, _, x in rows]
    for low in range(0, 700, 64):
        cut = slice(low, low + 64)
        one = cv.Part([r[1] for r in rows[cut]], [r[2] for r in rows[cut]], kinds[cut], [r[0] for r in rows[cut]])
        part.add(cv._block(None, low, one))
    assert plain(part.result()) == expected


def test_the_query_on_the_smallest_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = by_conversation(damaged(rows))
    expected = {c: brute_force(left.get(c, [])) for c in by_conversation(rows)}
    assert {r.conv_id: plain(r) for r in cv.op11_conversations(spark, sf_dir).collect()} == expected


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cv.repaired(none).count() == 0
    assert cv.damaged(none).count() == 0
