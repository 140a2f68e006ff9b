"""Conversation structure repair by an auction shortest-path algorithm.

The rows of a conversation are edited until their role initials read ``(s?(ua)+)?``: keep a row (0), give it the role
user or assistant (2), delete it (3), insert an empty row of user or assistant (2); a truncated row that isn't deleted
costs 1 more, blank and repeated rows have to go. The edits form a lattice: a node is a number of rows read and what was
written last (nothing, system, user, assistant).

The cheapest path is found by auction. Every node has a price, never more than the cost of an arc and the price at
its end. A path grows from the start: if its last node's price is below the best of its arcs, the price is raised to that and
the path gives the node up, else it goes on along that arc. Prices begin with what the rows to come cost at least. When the
path arrives, the arcs whose cost equals the difference of prices hold every cheapest path, and the one whose edits
come first in ASCII order is traced along them: at each node the least letter whose arc is tight and leads to the end.

Rows are dealt out by ranges of conversation and turn, so a conversation of any length is shared among
tasks. A task solves each conversation that lies within its range at once. One that reaches its bounds, or has more than ``BLOCK``
rows, is cut into blocks; for each block the cheapest edits between every two states are found, and the
blocks of a conversation are then joined one after another in order: four costs, four running digests, and the letters.

Cases: NULL roles and texts are one space, NULL turns come first, rows of a NULL conv_id are a conversation of their own.
Rows of the same turn stand in the order of role and text; equal rows are repeats of the first. An empty role
has no initial, so keeping it changes nothing. A conversation without rows costs nothing. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import table

BLOCK = 128
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
SOUND, BLANK, REPEATED, TRUNCATED = range(4)
LEGAL = ("su", "ua", "au")
#: What is still to be inserted after the last row, by state.
ENDING = ("", INSERT * 2, INSERT, "")
#: A row without any of the ten letters is its own digest: of nothing.
NOTHING = hashlib.sha256().hexdigest()

Arc = tuple[str, int, int]


def _insert(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after a row with this initial, None if it can't follow."""
    if initial == "":
        return state
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def row_arcs(state: int, initial: str, kind: int) -> list[Arc]:
    """(letter, cost, next state) for each edit of a row, by letter."""
    arcs = [(DELETE, DELETE_COST, state)]
    if kind in (SOUND, TRUNCATED):
        more = TRUNCATED_COST if kind == TRUNCATED else 0
        if (after := _kept(state, initial)) is not None:
            arcs.append((KEEP, more, after))
        arcs.append((REROLE, REROLE_COST + more, _insert(state)))
    return arcs


def least_cost(kind: int) -> int:
    """What a row costs at least, whatever stands around it."""
    return {SOUND: 0, TRUNCATED: TRUNCATED_COST}.get(kind, DELETE_COST)


class Lattice:
    """Arcs and prices for one end: a state after the last row, or None for a finished conversation."""

    def __init__(self, initials: list[str], kinds: list[int], last: int | None):
        self.n, self.last = len(kinds), last
        states = {EMPTY: (EMPTY,), SYSTEM: (EMPTY, SYSTEM)}.get(last, range(STATES))  # those from which it can be reached
        self.end = self.n * STATES + last if last is not None else (self.n + 1) * STATES
        self.arcs: list[list[Arc]] = [[] for _ in range((self.n + 1) * STATES + 1)]
        for row in range(self.n):
            for state in states:
                found = [(a, c, (row + 1) * STATES + to) for a, c, to in row_arcs(state, initials[row], kinds[row]) if to in states]
                if _insert(state) in states:
                    found.append((INSERT, INSERT_COST, row * STATES + _insert(state)))
                self.arcs[row * STATES + state] = sorted(found)
        if last is None:
            for state in states:
                self.arcs[self.n * STATES + state] = [(ENDING[state], INSERT_COST * len(ENDING[state]), self.end)]
        rest = [0]
        for kind in reversed(kinds):
            rest.append(rest[-1] + least_cost(kind))
        self.price = [rest[self.n - row] for row in range(self.n + 1) for _ in range(STATES)] + [0]
        if last is not None:  # nothing leads on from the other states after the last row
            for state in set(range(STATES)) - {last}:
                self.price[self.n * STATES + state] = math.inf

    def settle(self, start: int) -> int:
        """Raises prices until a path of tight arcs leads from ``start`` to the end; the cost of that path."""
        arcs, price, path = self.arcs, self.price, [start]
        while path[-1] != self.end:
            node = path[-1]
            best, to = min(((cost + price[to], to) for _, cost, to in arcs[node]), default=(math.inf, -1))
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[start] - price[self.end]

    def trace(self, start: int) -> str:
        """The first in ASCII order of the cheapest edits from ``start``, once it is settled."""
        tight = [[a for a in arcs if a[1] + self.price[a[2]] == self.price[node]] for node, arcs in enumerate(self.arcs)]
        leads = [False] * len(tight)
        leads[self.end] = True
        for row in range(self.n, -1, -1):
            for _ in range(3):  # inserts lead on within a row, twice at most
                for node in range(row * STATES, (row + 1) * STATES):
                    leads[node] = leads[node] or any(leads[to] for _, _, to in tight[node])
        letters, node = [], start
        while node != self.end:
            letter, _, node = min(a for a in tight[node] if leads[a[2]])
            letters.append(letter)
        return "".join(letters)


def repair(initials: list[str], kinds: list[int]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    lattice = Lattice(initials, kinds, None)
    return lattice.settle(EMPTY), lattice.trace(EMPTY)


def transfers(initials: list[str], kinds: list[int]) -> list[tuple[int, str] | None]:
    """Cost and edits of a part of a conversation, for each state before it and each after; None where there are none."""
    found: list[tuple[int, str] | None] = [None] * STATES**2
    system = any(i == "s" and k in (SOUND, TRUNCATED) for i, k in zip(initials, kinds, strict=True))
    for last in range(STATES):
        lattice = Lattice(initials, kinds, last)
        for first in range(STATES):
            if first == last or last in (USER, ASSISTANT) or (first, last) == (EMPTY, SYSTEM) and system:
                cost = lattice.settle(first)
                found[first * STATES + last] = (cost, lattice.trace(first))
    return found


def edited(roles: list[str], texts: list[str], audit: str, state: int) -> Iterator[str]:
    """The lines ``role:text`` after the edits, from a state on."""
    row = 0
    for letter in audit:
        if letter in (INSERT, REROLE):
            state = _insert(state)
            role = "user" if state == USER else "assistant"
            yield f"{role}:{texts[row] if letter == REROLE else ''}"
        elif letter == KEEP:
            yield f"{roles[row]}:{texts[row]}"
            state = _kept(state, roles[row][:1])
        row += letter != INSERT


@dataclass
class Part:
    """Rows of one conversation that follow each other."""

    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)

    def counts(self) -> dict[str, int | None]:
        turns = [t for t in self.turns if t is not None]
        pairs = zip(self.roles, self.roles[1:], strict=False)
        return {
            "blank": self.kinds.count(BLANK),
            "duplicate": self.kinds.count(REPEATED),
            "truncated": self.kinds.count(TRUNCATED),
            "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in pairs),
            "least_turn": turns[0] if turns else None,
            "most_turn": turns[-1] if turns else None,
            "turns": len(set(turns)),
        }


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "least_turn", "most_turn", "turns")
_PART = (
    "conv_id bigint, block bigint, whole boolean, "
    + ", ".join(f"{name} bigint" for name in _COUNTS)
    + ", cost bigint, audit string, repaired_sha256 string,"
    " costs array<bigint>, audits array<string>, roles array<string>, texts array<string>"
)
_RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " cost bigint, audit string, repaired_sha256 string"
)
_KINDS = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), *((name, pa.int64()) for name in _COUNTS)]
    + [("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    + [("costs", pa.list_(pa.int64())), *((name, pa.list_(pa.string())) for name in ("audits", "roles", "texts"))]
)


def _whole(conv_id: int | None, block: int, part: Part) -> dict:
    cost, audit = repair([r[:1] for r in part.roles], part.kinds)
    lines = "\n".join(edited(part.roles, part.texts, audit, EMPTY))
    digest = hashlib.sha256(lines.encode()).hexdigest()
    found = {"cost": cost, "audit": audit, "repaired_sha256": digest}
    return {"conv_id": conv_id, "block": block, "whole": True, **part.counts(), **found}


def _block(conv_id: int | None, block: int, part: Part) -> dict:
    found = transfers([r[:1] for r in part.roles], part.kinds)
    pairs = {"costs": [f and f[0] for f in found], "audits": [f and f[1] for f in found]}
    rows = {"roles": part.roles, "texts": part.texts}
    return {"conv_id": conv_id, "block": block, "whole": False, **part.counts(), **pairs, **rows}


def _solved(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """One row for each conversation within this range, and one for each block of at most ``rows`` rows of the others."""
    block = TaskContext.get().partitionId() << 40
    part, now, inner, out = Part(), None, False, []
    seen = False
    for batch in batches:
        for conv_id, turn, role, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not seen or conv_id != now or len(part.kinds) == rows:
                if seen and conv_id != now:
                    out.append((_whole if inner else _block)(now, block, part))
                    inner = True
                elif seen:
                    out.append(_block(now, block, part))
                    inner = False
                part, now, seen, block = Part(), conv_id, True, block + 1
            part.roles.append(role)
            part.texts.append(text)
            part.kinds.append(kind)
            part.turns.append(turn)
        yield pa.RecordBatch.from_pylist(out, schema=_KINDS)
        out = []
    if seen:
        yield pa.RecordBatch.from_pylist([_block(now, block, part)], schema=_KINDS)


class Chain:
    """The letters of the best edits so far, as links that share what they have in common."""

    def __init__(self, before: Chain | None, letters: str):
        self.before, self.letters = before, letters

    def text(self) -> str:
        parts, link = [], self
        while link is not None:
            parts.append(link.letters)
            link = link.before
        return "".join(reversed(parts))


def _first(one: Chain, two: Chain) -> bool:
    """Whether the letters of ``one`` come first; both have as many links."""
    left, right = [], []
    while one is not two:
        left.append(one.letters)
        right.append(two.letters)
        one, two = one.before, two.before
    return "".join(reversed(left)) < "".join(reversed(right))


class Joined:
    """A conversation whose blocks come one after another; what is kept doesn't grow with them but for the letters."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.best: list[tuple[int, Chain | None, object, bool] | None] = [(0, None, hashlib.sha256(), False), None, None, None]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = self.role = None

    def add(self, row: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[name] += row[name]
        if self.role is not None:
            self.counts["illegal"] += self.role + row["roles"][0][:1] not in LEGAL
        self.role = row["roles"][-1][:1]
        if row["turns"]:
            self.counts["turns"] += row["turns"] - (self.most is not None and self.most == row["least_turn"])
            self.least = row["least_turn"] if self.least is None else self.least
            self.most = row["most_turn"]
        best: list[tuple[int, Chain, int, str] | None] = [None] * STATES
        for first, held in enumerate(self.best):
            for last in range(STATES):
                cost = row["costs"][first * STATES + last]
                if held is None or cost is None:
                    continue
                letters = row["audits"][first * STATES + last]
                link, cost, old = Chain(held[1], letters), cost + held[0], best[last]
                if old is None or cost < old[0] or cost == old[0] and _first(link, old[1]):
                    best[last] = (cost, link, first, letters)
        joined = []
        for found in best:
            if found is not None:
                cost, link, first, letters = found
                digest, begun = self.best[first][2].copy(), self.best[first][3]
                for line in edited(row["roles"], row["texts"], letters, first):
                    digest.update(("\n" if begun else "").encode() + line.encode())
                    begun = True
                found = (cost, link, digest, begun)
            joined.append(found)
        self.best = joined

    def result(self) -> dict:
        ended = []
        for state, held in enumerate(self.best):
            if held is not None:
                ended.append((held[0] + INSERT_COST * len(ENDING[state]), Chain(held[1], ENDING[state]), state))
        cost, link, state = ended[0]
        for one in ended[1:]:
            if one[0] < cost or one[0] == cost and _first(one[1], link):
                cost, link, state = one
        _, _, digest, begun = self.best[state]
        for line in edited([], [""], ENDING[state], state):
            digest.update(("\n" if begun else "").encode() + line.encode())
            begun = True
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.counts.pop("turns")
        self.counts.pop("turns", None)
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": cost, "audit": link.text(), "repaired_sha256": digest.hexdigest()}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])
    kinds = kinds.append(pa.field("audit", pa.string())).append(pa.field("repaired_sha256", pa.string()))
    now: Joined | None = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is not None and now.conv_id != row["conv_id"]:
                out.append(now.result())
                now = None
            if row["whole"]:
                turns = [row["most_turn"], row["least_turn"], row["turns"]]
                out.append(row | {"gaps": 0 if turns[0] is None else turns[0] - turns[1] + 1 - turns[2]})
                continue
            now = now or Joined(row["conv_id"])
            now.add(row)
        yield pa.RecordBatch.from_pylist(out, schema=kinds)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema=kinds)


#: Characters that don't make a text; the contract's.
_SPACES = "' \\t\\n\\u000b\\f\\r'"


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, the first fault of each row (blank, repeated, truncated or none), and its place
    among the rows of equal role and text."""
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    ended = f"right(rtrim({_SPACES}, text), 1) IN ('.', '!', '?')"
    kind = (
        f"CASE WHEN btrim(text, {_SPACES}) = '' THEN {BLANK} WHEN _place > 1 THEN {REPEATED}"
        f" WHEN {ended} THEN {SOUND} ELSE {TRUNCATED} END"
    )
    staged = rows.select("conv_id", "turn", "role", "text", F.row_number().over(earlier).alias("_place"))
    return staged.selectExpr("conv_id", "turn", "role", "text", f"{kind} AS kind", "_place")


def repaired(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults, cost, edits and digest of the repaired text of each conversation that has rows (conv_id, turn, role, text)."""
    rows = conversations.selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id",
        "CAST(turn AS BIGINT) AS turn",
        "coalesce(role, ' ') AS role",
        "coalesce(text, ' ') AS text",
    )
    order = ["conv_id", "turn", "role", "text", "_place"]  # NULLs first
    ranged = with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ranged.drop("_place").mapInArrow(functools.partial(_solved, rows=block), _PART)
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.mapInArrow(_joined, _RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by a hash of conversation and turn: dropped, emptied, cut off, repeated, or given to the user."""
    named = "concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))"
    rows = conversations.selectExpr(
        "conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"crc32(CAST({named} AS BINARY)) % 20 AS _fault"
    )
    rows = rows.filter("_fault <> 0").selectExpr(
        "conv_id",
        "turn",
        "IF(_fault = 4, 'user', role) AS role",
        "CASE _fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "explode(IF(_fault = 3, array(0, 1), array(0))) AS _copy",
    )
    return rows.drop("_copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages every conversation and repairs it; those without rows left are listed, too."""
    conversations = table(spark, sf_dir, "conversations")
    found = repaired(damaged(conversations))
    ids = conversations.selectExpr("CAST(conv_id AS BIGINT) AS conv_id").distinct()
    joined = ids.alias("i").join(found.alias("f"), F.expr("i.conv_id <=> f.conv_id"), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.selectExpr(
        "i.conv_id AS conv_id",
        *(f"coalesce({name}, 0L) AS {name}" for name in numbers),
        "coalesce(audit, '') AS audit",
        f"coalesce(repaired_sha256, '{NOTHING}') AS repaired_sha256",
    )
