"""Skew-safe many-to-one lookup join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.session import kept

# A table is copied that many times where a join with it shuffles. Two let AQE split what is skewed; more would cost more than
# the facts themselves where the table holds long lists.
SALTS = 2
# Tables up to this size in memory are sent to every executor whole. Statistics don't tell: those of files are about
# encoded columns, and lists count as one entry.
BROADCAST_BYTES = 32 << 20
# A hash of a key in memory, with its share of the table it lies in.
HASH_BYTES = 32
# A sieve has a row for so many keys, and so many rows at most, each with some words of 64 bits.
SIEVE_KEYS, SIEVE_ROWS, SIEVE_WORDS = 16, 1 << 18, 8


def _bytes(name: str, kind: T.DataType) -> str:
    """Expression for about the bytes that a value takes in a row in memory."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return f"coalesce(aggregate({name}, 24L, (sum, one) -> sum + 16 + coalesce(octet_length(one), 0)), 8L)"
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return f"16L + coalesce(octet_length({name}), 0)"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return f"16L + 4 * coalesce(octet_length(to_json(named_struct('it', {name}))), 0)"
    return "8L"


def measured(table: DataFrame) -> tuple[int, int]:
    """Rows of a table, and about the bytes they take in memory; one aggregation."""
    each = " + ".join(["16L", *(_bytes(f"`{field.name}`", field.dataType) for field in table.schema)])
    found = table.agg(F.count("*").alias("n"), F.expr(f"coalesce(sum({each}), 0L) AS bytes")).first()
    return found.n, found.bytes


def lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    salts: int = SALTS,
    how: str = "left",
    scanned: bool = False,
) -> DataFrame:
    """Join (left, unless ``how`` says inner) of ``facts`` with a table that holds each key at most once.

    The table is measured: a small one is broadcast, unless the session doesn't allow it
    (``spark.sql.autoBroadcastJoinThreshold`` below zero). Of a larger one, if the facts are ``scanned`` (rows of a stored
    table, cheap to read twice), hashes of its keys are broadcast if they are
    few enough, and facts that have none of them stay where they are. The rest is shuffled, and
    the rows of one hot key are spread over ``salts`` partitions by a hash of ``spread_on``.  The hash is deterministic, so a task
    that is run again after a lost executor puts each row in the same place.
    Because the salt is part of the join key, no later aggregation relies on
    the partitioning of this join, which leaves AQE free to split what is still
    skewed.  Where the hash says no more than the keys, there is nothing to spread, and no salt.
    """
    spark = facts.sparkSession
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")
    count, size = (0, 0) if threshold.startswith("-") else measured(table)
    if not threshold.startswith("-") and size <= BROADCAST_BYTES:
        return facts.join(F.broadcast(table), list(keys), how)
    if set(spread_on) <= set(keys):
        return facts.join(table.hint("merge"), list(keys), how)
    salt = f"CAST(pmod(xxhash64({', '.join(spread_on)}), {salts}) AS INT) AS _salt"
    salted_table = table.selectExpr("*", f"explode(sequence(0, {salts - 1})) AS _salt").hint("merge")

    def met(rows: DataFrame) -> DataFrame:
        return rows.selectExpr("*", salt).join(salted_table, [*keys, "_salt"], how).drop("_salt")

    if not scanned or threshold.startswith("-") or count * HASH_BYTES > BROADCAST_BYTES:
        return met(facts)
    key = f"xxhash64({', '.join(keys)})"
    hashes = F.broadcast(table.selectExpr(f"{key} AS _key"))
    hashed = F.expr(key) == F.col("_key")
    asking = met(facts.join(hashes, hashed, "left_semi"))
    if how == "inner":
        return asking
    others = facts.join(hashes, hashed, "left_anti")
    return asking.unionByName(others, allowMissingColumns=True)


def sifted(facts: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``facts`` that may have a key of ``wanted``: all that do, and few others.

    To be used before a semi-join that would shuffle the facts. Hashes of the keys are bits of a table of bounded size, which is
    kept and broadcast, unless the session doesn't allow it; rows whose bit is not set stay where they are.
    """
    if facts.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").startswith("-"):
        return facts
    rows = min(SIEVE_ROWS, wanted.count() // SIEVE_KEYS + 1)
    key = f"xxhash64({', '.join(keys)})"
    place, word = f"pmod({key}, {rows}L)", f"pmod(shiftright({key}, 46), {SIEVE_WORDS})"
    bit = f"shiftleft(1L, CAST(pmod(shiftright({key}, 40), 64) AS INT))"
    marked = wanted.selectExpr(f"{place} AS _place", f"{word} AS _word", f"{bit} AS _bit")
    words = [F.expr(f"bit_or(IF(_word = {k}, _bit, 0L)) AS _word{k}") for k in range(SIEVE_WORDS)]
    sieve = kept(marked.groupBy("_place").agg(*words))
    own = " ".join(f"WHEN {k} THEN _word{k}" for k in range(SIEVE_WORDS))
    met = F.expr(f"_place = {place} AND (CASE {word} {own} END & {bit}) <> 0")
    return facts.join(F.broadcast(sieve), met, "left_semi")
