"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: its
name's hash gives an offset and a step, which visit every slot. Shards take
turns; at its turn a shard claims the first slot of its order that is still
free. A row's key is hashed to a slot, and the slot's shard is the row's. All
shards of equal weight get the same number of slots but for one; removing a
shard moves few rows besides its own. A shard of half the largest weight takes
every second turn.

The table has ``slots`` entries whatever the data, so it is broadcast (a few
bytes each); placement is one hash and one lookup a row, without a shuffle.

Defined cases: null keys are all placed on the slot of the empty string;
repeated keys share a shard; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4099
SHARDS = 32


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def name_hash(text: str) -> int:
    """The first 60 bits of MD5; the same in Python, Spark and SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[float] | None = None) -> list[int]:
    """The shard (its place in ``shards``) of every slot."""
    if not is_prime(slots) or slots < len(shards) or not shards:
        raise ValueError("slots must be a prime, at least as many as shards, and there must be a shard")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    weights = weights or [1.0] * len(shards)
    if min(weights) < 0 or not max(weights):
        raise ValueError("weights must not be negative, and one must be positive")
    share = [w / max(weights) for w in weights]
    order = [(name_hash("offset:" + s) % slots, name_hash("skip:" + s) % (slots - 1) + 1) for s in shards]
    at, credit, table, left = [0] * len(shards), [0.0] * len(shards), [-1] * slots, slots
    while left:
        for i, (offset, skip) in enumerate(order):
            credit[i] += share[i]
            if credit[i] < 1:
                continue
            credit[i] -= 1
            while table[slot := (offset + at[i] * skip) % slots] >= 0:
                at[i] += 1
            table[slot] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(rows: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS, weights: list[float] | None = None,
          slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``rows`` with the slot and the shard's name of each row's key. Columns of
    these names are replaced."""
    table = rows.sparkSession.createDataFrame(
        list(enumerate(shards[i] for i in lookup_table(shards, slots, weights))), "_slot long, _shard string")
    # the caller's columns travel as one struct, so their names meet no name of this function
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), slot_of(F.col(key_col), slots).alias("slot"))
    made = {slot_name: F.col("slot"), shard_name: F.col("_shard")}
    return own.join(F.broadcast(table), F.col("slot") == F.col("_slot"), "left").select(
        *[made.pop(c, F.col(f"row.`{c}`")).alias(c) for c in rows.columns], *[column.alias(c) for c, column in made.items()])


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]
