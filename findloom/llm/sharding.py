"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a prime-sized table, each in the order of its own permutation of
the slots, until all slots are taken. A key goes to the shard of its slot. The table has ``slots``
entries whatever the data's size, so it's broadcast; placement is one hash and one lookup, and a
change of one shard moves few of the others' keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime, over 100 times the shards, so that shares differ by about 1 %.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:04d}" for i in range(128))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot, the number of its shard. Every shard has ``slots / len(shards)`` slots, or one more.

    Raises ValueError for no shards, repeated names, a size that isn't prime or too few slots.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, no less than the number of shards")
    offset = [_number(f"offset {x}") % slots for x in shards]
    skip = [_number(f"skip {x}") % (slots - 1) + 1 for x in shards]
    step, owner, left = [0] * len(shards), [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while owner[slot := (offset[i] + step[i] * skip[i]) % slots] >= 0:
                step[i] += 1
            owner[slot] = i
            step[i] += 1
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size; a null key has slot 0."""
    digest = F.substring(F.md5(key.cast("string")), 1, 15)
    return F.coalesce(F.conv(digest, 16, 10).cast("bigint") % slots, F.lit(0)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` to each row; equal keys share a shard, nulls go to slot 0's.

    Columns of those names are replaced, unless one is the key: then the new one's name gets ``_`` behind it. Other
    columns stay, whatever their names. Rows stay in place: no shuffle; a table of ``slots`` entries
    is broadcast. Empty input gives an empty result.
    """
    owner = lookup_table(shards, slots)
    table = df.sparkSession.createDataFrame([(i, shards[x]) for i, x in enumerate(owner)], "at int, owner string")
    columns = [c for c in df.columns if c == key or c not in ("slot", "shard")]
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("held"), slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    name = lambda c: c + "_" if c == key else c
    placed = held.join(F.broadcast(table), F.col("slot") == F.col("at"), "left")
    return placed.select(*[F.col("held").getField(c).alias(c) for c in columns], F.col("slot").alias(name("slot")), F.col("owner").alias(name("shard")))


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, salts: int = 16) -> None:
    """Write one folder of Parquet files per shard; up to ``salts`` tasks share a shard's rows."""
    placed = assign_shards(df, key, shards)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
