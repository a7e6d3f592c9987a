"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: start + j * step modulo the
size, start and step from a digest of its name. The shards take turns, and in its turn a shard
claims the next slot of its order that is still free, until the table is full. A row's key is hashed
to a slot, and the table names the shard: constant time, shares equal to within 1 % for a size of
over 100 slots a shard, and few rows move when a shard comes or goes.

The table depends on the shard names alone, never on rows. It holds ``size`` slots, at most
``MAX_SLOTS``, and this proven bound is why it may be broadcast.

Defined results: a null key hashes like the empty string; rows with equal keys share a shard; an
empty table gives no rows. No shards, repeated names or a size that isn't a prime of at least the
number of shards raise ValueError. All columns of the input stay, ``slot`` and ``shard`` replace
columns of these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

MAX_SLOTS = 1 << 17
#: 15 hex digits of the key's md5 make the hash, so that it fits a long.
DIGITS = 15


def _prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Start and step of a shard's preference order over the slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:DIGITS], 16) % size, int(digest[-DIGITS:], 16) % (size - 1) + 1


def lookup_table(shards: Sequence[str], size: int) -> list[int]:
    """The shard's number by slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and differ")
    if not _prime(size) or not len(shards) <= size <= MAX_SLOTS:
        raise ValueError(f"the table's size must be a prime from {len(shards)} to {MAX_SLOTS}")
    owner, orders, free = [-1] * size, [preference(s, size) for s in shards], size
    upto = [0] * len(shards)
    while True:
        for shard, (start, step) in enumerate(orders):
            if not free:
                return owner
            while owner[slot := (start + upto[shard] * step) % size] >= 0:
                upto[shard] += 1
            owner[slot] = shard
            free -= 1


def slot_of(key: Column, size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def assign(df: DataFrame, key: str, shards: Sequence[str], size: int = 4099) -> DataFrame:
    """``df`` with ``slot`` and ``shard``: a map-side join with the broadcast table, no shuffle."""
    if key in ("slot", "shard"):
        raise ValueError("the key can't be one of the new columns")
    slots = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*(F.lit(s) for s in shards))
    place, number = unused(df, "place"), unused(df, "number")
    placed = df.sparkSession.range(1, numPartitions=1).select(
        F.posexplode(F.split(F.lit(slots), ",")).alias(place, number)).select(
        place, F.get(names, F.col(number).cast("int")).alias("shard"))
    out = df.drop("slot", "shard").withColumn("slot", slot_of(df[key], size))
    return out.join(F.broadcast(placed), out["slot"] == placed[place]).drop(place)
