"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a table of prime size. The shards take turns, each claiming the
first slot of its order that is still free, until no slot is left: every shard owns the same number of slots to within
one turn's weight, and a shard that leaves frees only its own. A row's key is hashed to a slot, and a broadcast of the
table (its size is a parameter, never the data's) turns the slot into a shard in constant time.

Nulls: a null key is hashed as the empty string. Repeated keys go to the same shard; an empty table gives an empty
result. The columns added are named by parameters, and a clash with a column of the input raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: 16 shards over a prime number of slots, over a hundred for each shard.
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
SLOTS = 2053
#: The table is broadcast, so its size has a bound.
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(text: str, part: int) -> int:
    """60 bits of an MD5 digest; part 0 and 1 are independent."""
    return int(hashlib.md5(text.encode()).hexdigest()[part * 15 : part * 15 + 15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The owner (index into shards) of every slot. weights: how many slots a shard claims each turn, 1 by default."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 0 or not sum(weights):
        raise ValueError("weights must hold a count for each shard, one of them positive")
    place = [_hash(name, 0) % slots for name in shards]
    skip = [_hash(name, 1) % (slots - 1) + 1 for name in shards]
    owner, left = [-1] * slots, slots
    while left:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, left)):
                while owner[place[shard]] >= 0:
                    place[shard] = (place[shard] + skip[shard]) % slots
                owner[place[shard]] = shard
                left -= 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the MD5 digest of the key's string, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(slots)


def lookup_frame(spark: SparkSession, owners: Sequence[int], slot: str = "slot", shard: str = "shard") -> DataFrame:
    """The lookup table as rows (slot, shard), made by SQL functions from one literal."""
    owners = F.split(F.lit(",".join(map(str, owners))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("_slot", "_shard")).select(F.col("_slot").cast("bigint").alias(slot), F.col("_shard").cast("int").alias(shard))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, weights: Sequence[int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the slot (bigint) and the shard index (int) of every row; no shuffle, one broadcast of `slots` rows."""
    if clash := {slot, shard} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    owners = lookup_table(shards, slots, weights)
    placed = df.withColumn(slot, slot_of(F.col(f"`{key}`"), slots))
    return placed.join(F.broadcast(lookup_frame(df.sparkSession, owners, slot, shard)), slot, "inner").select(*(f"`{c}`" for c in df.columns), slot, shard)
