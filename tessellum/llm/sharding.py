"""Placement by a permutation-filled lookup table of prime size.

Each shard prefers the slots of the table in an order of its own (a start and a step from hashes of
its name); shards take turns, each claiming the first slot in its order that is free, until the table
is full. All shards get an equal number of slots, give or take one, and few slots change hands when a
shard comes or goes. The table is broadcast: its size is a parameter of at most MOST slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest table that may be broadcast.
MOST = 1_000_003
#: A prime; more than a hundred slots for each of several hundred shards.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard in each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names, each its own")
    if not is_prime(slots) or len(shards) > slots or slots > MOST:
        raise ValueError(f"the table needs a prime number of slots from the number of shards to {MOST}")
    hashed = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(h[:8], "big") % slots for h in hashed]
    step = [int.from_bytes(h[8:16], "big") % (slots - 1) + 1 for h in hashed]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step[i]) % slots
            table[slot], at[i] = i, (slot + step[i]) % slots
            free -= 1
            if not free:
                break
    return table


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row's keys.

    Equal keys go to the same shard; null is a key like any other; clashing columns are replaced;
    rows that repeat stay; an empty table stays empty."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "__slot int, __shard string")
    rows = df.drop(*({slot, shard} - set(keys))).withColumn("__slot", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(slots)).cast("int"))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("__slot", slot, shard)]
    return rows.join(F.broadcast(table), "__slot", "left").select(*kept, F.col("__slot").alias(slot), F.col("__shard").alias(shard))


def write_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], path: str, files: int = 8) -> None:
    """Write one folder for each shard, in several files each, so that no task has to hold a whole shard."""
    placed = place(df, keys, shards)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
