"""Sharding by a permutation-filled lookup table (native).

Every shard has its own permutation of the slots of a table of prime size, offset + j * skip mod size. In turns,
each shard claims the next free slot of its permutation until the table is full. Placing a row is one hash, one
modulo and one probe of the broadcast table, and when a shard is added or removed few slots change hands.

Defined cases: a null key has the hash of null and so one fixed slot; equal keys share a slot; an empty table gives
an empty result; columns of the input other than the key are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table. It is the proven bound of what is broadcast: TABLE_SIZE rows of two integers.
TABLE_SIZE = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that claimed it; shards claim in turns, each by its own preference order."""
    if not is_prime(size) or not 0 < len(shards) <= size:
        raise ValueError("the size must be prime and at least the number of shards")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digest]
    owner = [-1] * size
    left = size
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            left -= 1
            if not left:
                return owner


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as (slot, shard), from one string literal: a relation of the JVM without RDD or Python code."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    return spark.range(0, 1, 1, 1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select(F.col("slot").cast("int"), F.col("shard").cast("int"))


def shard(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(key, slot int, shard int) of every row. One broadcast hash join with the table of `size` rows, no shuffle."""
    slots = df.select(F.col(f"`{key}`").alias(key), F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(size)).cast("int").alias("slot"))
    return slots.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot").select(key, "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]
