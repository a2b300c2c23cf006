"""Consistent sharding by a permutation-filled lookup table.

Every shard has its own permutation of a prime number of slots.  The shards
take turns, each claiming its most preferred slot that is still free, until
the table is full.  A key's slot is its hash modulo the prime, so one lookup
places it; a shard that joins or leaves moves few keys beside its own.

The table depends on shard names alone, never on data.  It is filled once on
the driver and broadcast (``slots`` rows; bounded by ``MAX_SLOTS``).  The main
path is DataFrame operations only, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No larger table is broadcast: 8 bytes a slot make 8 MB at most.
MAX_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Where a shard's permutation begins, and its step; slots being prime, every step visits all of them."""
    return _number(f"offset:{shard}") % slots, _number(f"skip:{shard}") % (slots - 1) + 1


def fill_table(shards: list[str], slots: int) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not len(shards) <= slots <= MAX_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards up to {MAX_SLOTS}")
    walks = [preference(s, slots) for s in shards]
    at = [offset for offset, _ in walks]
    owner, free = [-1] * slots, slots
    while True:
        for k, (_, skip) in enumerate(walks):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def key_slot(key: Column, slots: int) -> Column:
    """Slot of a key: the first 15 hex digits of the MD5 of its text, modulo slots; null hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard) with one row a slot, as a DataFrame made by the JVM from one literal."""
    text = ",".join(map(str, fill_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))


def assign_shards(df: DataFrame, key_col: str, shards: list[str], slots: int = 16381, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All rows and columns of ``df`` with the slot and shard of each row's key.

    Equal keys share a shard, repeated rows stay, a null key is placed as the
    empty text is, an empty table stays empty.  Columns of ``df`` named like
    the two new ones are replaced by them.
    """
    kept = [c for c in df.columns if c not in (shard_col, slot_col) or c == key_col]
    lookup = lookup_table(df.sparkSession, shards, slots).toDF("__slot", "__shard")
    # Slots are joined beside the rows' own columns, whatever those are named.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), key_slot(F.col(f"`{key_col}`"), slots).alias("__slot"))
    out = rows.join(F.broadcast(lookup), "__slot")
    return out.select(*[F.col(f"__row.`{c}`") for c in kept], F.col("__slot").alias(slot_col), F.col("__shard").alias(shard_col))
