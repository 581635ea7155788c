"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: an
offset and a step drawn from the shard's name, so that the order visits each slot once.
Shards take turns claiming the first slot of their order that is still free, until the
table is full; their shares differ by one slot at most, and when a shard is added or
removed few other slots change hands. A row's place is then one lookup: the hash of its
key modulo the table size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots in the table; prime, and many times the number of shards.
SLOTS = 4099
#: No table is larger than this, which bounds what is broadcast.
MOST_SLOTS = 1 << 20


def _draw(name: str, what: str) -> int:
    return int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in the list) that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if slots < len(shards) or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_draw(s, "offset") % slots for s in shards]
    step = [_draw(s, "step") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(min(len(shards), left)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
    return table


def key_hash(*keys: str) -> Column:
    """60 bits of the MD5 of the keys as text; a null key counts as the empty text."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    held = ",".join(map(str, fill(shards, slots)))
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(F.split(F.lit(held), ",")).alias("slot", "n")).select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("n").cast("int") + 1).alias("shard"))


def shard(df: DataFrame, shards: list[str], keys: tuple[str, ...] = ("doc_id",), slots: int = SLOTS) -> DataFrame:
    """`df` with the columns ``slot`` and ``shard``; rows with equal keys share a shard.

    The table has `slots` rows, at most MOST_SLOTS, and is broadcast: placement shuffles
    nothing, however the keys are distributed. A null key is placed as the empty text, a
    very long one by its hash like any other; repeated rows share a shard. An empty table
    stays empty; columns named slot or shard are replaced, all others are carried along.
    """
    held = df.drop("slot", "shard").withColumn("slot", F.pmod(key_hash(*keys), F.lit(slots)).cast("long"))
    return held.join(F.broadcast(table(df.sparkSession, shards, slots)), "slot").select(*(c for c in df.columns if c not in ("slot", "shard")), "slot", "shard")
