"""A blocked Bloom filter as a small table, so that rows are sieved inside a plan before a join shuffles them.

A 64-bit hash picks one 512-bit block and sets one bit in each of the block's eight words.
The blocks are made by grouped aggregation and joined back by broadcast on their number;
the bits are tested in the same stage. Rows that pass go on to an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks at most (32 MB of bits); longer lists only let more false hits through to the join.
MOST_BLOCKS = 1 << 19
BITS_PER_KEY = 16
WORDS = 8


def number(keys: int) -> int:
    """Blocks for so many keys: a power of two up to MOST_BLOCKS."""
    wanted = max(1, keys * BITS_PER_KEY // 512)
    return min(MOST_BLOCKS, 1 << (wanted - 1).bit_length() if wanted > 1 else 1)


def bits(h: Column) -> list[Column]:
    """The bit of each word that a hash sets."""
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 16 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def blocks(keys: DataFrame, hashed: str, count: int) -> DataFrame:
    """(block, w0 to w7) of a column of hashes."""
    h = F.col(hashed)
    return keys.groupBy(h.bitwiseAND(F.lit(number(count) - 1)).alias("block")).agg(*(F.bit_or(b).alias(f"w{i}") for i, b in enumerate(bits(h))))


def marked(df: DataFrame, h: Column, keys: DataFrame, hashed: str, name: str) -> DataFrame:
    """`df` with a boolean column: whether the row's hash `h` may be among the keys. It is for all that are, and for about one in a thousand of the others."""
    count = keys.count()
    table = blocks(keys, hashed, count).select(F.col("block").alias("_sieve_block"), *(F.col(f"w{i}").alias(f"_sieve_w{i}") for i in range(WORDS)))
    near = df.withColumn("_sieve_h", h).join(F.broadcast(table), F.col("_sieve_h").bitwiseAND(F.lit(number(count) - 1)) == F.col("_sieve_block"), "left")
    passed = F.lit(True)
    for i, b in enumerate(bits(F.col("_sieve_h"))):
        passed = passed & (F.col(f"_sieve_w{i}").bitwiseAND(b) != 0)
    return near.select(*df.columns, F.coalesce(passed, F.lit(False)).alias(name))


def sieved(df: DataFrame, h: Column, keys: DataFrame, hashed: str) -> DataFrame:
    """The rows of `df` whose hash `h` may be among the keys."""
    return marked(df, h, keys, hashed, "_may").where("_may").drop("_may")
