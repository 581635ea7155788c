"""URL rules by a blocked Bloom filter and an exact hash join.

A rule is a host and a path prefix and fits the host, its subdomains and every path that
starts with the prefix. The listed rules' canonical keys (host and path in one string)
fill a blocked Bloom filter: a key picks one 512-bit block and sets one bit in each of its
eight words, so a probe touches one cache line. A URL's candidate keys (each suffix of its
host with each listed prefix length of its path) are probed, and possible hits go on to
an exact hash join with the rules that removes false positives. The longest rule wins.

Up to BROADCAST_RULES rules the exact table is broadcast with the filter, so that nothing
is shuffled. Beyond, only possible hits are joined by shuffle; rows without any, most of
them as a rule, pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import masked, unmasked
from .storage import cut

#: Bytes of filter at most; it is sent to every executor. Longer lists only let more false hits through to the join.
MOST_BYTES = 32 << 20
#: Rules up to this number are broadcast; beyond, the join is by shuffle with salted keys.
BROADCAST_RULES = 100_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to a slash, question mark, hash or the end, in lower case; path: from there up to a question mark, a hash or the end. Both are empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of every rule that could fit: host suffixes at label borders, with prefixes of the path."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))).otherwise(F.array().cast("array<string>"))


class BlockedBloom:
    """blocks: (number, 8) words of 64 bits; the number is a power of two."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def number(keys: int) -> int:
        wanted = max(1, keys * 16 // 512)
        return min(MOST_BYTES // 64, 1 << (wanted - 1).bit_length() if wanted > 1 else 1)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64)
        rows = self.blocks[h & (len(self.blocks) - 1)]
        bits = (h[:, None] >> (16 + 6 * np.arange(8))) & 63
        return ((rows >> bits.astype(np.uint64)) & np.uint64(1)).all(axis=1)


def bloom_of(hashes: np.ndarray) -> BlockedBloom:
    """The filter of hashes at hand."""
    number = BlockedBloom.number(len(hashes))
    blocks = np.zeros((number, 8), np.uint64)
    for i in range(8):
        np.bitwise_or.at(blocks[:, i], hashes & (number - 1), np.uint64(1) << ((hashes >> (16 + 6 * i)) & 63).astype(np.uint64))
    return BlockedBloom(blocks)


def bloom(keys: DataFrame, hashed: str) -> BlockedBloom:
    """The filter of a column of 64-bit hashes, each block being made by grouped aggregation."""
    number = BlockedBloom.number(keys.count())
    h = F.col(hashed)
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright({hashed}, {16 + 6 * i}) & 63 as int))")).alias(f"w{i}") for i in range(8)]
    rows = keys.groupBy(h.bitwiseAND(F.lit(number - 1)).alias("block")).agg(*words).collect()  # one row a block, bounded by MOST_BYTES
    blocks = np.zeros((number, 8), np.int64)
    for row in rows:
        blocks[row[0]] = row[1:]
    return BlockedBloom(blocks.view(np.uint64))


class Rules:
    """The exact table of a list that is broadcast: rules in the order of their hashes."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[3])
        self.key = pa.array([r[0] for r in rows], pa.string())
        self.verdict = pa.array([r[1] for r in rows], pa.string())
        self.length = np.array([len(r[0]) for r in rows], np.int64)
        self.host = np.array([r[2] for r in rows], np.int64)
        self.hash = np.array([r[3] for r in rows], np.int64)

    def longest(self, keys: pa.Array, hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The place of the longest rule that is among each of n rows' keys, or -1."""
        first, last = (np.searchsorted(self.hash, hashes, side) for side in ("left", "right"))
        best = np.full(n, -1)
        size = last - first
        which = np.repeat(np.arange(len(hashes)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        same = pc.equal(keys.take(pa.array(which)), self.key.take(pa.array(place))).to_numpy(zero_copy_only=False)
        which, place = row[which[same]], place[same]
        order = np.lexsort((self.host[place], self.length[place], which))
        best[which[order]] = place[order]
        return best


def _listed(rules: DataFrame) -> DataFrame:
    """(_key, _verdict, _long: the host's length, _hash) of the rules that count."""
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull() & (F.col("host") != ""))
    listed = rules.groupBy(F.concat(F.translate("host", UPPER, LOWER), "path").alias("_key"), F.translate("host", UPPER, LOWER).alias("_host")).agg(F.min("verdict").alias("_verdict"))
    listed = listed.groupBy("_key").agg(F.max_by(F.struct("_verdict", F.length("_host").alias("_long")), F.length("_host")).alias("_r")).select("_key", "_r.*")
    return listed.select("_key", "_verdict", F.col("_long").cast("long").alias("_long"), F.xxhash64("_key").alias("_hash"))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`df` with ``host``, ``path``, ``rule`` (the longest fitting rule, or null) and ``verdict``.

    `rules` has the columns host, path and verdict; of rules with the same host and path
    the one with the least verdict counts, and rows with a null in them are ignored. Ties
    in length go to the longer host. A null URL or one without :// has an empty host and
    path and gets the default, as does every URL that no rule fits. Repeated rows are
    judged alike, and an empty table stays empty. A very long URL has one candidate key
    for each label of its host and each length of a listed path. Columns of the four names
    are replaced.
    """
    listed = _listed(rules)
    few = listed.limit(BROADCAST_RULES + 1).collect()  # bounded
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")))
    own, inner = masked(df.withColumns({"host": host, "path": path}), [*kept, "host", "path"])
    rows = own.withColumnsRenamed({inner["host"]: "host", inner["path"]: "path"})
    inner |= {"host": "host", "path": "path"}
    if not few:
        return unmasked(rows, inner).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    if len(few) <= BROADCAST_RULES:
        return _by_broadcast(rows, inner, few, default)
    return _by_shuffle(rows, inner, listed, rules, default)


def _probed(rows: DataFrame, lengths: list[int]) -> DataFrame:
    return rows.withColumn("_keys", candidates(F.col("host"), F.col("path"), lengths)).withColumn("_hashes", F.transform("_keys", lambda k: F.xxhash64(k)))


def _by_broadcast(rows: DataFrame, inner: dict[str, str], few: list, default: str) -> DataFrame:
    lengths = sorted({len(r[0]) - r[2] for r in few})
    rows = _probed(rows, lengths)
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("_rule", T.StringType()), T.StructField("_verdict", T.StringType())])
    shared = rows.sparkSession.sparkContext.broadcast((bloom_of(np.array([r[3] for r in few], np.int64)).blocks, [tuple(r) for r in few]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held = shared.value
        sieve, exact = BlockedBloom(blocks), Rules(held)
        for batch in batches:
            keys, hashes = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            flat, hashed = keys.flatten(), hashes.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), keys.value_lengths().fill_null(0).to_numpy())
            good = sieve.hits(hashed)
            best = exact.longest(flat.filter(pa.array(good)), hashed[good], row[good], batch.num_rows)
            at = pa.array(best, mask=best < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], exact.key.take(at), exact.verdict.take(at)], schema.fieldNames())

    return unmasked(rows.mapInArrow(probe, schema), inner, F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"))


def _by_shuffle(rows: DataFrame, inner: dict[str, str], listed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)  # distinct lengths of paths only
    rows = _probed(rows.withColumn("_row", F.monotonically_increasing_id()), lengths)
    shared = rows.sparkSession.sparkContext.broadcast(bloom(listed, "_hash").blocks)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_hashes"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = BlockedBloom(shared.value)
        for batch in batches:
            keys, hashes = (batch.column(batch.schema.get_field_index(c)) for c in ("_keys", "_hashes"))
            good = sieve.hits(hashes.flatten().to_numpy(zero_copy_only=False))
            at = np.concatenate(([0], np.cumsum(keys.value_lengths().fill_null(0).to_numpy())))
            first = np.concatenate(([0], np.cumsum(good)))[at].astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(first), keys.flatten().filter(pa.array(good)))
            yield pa.RecordBatch.from_arrays([left if n == "_keys" else batch.column(batch.schema.get_field_index(n)) for n in schema.fieldNames()], schema.fieldNames())

    probed = cut(rows.mapInArrow(probe, schema), "probed")  # read twice, and its row numbers must not change
    none = F.lit(None).cast("string")
    passed = unmasked(probed.where(F.size("_keys") == 0), inner, none.alias("rule"), F.lit(default).alias("verdict"))
    possible = probed.where(F.size("_keys") > 0)
    salted = listed.select("_key", "_verdict", "_long", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    keys = possible.select("_row", F.explode("_keys").alias("_key")).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    best = keys.join(salted, ["_key", "_salt"]).groupBy(F.col("_row").alias("_hit")).agg(F.max_by(F.struct("_key", "_verdict"), F.struct(F.length("_key"), F.col("_long"))).alias("_best"))
    hit = possible.join(best, F.col("_row") == F.col("_hit"), "left")
    return passed.union(unmasked(hit, inner, F.col("_best._key").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict")))
