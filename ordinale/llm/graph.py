"""Connected components of a link table, without a node's links ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import cut, discard

#: Rounds before giving up; each at least halves the depth of the trees that are left.
MOST_ROUNDS = 60


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the links but the roots themselves; a root is its component's least node.

    Alternates two steps: every node hands its larger neighbours its least neighbour, then
    each node links its smaller neighbours to the least of them. Both are a minimum by
    grouped aggregation (summed before the shuffle, so a node with very many links is no
    burden) and an equality join that Spark may split when one key is hot. Each round is
    written to the shared folder, and the one before it is removed.
    """

    def spread(least: DataFrame) -> DataFrame:
        """Dealt anew, so that the join with it is one that Spark may split where a node is hot."""
        return least.repartition(F.xxhash64("u", "m"))

    edges, held = _kept(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(spread(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(spread(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        before = edges
        edges, now = _kept(small)
        discard(before)
        if now == held:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        held = now
    raise RuntimeError("components did not settle")


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The links, written, and their number and sums of their hashes, which tell whether a round changed them."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")), "links")
    return out, seen.get
