"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact verification.

Each text's set of five-word shingles gets TREES labels of DEPTH values, a byte each, so
that a label is one 64-bit number and the texts of a tree, sorted by it, lie in the order
of the tree's prefix trie. Texts in a run with equal first d bytes stand under one node of
depth d. One sort of all (tree, label) rows gives the nodes of every depth.

Matching begins with whole labels and shortens the prefix byte by byte. Candidates of the
longest prefixes are verified first, on their exact shingle sets. A pair of similarity s is
found at depth d with the probability p = 1 - (1 - s^d)^TREES, so each link that was found
stands for (1 - p) / p that were not; a text's estimate of what it misses, with one more
link at the threshold than it has, says whether it has reached the target recall. Those
that have not are matched anew with prefixes one byte shorter, against all texts, until
the depth at which even a text with a single link at the threshold reaches the target.
Texts in crowded groups stop early, and lone texts go down to that depth.

Verification is by blocks: the components of all nodes, those of more than a block's size cut
into bands of set sizes and then by hash. Sets that are linked are in one band or in two that
follow each other, so blocks farther apart are not compared at all; the others are, once,
where some node has texts of both, in one bounded task that intersects sets by matrix products and returns, instead of pairs, one row a text: its
number of links and the least text it is connected to. Texts with equal shingle sets are
one node throughout, so copies cost nothing. Links between different texts are all counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import masked, unmasked
from .graph import components
from .sieve import sieved
from .storage import cut, discard
from .words import Words, grams, mix, steps, words
from .workers import tidy

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
RECALL = 0.9999
#: Texts, and shingles, that a block holds on average at most; a longer text shares its block with none but chance ones.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 400_000
#: Elements of the incidence matrix that is multiplied at once.
MATRIX = 4_000_000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def found(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that some tree has both texts under one node of this depth."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The shortest prefix that is ever needed: there, pairs at the threshold are found with the target recall."""
    return next((d for d in range(DEPTH, 1, -1) if found(threshold, d) >= recall), 1)


def shingles(cut: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts' shingles in a row, and each text's first. A text of fewer words is one shingle; none has no words."""
    n = np.diff(cut.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(first[-1], np.uint64)
    long = n >= size
    if len(cut.code) >= size:
        every = grams(cut.code, size)
        start = np.repeat(cut.first[:-1][long] - np.concatenate(([0], np.cumsum(count[long])[:-1])), count[long]) + np.arange(count[long].sum())
        out[np.repeat(long, count)] = every[start]
    for i in np.flatnonzero((n > 0) & ~long):
        out[first[i]] = grams(cut.text(i), int(n[i]))[0]
    return out, first


def sets(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each (non-empty) text: its distinct codes in order, where they begin, and a code of the whole set."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((codes, of))
    c, o = codes[order], of[order]
    fresh = np.concatenate(([True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])))
    c, o = c[fresh], o[fresh]
    at = np.searchsorted(o, np.arange(len(first)))
    return c, at, mix(np.add.reduceat(mix(c + np.uint64(0xD1B54A32D192ED03)), at[:-1]) + np.diff(at).astype(np.uint64))


def labels(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of TREES labels for each (non-empty) text; a label's bytes, the highest first, stand for its DEPTH minimum hashes."""
    out = np.zeros((len(first) - 1, TREES), np.uint64)
    short = (codes >> np.uint64(32)).astype(np.uint32)
    for tree in range(TREES):
        for level in range(DEPTH):
            i = tree * DEPTH + level
            least = np.minimum.reduceat(short * _A[i] + _B[i], first[:-1])
            value = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(24)
            out[:, tree] = (out[:, tree] << np.uint64(8)) | value
    return out


def sign(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, _text: xxhash64 of the text, fp, n_words, n: shingles in the set, labels); fp is null for texts without
    words, labels also for sets that are too small for any other to reach the threshold."""
    df = docs.select(F.col(key), F.xxhash64(text).alias("_text"), F.col(text).cast("string").alias("_t"))
    schema = T.StructType([df.schema[0], df.schema[1], *(T.StructField(n, t) for n, t in (("fp", T.LongType()), ("n_words", T.LongType()), ("n", T.LongType()), ("labels", T.ArrayType(T.LongType()))))])
    share = round(threshold * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "_t"):
                cut_ = words(part.column(2))
                codes, first = shingles(cut_)
                some = np.diff(first) > 0
                n = np.zeros(part.num_rows, np.int64)
                fp = np.zeros(part.num_rows, np.uint64)
                own, wide = np.zeros((0, TREES), np.uint64), np.zeros(part.num_rows, bool)
                if some.any():
                    own, at, fp[some] = sets(codes, np.append(first[:-1][some], first[-1]))
                    n[some] = np.diff(at)
                    wide = n * 1_000_000 >= (n + 1) * share
                    own = labels(own, at)[wide[some]]
                at = np.concatenate(([0], np.cumsum(np.where(wide, TREES, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(own.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64), mask=~some), pa.array(np.diff(cut_.first)), pa.array(n), lists], schema.fieldNames())

    return df.mapInArrow(tidy(run), schema)


def nodes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of rows (tree, label, fp) in order: (depth, node, fp) for each node with company, from DEPTH down to `least`.

    A node whose texts all stand under one longer prefix adds nothing and is left out. The
    first and the last run of a batch may go on in another one and are always kept.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, label, fp = (batch.column(i).to_numpy() for i in range(3))
        label = label.view(np.uint64)
        out: list[tuple] = []
        below = None  # where runs of the next longer prefix begin
        for depth in range(DEPTH, least - 1, -1):
            prefix = label >> np.uint64(8 * (DEPTH - depth))
            fresh = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])))
            run = np.cumsum(fresh) - 1
            inside = np.bincount(run) if below is None else np.bincount(run, weights=below)
            keep = inside[run] > 1
            keep |= (run == 0) | (run == run[-1])
            node = mix(mix(prefix[keep]) + (DEPTH + 1) * tree[keep].astype(np.uint64) + np.uint64(depth))
            out.append((np.full(len(node), depth, np.int32), node.view(np.int64), fp[keep]))
            below = fresh
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["depth", "node", "fp"])


def verify(table: pa.Table, threshold: float, depths: list[int]) -> pa.Table:
    """One pair of blocks: (fp, root, links, missed) of its texts. Rows: fp, copies, side (0, 1, or 2 when the blocks are the same), codes.

    `missed` has, for each depth, how many links those found here stand for that would not be found there.
    """
    table = table.combine_chunks()
    fp, copies, side = (table.column(c).to_numpy() for c in ("fp", "copies", "side"))
    n = len(fp)
    held = [np.frombuffer(b, np.uint64) for b in table.column("codes").to_pylist()]
    size = np.array([len(h) for h in held])
    c, o = np.concatenate(held), np.repeat(np.arange(n), size)
    _, which, times = np.unique(c, return_inverse=True, return_counts=True)
    shared = times[which] > 1  # the others are in no intersection
    column, row = (np.cumsum(times > 1) - 1)[which[shared]], o[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), np.float32)
    width = max(256, MATRIX // max(n, 1))
    total = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, total, width):
        a, b = np.searchsorted(column, (begin, begin + width))
        x = np.zeros((n, min(width, total - begin)), np.float32)
        x[row[a:b], column[a:b] - begin] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    union = size[:, None] + size[None, :] - common
    linked = (common > 0) & (common * 1_000_000 >= union * round(threshold * 1_000_000))
    if (side != 2).any():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    links = linked @ copies
    i, j = np.nonzero(linked)
    similar = common[i, j] / union[i, j]
    missed = [np.bincount(i, (1 / found(similar, d) - 1) * copies[j], n) for d in depths]
    # the least text that each is connected to here
    rank = np.argsort(np.argsort(fp, kind="stable"), kind="stable")
    root = rank.copy()
    while True:
        least = np.where(linked, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, least)
        new = np.minimum(new, new[np.argsort(rank)][new])
        if (new == root).all():
            break
        root = new
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(depths)), pa.array(np.column_stack(missed).ravel().astype(float) if depths else np.zeros(0)))
    return pa.table({"fp": fp, "root": np.sort(fp)[root], "links": links, "missed": lists})


def _codes(docs: DataFrame, key: str, text: str, samples: DataFrame) -> DataFrame:
    """(fp, codes: the sorted shingle set) of the sampled documents, found by key and text."""
    own = F.xxhash64(F.col(key), F.xxhash64(text))
    rows = sieved(docs.select(key, F.col(text).cast("string").alias("_t"), own.alias("_mark")), F.col("_mark"), samples.select(F.xxhash64(f"sample.{key}", "sample._text").alias("_wanted")), "_wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "_t"):
                codes, first = shingles(words(part.column(0)))
                some = np.diff(first) > 0
                if some.any():
                    c, at, fp = sets(codes, np.append(first[:-1][some], first[-1]))
                    data = c.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array([data[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["fp", "codes"])

    return rows.select("_t").mapInArrow(tidy(run), "fp long, codes binary").groupBy("fp").agg(F.first("codes").alias("codes"))


def _pairs(met: DataFrame) -> DataFrame:
    """(i, j): blocks that have texts under one node, at least one of them open, and sets of sizes that can be linked. One row a node and block is joined, not one a text."""
    seen = met.groupBy("node", "block", "band").agg(F.max("open").alias("open"), F.count(F.lit(1)).alias("n"))
    a = seen.select("node", F.col("block").alias("i"), F.col("open").alias("_open"), F.col("n").alias("_n"), F.col("band").alias("_band"))
    b = seen.select("node", F.col("block").alias("j"), F.col("open").alias("_other"), F.col("band").alias("_next"))
    near = F.coalesce(F.abs(F.col("_band") - F.col("_next")) <= 1, F.lit(True))
    return a.join(b, "node").where((F.col("_open") | F.col("_other")) & near & ((F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (F.col("_n") > 1)))).select("i", "j").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row a document: the key, ``class_id`` (the least key of its class), ``n_links``
    (other documents at the threshold or more, copies included), ``n_copies`` (those of
    them with the same shingle set), ``n_words`` and ``_text`` (xxhash64 of the text).

    A class is a component of the links. Texts of fewer than five words are one shingle;
    null texts and those without words are linked to nothing, and their class is their own
    key. A null key is a document like others but never a class id unless its whole class
    has none. Repeated rows count as copies of each other. An empty table gives no rows.
    A very long text is a block of its own or shares one with few; a task holds the sets
    of two blocks. Columns other than key and text are not read, whatever they are called.
    """
    inner = {key: "k", text: "t"}
    docs = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    key_name, key, text = key, inner[key], inner[text]
    least = prefix_depth(threshold, recall)
    depths = list(range(DEPTH, least, -1))  # those after which texts may be done
    signed = cut(sign(docs, key, text, threshold), "signed")
    some = signed.where(F.col("fp").isNotNull())
    texts = cut(some.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col(key), F.col("_text"))).alias("sample"), F.first("n").alias("n"), F.first("labels").alias("labels")), "texts")
    rows = texts.where(F.col("labels").isNotNull()).select("fp", F.posexplode("labels").alias("tree", "label")).select("tree", "label", "fp")
    order = ("tree", "label", "fp")
    met = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(lambda batches: nodes(batches, least)), "depth int, node long, fp long"), "nodes")
    company = met.groupBy("node").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("node", "a")
    shared = cut(met.join(company, "node"), "shared")
    homes = components(shared.where("fp != a").select("fp", "a").distinct(), "fp", "a")
    homes = homes.union(homes.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("fp"), F.col("root").alias("home"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(max(threshold - 1e-6, 1e-6)))).cast("int")  # linked sets are in one band or in two that follow each other
    members = cut(homes.join(texts.select("fp", "n", "copies", "sample"), "fp").withColumn("band", band), "members")
    sizes = members.groupBy("home", "band").agg(F.count(F.lit(1)).alias("_texts"), F.sum("n").alias("_shingles"))
    wholes = sizes.groupBy("home").agg((F.ceil(F.sum("_texts") / BLOCK_TEXTS) + F.ceil(F.sum("_shingles") / BLOCK_SHINGLES) > 2).alias("_large"))
    sizes = sizes.join(wholes, "home").select("home", "band", "_large", F.greatest(F.ceil(F.col("_texts") / BLOCK_TEXTS), F.ceil(F.col("_shingles") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    sizes = sizes.repartition(F.xxhash64("home", "band", "_blocks"))  # dealt anew, so that Spark may split the join where a home is hot
    block = F.when(F.col("_large"), F.xxhash64("home", "band", F.pmod(F.xxhash64("fp"), "_blocks"))).otherwise(F.xxhash64("home"))
    placed = members.join(sizes, ["home", "band"]).select("fp", "copies", block.alias("block"), F.when(F.col("_large"), F.col("band")).alias("band"))
    held = cut(placed.join(_codes(docs, key, text, members), "fp"), "held")
    own = held.select("fp", "block", "band")

    def check(table: pa.Table) -> pa.Table:
        return verify(table, threshold, depths)

    checked, done = None, None
    for depth in range(DEPTH, least - 1, -1):
        here = shared.where(F.col("depth") == depth).join(own, "fp")
        if checked is None:
            here = here.withColumn("open", F.lit(True))
        else:
            at = depths.index(depth + 1)
            prior = 1 / found(threshold, depth + 1) - 1
            closed = checked.groupBy("fp").agg(F.sum("links").alias("l"), F.sum(F.get("missed", F.lit(at))).alias("m")).where(F.col("m") + prior <= (1 - recall) * (F.col("l") + 1)).select(F.col("fp").alias("_closed"))
            here = here.join(closed, F.col("fp") == F.col("_closed"), "left").withColumn("open", F.col("_closed").isNull())
        pairs = _pairs(here)
        pairs = cut(pairs if done is None else pairs.join(done, ["i", "j"], "left_anti"), "pairs")
        if depth < DEPTH and pairs.isEmpty():
            continue
        sides = pairs.select("i", "j", F.col("i").alias("block"), F.when(F.col("i") == F.col("j"), 2).otherwise(0).alias("side")).union(pairs.where("i < j").select("i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
        work = sides.join(held, "block").select("i", "j", "fp", "copies", "side", "codes")
        new = cut(work.groupBy("i", "j").applyInArrow(check, "fp long, root long, links long, missed array<double>"), "checked")
        checked, done = (new, pairs) if checked is None else (checked.union(new), done.union(pairs))
    classes = components(checked.select("fp", "root"), "fp", "root")
    links = checked.groupBy("fp").agg(F.sum("links").alias("links"))
    own = texts.select("fp", "least", "copies").join(links, "fp", "left").join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "fp").alias("root"))
    own = cut(own, "own")
    discard(texts, met, shared, members, held)
    linked = own.where("links > 0")
    lowest = linked.groupBy("root").agg(F.min("least").alias("class_least"))
    known = linked.join(lowest, "root").select("fp", F.col("class_least").alias("least"), "copies", "links").union(own.where("links = 0").select("fp", "least", "copies", "links"))
    out = signed.join(known, "fp", "left")
    n_copies = F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select(F.col(key).alias(key_name), F.when(F.col("fp").isNull(), F.col(key)).otherwise(F.col("least")).alias("class_id"), (n_copies + F.coalesce("links", F.lit(0))).alias("n_links"), n_copies.alias("n_copies"), "n_words", "_text")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """`docs` with one document of each class: the one with the class's id, all of its columns kept.

    Where several rows share that id, each different text among them that belongs to the
    class stays once. Of a class without an id (null keys throughout) every different
    text stays once. Rows without words are in no class and all stay.
    """
    found = near_duplicates(docs, key, text, threshold, recall)
    rows, inner = masked(docs, docs.columns)
    k, t = inner[key], inner[text]
    out = found.where((F.col("n_words") > 0) & (~F.col(key).eqNullSafe(F.col("class_id")))).select(F.col(key).alias("_key"), F.col("_text").alias("_hash")).distinct()
    left = rows.withColumn("_own", F.xxhash64(t)).join(out, (F.col("_own") == F.col("_hash")) & F.col(k).eqNullSafe(F.col("_key")), "left_anti")
    repeats = found.where((F.col("n_words") > 0) & F.col(key).eqNullSafe(F.col("class_id"))).groupBy(key, "_text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeats:  # rows that repeat key and text
        some = F.coalesce(F.col(t), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
        left = left.where(some).dropDuplicates([k, "_own"]).unionByName(left.where(~some))
    return unmasked(left, inner)
