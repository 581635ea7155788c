"""Repeated passages by a sparse suffix array over words.

Suffixes are retained only at minimisers: the least four-word gram of any SPARSE
consecutive ones, which depends on nothing but the words there, so two copies of a
passage retain the same places. With SPARSE + HEAD - 1 = LENGTH, every passage of LENGTH
words retains a suffix that has HEAD more of its words to its right. The retained suffixes
are sorted word by word, and what a suffix has in common with its neighbours in that order
tells the seeds: runs of suffixes of different texts whose first HEAD words are equal.

The seeds' matches are then grown: every two suffixes of a run, each with the words to its
left and right, are compared outwards from the common place, word by word, and every
stretch of LENGTH words within their common words is repeated. Comparing neighbours alone
would lose matches, as the longest match to the left can be with another text than the one
to the right. A run of more than RUN suffixes is not held in one task; its stretches are
hashed, and equal ones met by grouping, which finds the same. The result is exact: a word
is repeated if some stretch of LENGTH words around it stands in another document too.
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
from .sieve import marked, sieved
from .storage import cut as cut_
from .storage import discard
from .words import Words, grams, spans, steps, words
from .workers import tidy

#: Words of the shortest passage; the others follow.
LENGTH = 50
HEAD = 18
GRAM = 4
#: Suffixes of a run whose matches are grown pair by pair; larger ones are met by grouping.
RUN = 256


def anchors(code: np.ndarray, of: np.ndarray, length: int = LENGTH, head: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all stretches of `length` words within one text, and the place that each selects."""
    sparse = length - head + 1
    n = len(code) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none
    start = np.flatnonzero(of[:n] == of[length - 1 :])
    if not len(start):
        return start, start
    gram = grams(code, GRAM)
    # the first least gram of each `sparse` consecutive ones, by doubling
    best = np.arange(len(gram))
    size = 1
    while 2 * size <= sparse:
        a, b = best[: len(best) - size], best[size:]
        best = np.where(gram[b] < gram[a], b, a)
        size *= 2
    a, b = best[start], best[start + sparse - size]
    return start, np.where(gram[b] < gram[a], b, a)


def heads(cut: Words, at: np.ndarray, head: int = HEAD) -> np.ndarray:
    """The first `head` words of the suffixes at these places, a byte of its code for each word."""
    short = (cut.code >> np.uint64(56)).astype(np.uint8)
    return short[at[:, None] + np.arange(head)] if len(at) else np.zeros((0, head), np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have this width as rows of bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), width)


def neighbours(batches: Iterator[pa.RecordBatch], head: int = HEAD) -> Iterator[pa.RecordBatch]:
    """Of rows (head, text, n) in order: those that have their first `head` words in common with a neighbour of another text.

    The first and the last suffix of a partition may go on in the next one and are kept
    as well; those that turn out to be alone are grown from nothing.
    """
    held: tuple | None = None  # the last row, and whether it is out already
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, t, n = _bytes(batch.column(0), head), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        if held is not None:
            s, t, n = np.concatenate((held[0][None], s)), np.append(held[1], t), np.append(held[2], n)
        differ = s[1:] != s[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), head)  # the length that neighbours have in common
        fresh = np.concatenate(([True], (common < head) | (t[1:] != t[:-1])))
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = (common == head) & (t[1:] != t[:-1])
        # rows that repeat suffix and text are one, with the company of all of them
        group = np.cumsum(fresh) - 1
        out = np.bincount(group, same[1:] | same[:-1]) > 0
        s, t, n = s[fresh], t[fresh], n[fresh]
        first = s[0] if first is None else first
        out |= (s == first).all(axis=1)
        done = bool(out[-1])
        if held is not None and held[3]:
            out[0], done = False, done or len(s) == 1
        held = (s[-1], t[-1], n[-1], done)
        yield pa.RecordBatch.from_arrays([_binary(s[out]), pa.array(t[out]), pa.array(n[out])], ["head", "_hash", "n"])
    if held is not None and not held[3]:
        yield pa.RecordBatch.from_arrays([_binary(held[0][None]), pa.array([held[1]]), pa.array([held[2]])], ["head", "_hash", "n"])


def _context(code: np.ndarray, of: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, size: int) -> pa.Array:
    """Codes of up to `size` words from each place on (step 1) or before it, the nearest first (step -1), within its text."""
    room = np.minimum(high[of] - at, size) if step == 1 else np.minimum(at - low[of], size)
    begin = at if step == 1 else at - 1
    ends = np.concatenate(([0], np.cumsum(room)))
    index = np.repeat(begin, room) + step * (np.arange(ends[-1]) - np.repeat(ends[:-1], room))
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((8 * ends).astype(np.int32).tobytes()), pa.py_buffer(code[index].tobytes())])


def _padded(column: pa.Array, size: int) -> np.ndarray:
    """Codes of each value in a row of `size`; what is missing equals nothing in another row."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    room = np.diff(at)
    out = np.repeat(np.arange(1, len(column) + 1, dtype=np.uint64), size).reshape(len(column), size)
    out[np.arange(size)[None, :] < room[:, None]] = np.frombuffer(column.buffers()[2] or b"", np.uint64)[at[0] : at[-1]]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the rows have in common from their beginnings on."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def grow(batch: pa.RecordBatch, length: int = LENGTH, head: int = HEAD) -> pa.RecordBatch | None:
    """Of whole runs (head, _hash, at, left, right), each in the order of documents: starts of matched stretches, and those that an earlier text has."""
    run = _bytes(batch.column(0), head)
    run = np.concatenate(([0], np.cumsum((run[1:] != run[:-1]).any(axis=1))))
    text, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    left, right = _padded(batch.column(3), length - head), _padded(batch.column(4), length)
    edges = np.zeros((2, len(run), length - head + 2), np.int32)
    i = np.arange(len(run))
    lag = 1
    while len(i := i[i + lag < len(run)]) and len(i := i[run[i] == run[i + lag]]):
        p = i[text[i] != text[i + lag]]
        back, on = _common(left[p], left[p + lag]), _common(right[p], right[p + lag])
        good = back + on >= length
        p, back, on = p[good], back[good], on[good]
        for which, rows in ((0, p), (0, p + lag), (1, p + lag)):  # offsets of the place in its stretches
            np.add.at(edges[which], (rows, length - on), 1)
            np.add.at(edges[which], (rows, back + 1), -1)
        lag += 1
    inside = np.cumsum(edges, axis=2)[:, :, :-1] > 0
    some = np.flatnonzero(inside[0].any(axis=1))
    if not len(some):
        return None
    lists = []
    for which in inside[:, some]:
        row, offset = np.nonzero(which)
        ends = np.concatenate(([0], np.cumsum(which.sum(axis=1)))).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array((at[some][row] - offset).astype(np.int32))))
    return pa.RecordBatch.from_arrays([pa.array(text[some]), *lists], ["_hash", "starts", "later"])


def _gathered(lists: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists))))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, head: int = HEAD) -> DataFrame:
    """One row a document: the key, ``n_words``, ``first_row`` (whether it is the first of
    the documents with its text), ``starts`` (first words of its stretches of `length`
    words that stand in another document), ``later`` (those of them that stand in an
    earlier document) and ``_text`` (xxhash64 of the text).

    Documents are in the order of their keys, nulls last; where keys are equal, a hash of
    the text decides. Documents with equal texts are handled as one text and told apart at
    the end, so groups of copies, however large, cost no more than one. A null text has no
    words. Rows that repeat both key and text are one document. A very long text is cut
    into words in one task, and its matches are lists of its places. An empty table gives
    no rows. Other columns are not read, whatever key and text are called.
    """
    source = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("_hash", F.xxhash64("t"))
    place = F.struct(F.col("k").isNull().alias("n"), F.col("k"), F.col("_hash"))
    item = pa.struct([("head", pa.binary()), ("n", pa.int32())])

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "t"):
                cut = words(part.column(2))
                of = cut.of()
                _, at = anchors(cut.code, of, length, head)
                at = np.unique(at)
                code = spans(cut.code, at, head) if len(at) else np.zeros(0, np.uint64)
                order = np.lexsort((code, of[at]))
                at, code = at[order], code[order]
                fresh = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (of[at[1:]] != of[at[:-1]])))[: len(at)])
                ends = np.searchsorted(of[at[fresh]], np.arange(part.num_rows + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([_binary(heads(cut, at[fresh], head)), pa.array(np.diff(np.append(fresh, len(at))).astype(np.int32))], fields=list(item))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(cut.first)), pa.ListArray.from_arrays(pa.array(ends), items)], ["k", "_hash", "n_words", "heads"])

    schema = T.StructType([source.schema["k"], *(T.StructField(n, T.LongType()) for n in ("_hash", "n_words")), T.StructField("heads", T.ArrayType(T.StructType([T.StructField("head", T.BinaryType()), T.StructField("n", T.IntegerType())])))])
    scanned = cut_(source.select("k", "_hash", "t").mapInArrow(tidy(retain), schema), "suffixes")
    texts = scanned.groupBy("_hash").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    order = ("head", "_hash", "k")  # with the key, so that no suffix is too common to be split
    suffixes = scanned.select("_hash", "k", F.explode("heads").alias("_s")).select("_s.head", "_hash", "k", "_s.n")
    seeds = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).select("head", "_hash", "n").mapInArrow(tidy(lambda b: neighbours(b, head)), "head binary, _hash long, n int")
    seeds = cut_(seeds, "seeds")
    runs = seeds.groupBy("head").agg(F.sum("n").alias("_n"), F.min("_hash").alias("_a"), F.max("_hash").alias("_b")).where("_a < _b").select("head", (F.col("_n") > RUN).alias("many"))
    chosen = seeds.join(runs.repartition(F.xxhash64("head", "many")), "head").groupBy("_hash").agg(F.collect_set(F.struct("head", "many")).alias("seeds"))
    chosen = cut_(chosen.join(texts.select("_hash", "_first"), "_hash"), "chosen")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes of the seeds with what stands around them, and the hashed stretches around those of large runs."""
        for batch in batches:
            for part in steps(batch, "t"):
                cut = words(part.column(1))
                of = cut.of()
                start, at = anchors(cut.code, of, length, head)
                lists = part.column(2)
                listed, text_of = lists.flatten(), np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                many = listed.field(1).to_numpy(zero_copy_only=False)
                own = np.unique(at)

                def code(text: np.ndarray, rows: np.ndarray) -> np.ndarray:  # (text, head) as one number
                    out = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    for j in range(rows.shape[1]):
                        out = (out ^ rows[:, j]) * np.uint64(0x100000001B3)
                        out ^= out >> np.uint64(29)
                    return out

                have = code(of[own], heads(cut, own, head))
                want = code(text_of, _bytes(listed.field(0), head))
                few = own[np.isin(have, want[~many])]
                hashes = part.column(0).take(pa.array(of[few]))
                low, high = cut.first[:-1], cut.first[1:]
                left, right = (_context(cut.code, of[few], few, low, high, step, size) for step, size in ((-1, length - head), (1, length)))
                none = pa.nulls(len(few), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([_binary(heads(cut, few, head)), hashes, pa.array((few - low[of[few]]).astype(np.int32)), left, right, none], names)
                begin = start[np.isin(at, own[np.isin(have, want[many])])]
                if len(begin):
                    hashed = spans(cut.code, begin, length)
                    rank = np.lexsort((begin, hashed, of[begin]))  # one row for a text and stretch, with all places of it
                    begin, hashed = begin[rank], hashed[rank]
                    row = of[begin]
                    fresh = np.flatnonzero(np.concatenate(([True], (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1]))))
                    places = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(begin)).astype(np.int32)), pa.array((begin - low[row]).astype(np.int32)))
                    empty = pa.nulls(len(fresh), pa.binary())
                    yield pa.RecordBatch.from_arrays([_binary(hashed[fresh].view(np.uint8).reshape(-1, 8)), part.column(0).take(pa.array(row[fresh])), pa.nulls(len(fresh), pa.int32()), empty, empty, places], names)

    names = ["head", "_hash", "at", "left", "right", "starts"]
    near = sieved(source.withColumn("_mark", F.xxhash64("k", "_hash")), F.col("_mark"), chosen.select(F.xxhash64("_first.k", "_hash").alias("_wanted")), "_wanted")
    candidates = near.groupBy("_hash").agg(F.first("t").alias("t")).join(chosen.select("_hash", "seeds"), "_hash").select("_hash", "t", "seeds")
    grown = cut_(candidates.mapInArrow(tidy(cut_out), "head binary, _hash long, at int, left binary, right binary, starts array<int>"), "grown")
    first = chosen.select("_hash", "_first")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last run, which may go on
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            rows = _bytes(batch.column(0), head)
            if not len(rows):
                continue
            last = len(rows) - int(np.argmin(np.append((rows == rows[-1]).all(axis=1)[::-1], False)))
            held = batch.slice(last)
            if last and (out := grow(batch.slice(0, last), length, head)) is not None:
                yield out
        if held is not None and (out := grow(held, length, head)) is not None:
            yield out

    suffixes = grown.where(F.col("at").isNotNull()).select("head", "_hash", "at", "left", "right").join(first, "_hash")
    pairs = suffixes.repartition("head").sortWithinPartitions("head", "_first", "at").select("head", "_hash", "at", "left", "right").mapInArrow(tidy(compare), "_hash long, starts array<int>, later array<int>")
    stretches = cut_(grown.where(F.col("at").isNull()).select(F.col("head").alias("stretch"), "_hash", "starts").join(first, "_hash"), "stretches")
    met = stretches.groupBy("stretch").agg(F.min("_first").alias("a"), F.max("_first").alias("b")).where("a < b").select("stretch", "a")
    met = stretches.join(met.repartition(F.xxhash64("stretch", "a")), "stretch").select("_hash", "starts", F.when(F.col("a") < F.col("_first"), F.col("starts")).otherwise(F.array().cast("array<int>")).alias("later"))
    found = pairs.union(met).groupBy("_hash").agg(_gathered("starts").alias("starts"), _gathered("later").alias("later"))
    known = cut_(texts.join(found, "_hash", "left"), "known")  # apart, so that joins of a text with very many copies can be split
    discard(seeds, chosen, grown, stretches)
    out = scanned.select("k", "_hash", "n_words", place.alias("_place")).join(known, "_hash")
    every = F.when(F.col("n_words") >= length, F.sequence(F.lit(0), (F.col("n_words") - length).cast("int"))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    return out.select(
        F.col("k").alias(key), "n_words", (F.col("_place") == F.col("_first")).alias("first_row"),
        F.when(F.col("_last") != F.col("_first"), every).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(F.col("_place") != F.col("_first"), every).otherwise(F.coalesce("later", none)).alias("later"), F.col("_hash").alias("_text"),
    )


def merged(starts: Column, length: int = LENGTH) -> Column:
    """Sorted starts of stretches as an array of (first word, word after the last) of the passages they make up."""
    first = F.filter(starts, lambda s, i: (i == 0) | (s > F.get(starts, i - 1) + length))
    last = F.filter(starts, lambda s, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > s + length))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b + length).alias("last")))


def without(texts: pa.Array, later: pa.Array, length: int = LENGTH) -> tuple[pa.Array, np.ndarray]:
    """Texts without the words of the stretches that begin at `later`, and which of them have no word left. A word goes with the characters up to the next one of its text."""
    cut = words(texts)
    lists = later.fill_null([]) if later.null_count else later
    starts = lists.flatten().to_numpy() + np.repeat(cut.first[:-1], lists.value_lengths().to_numpy())
    edge = np.zeros(len(cut.start) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    of = cut.of()
    end = np.append(cut.start[1:], len(cut.data))
    last = np.concatenate((of[1:] != of[:-1], [True]))[: len(of)]
    end[: len(of)][last] = cut.at[of[last] + 1]
    edge = np.zeros(len(cut.data) + 1, np.int64)
    edge[cut.start[gone]] += 1
    np.subtract.at(edge, end[: len(of)][gone], 1)
    keep = np.cumsum(edge)[:-1] == 0
    at = np.concatenate(([0], np.cumsum(keep)))[cut.at]
    out = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(cut.data[keep].tobytes())]).cast(texts.type)
    changed = np.zeros(len(texts), bool)
    changed[of[gone]] = True
    n = np.diff(cut.first)
    return pc.if_else(pa.array(changed), out, texts), (n > 0) & (np.bincount(of, gone, len(n)) == n)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, head: int = HEAD) -> DataFrame:
    """`docs` without the passages that an earlier document has: the first stays whole.

    Every word of a stretch that stands in an earlier document goes, with the characters
    up to the next word of its text. Documents of which no word is left go too; those that
    had none before stay. All columns are kept; only the text of documents with such
    passages changes. Of rows that repeat key and text all are treated alike, null texts
    stay, and an empty table stays empty. Rows without such passages are neither shuffled
    nor handed to Python.
    """
    found = repeated(docs, key, text, length, head).where(F.size("later") > 0).select(F.col(key).alias("_key"), "_text", "later").dropDuplicates(["_key", "_text"])
    found = cut_(found, "later").withColumn("_wanted", F.xxhash64("_key", "_text"))
    rows, inner = masked(docs, docs.columns)
    key, text = inner[key], inner[text]
    tested = marked(rows.withColumn("_own", F.xxhash64(text)), F.xxhash64(key, "_own"), found, "_wanted", "_may")
    joined = tested.where("_may").join(found, (F.col("_own") == F.col("_text")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("_gone", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                column = part.schema.get_field_index(text)
                new, gone = without(part.column(column), part.column(len(names)), length)
                yield pa.RecordBatch.from_arrays([*(new if i == column else part.column(i) for i in range(len(names))), pa.array(gone)], schema.fieldNames())

    cut_short = joined.select(*names, "later").mapInArrow(tidy(run), schema).where(~F.col("_gone")).select(*names)
    return unmasked(tested.where(~F.col("_may")).select(*names).union(cut_short), inner)
