"""Benchmark decontamination by one Aho-Corasick automaton.

Test questions and answers are normalised to words and cut into windows of consecutive
words; all windows make one automaton, which scans each document's words once. A word is
written as its number in the benchmark's vocabulary, in two or three digits of base 64 that
are characters of their own for each place, so no node has more than 64 branches and a match
begins and ends with words. Hits are mapped back to character offsets of the original text.

A benchmark of more than AUTOMATON_BYTES would make an automaton too large for a worker.
Its windows become 64-bit codes in a table instead: a Bloom filter of them passes possible
hits among the documents' windows, and an exact join by code keeps the true ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import masked, unmasked
from .storage import cut as cut_
from .urls import BlockedBloom, bloom
from .words import Words, char_offsets, spans, steps, words
from .workers import tidy

WINDOW = 13
#: Bytes of benchmark text that become an automaton: about 160,000 words, six million nodes and 300 MB in a worker.
AUTOMATON_BYTES = 1_000_000
BASE = 64


class Benchmark:
    """The items' words as numbers. The automaton is built where it is first asked for, once in each worker."""

    def __init__(self, rows: list[tuple[str | None, str | None]], size: int = WINDOW):
        cut = words(pa.array([t for _, t in rows], pa.string()))
        self.vocabulary, number = np.unique(cut.code, return_inverse=True)
        self.items = [(rows[i][0], (number[cut.first[i] : cut.first[i + 1]] + 1).astype(np.int32)) for i in range(len(rows)) if cut.first[i] < cut.first[i + 1]]
        self.size, self._built = size, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": None}

    def automaton(self):
        """Windows as digits, each with its number of words and the ids of the items it comes from."""
        if self._built is None:
            import ahocorasick

            found: dict[str, tuple[int, set[str]]] = {}
            for name, ids in self.items:
                text, first = self.digits(ids)
                many = min(self.size, len(ids))
                for i in range(len(ids) - many + 1):
                    found.setdefault(text[first[i] : first[i + many]], (many, set()))[1].update(() if name is None else (name,))
            self._built = ahocorasick.Automaton()
            for w, (many, names) in found.items():
                self._built.add_word(w, (many, tuple(sorted(names))))
            self._built.make_automaton()
        return self._built

    def numbers(self, code: np.ndarray) -> np.ndarray:
        """A number for each word: that of the same word in the benchmark, or 0."""
        if not len(self.vocabulary):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, code), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == code, at + 1, 0)

    def digits(self, number: np.ndarray) -> tuple[str, np.ndarray]:
        """Word numbers as digits, a space for a word that the benchmark doesn't have; and where each word's begin."""
        places = 1
        while BASE**places < len(self.vocabulary):
            places += 1
        known = number > 0
        first = np.concatenate(([0], np.cumsum(np.where(known, places, 1))))
        out = np.full(first[-1], 32, np.uint32)
        for k in range(places):
            out[first[:-1][known] + k] = 256 + BASE * k + (number[known] - 1) // BASE ** (places - 1 - k) % BASE
        return out.tobytes().decode("utf-32-le"), first


def stretches(hit: np.ndarray, cut: Words, i: int) -> list[list[int]]:
    """Start and end characters of the hit words' runs in text i."""
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    at = cut.at[i]
    chars = char_offsets(cut.data[at : cut.at[i + 1]])
    first, last = cut.start[cut.first[i] :] - at, cut.end[cut.first[i] :] - at
    return [[int(chars[first[a]]), int(chars[last[b - 1]])] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


MADE = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", T.ArrayType(T.ArrayType(T.LongType()))))
TYPES = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """`docs` with ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``items`` (ids, as sorted strings, of items with an occurring window) and ``spans``
    (start and end characters of the hit stretches in the original text).

    A null text has no words. Items without words are left out; items that share an id
    count as one. With `unnamed`, items with a null id hit like others and only ``items``
    can't name them; otherwise they are left out. An empty benchmark hits nothing, and an
    empty table of documents stays empty. Repeated rows have equal results. A very long
    text is scanned in one task, in time that grows with its words and hits; a benchmark of
    any size is taken. Columns of the names above are replaced, others are carried along.
    """
    rows = benchmark.where(F.lit(unnamed) | F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = dict(MADE)
    kept = docs.select(*(c for c in docs.columns if c not in names))
    if held > AUTOMATON_BYTES:
        return _by_join(kept, rows, text, size)
    return _by_automaton(kept, Benchmark([tuple(r) for r in rows.collect()], size), text)  # bounded by AUTOMATON_BYTES


def _by_automaton(kept: DataFrame, benchmark: Benchmark, text: str) -> DataFrame:
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in MADE)])
    shared = kept.sparkSession.sparkContext.broadcast(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = shared.value
        automaton = benchmark.automaton() if benchmark.items else None
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in steps(batch, text):
                cut = words(part.column(at))
                number = benchmark.numbers(cut.code)
                out: list[list] = [[], [], [], []]
                for i in range(part.num_rows):
                    own = number[cut.first[i] : cut.first[i + 1]]
                    hit, names, where = np.zeros(len(own) + 1, np.int64), set(), []
                    if automaton is not None and own.any():
                        digits, first = benchmark.digits(own)
                        for end, (length, items) in automaton.iter(digits):
                            last = int(np.searchsorted(first, end, "right"))
                            hit[last - length] += 1
                            hit[last] -= 1
                            names.update(items)
                    inside = np.cumsum(hit)[:-1] > 0
                    if inside.any():
                        where = stretches(inside, cut, i)
                    for column, x in zip(out, (len(own), int(inside.sum()), sorted(names), where), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(out, TYPES, strict=True))], schema.fieldNames())

    return kept.mapInArrow(tidy(run), schema)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of rows (item, text): (code, item, size) of every window."""
    for batch in batches:
        for part in steps(batch, "text"):
            cut = words(part.column(1))
            n = np.diff(cut.first)
            long = np.minimum(n, size)
            count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
            of = np.repeat(np.arange(len(n)), count)
            start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + cut.first[:-1][of]
            code = spans(cut.code, start, long[of]) if len(of) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), part.column(0).take(pa.array(of)), pa.array(long[of])], ["code", "item", "size"])


def _by_join(kept: DataFrame, rows: DataFrame, text: str, size: int) -> DataFrame:
    """Hits are found for each text, by its hash, and joined back, so copies are no burden."""
    windows = cut_(rows.mapInArrow(lambda b: _windows(b, size), "code long, item string, size long").distinct(), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most `size` of them
    shared = kept.sparkSession.sparkContext.broadcast(bloom(windows.select("code").distinct(), "code").blocks)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = BlockedBloom(shared.value)
        for batch in batches:
            for part in steps(batch, "text"):
                cut = words(part.column(1))
                of = cut.of()
                for n in sizes:
                    start = np.flatnonzero(of[: max(len(of) - n + 1, 0)] == of[n - 1 :]) if len(of) else of
                    if len(start):
                        code = spans(cut.code, start, n).view(np.int64)
                        good = np.concatenate([sieve.hits(code[i : i + 100_000]) for i in range(0, len(code), 100_000)])
                        start, code = start[good], code[good]
                        yield pa.RecordBatch.from_arrays([pa.array(code), part.column(0).take(pa.array(of[start])), pa.array(start - cut.first[of[start]]), pa.array(np.full(len(start), n))], ["code", "_hash", "at", "size"])

    own, inner = masked(kept, kept.columns)
    own = own.withColumn("_own", F.xxhash64(inner[text]))
    possible = own.select(F.col("_own").alias("_hash"), F.col(inner[text]).cast("string").alias("text")).mapInArrow(tidy(probe), "code long, _hash long, at long, size long").distinct()
    hits = cut_(possible.join(windows.select("code", "size").distinct(), ["code", "size"]), "hits")
    items = hits.select("code", "size", "_hash").distinct().join(windows, ["code", "size"]).select("_hash", "item").distinct().groupBy("_hash").agg(F.array_sort(F.collect_list("item")).alias("items"))
    places = hits.groupBy("_hash").agg(F.collect_list(F.struct("at", "size")).alias("places"))
    found = cut_(places.join(items, "_hash"), "found")
    joined = own.join(found, F.col("_own") == F.col("_hash"), "left").select(*inner.values(), "items", "places")
    schema = T.StructType([*(f for f in joined.schema.fields[:-2]), *(T.StructField(n, t) for n, t in MADE)])
    column = list(inner.values()).index(inner[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, inner[text]):
                cut = words(part.column(column))
                n, where = [], []
                for i, places in enumerate(part.column(part.num_columns - 1)):
                    edge = np.zeros(int(cut.first[i + 1] - cut.first[i]) + 1, np.int64)
                    if places.is_valid:
                        at, length = (places.values.field(k).to_numpy() for k in (0, 1))
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + length, -1)
                    inside = np.cumsum(edge)[:-1] > 0
                    n.append(int(inside.sum()))
                    where.append(stretches(inside, cut, i) if n[-1] else [])
                items = part.column(part.num_columns - 2)
                items = items.fill_null([]) if items.null_count else items
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(np.diff(cut.first)), pa.array(n, TYPES[1]), items, pa.array(where, TYPES[3])], schema.fieldNames())

    return unmasked(joined.mapInArrow(tidy(run), schema), inner, *(n for n, _ in MADE))


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The contract's rule: a twentieth of the words or more is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
