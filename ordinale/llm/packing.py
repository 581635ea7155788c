"""Hierarchical multi-length packing of token ids into windows.

Documents are tokenised and cut freely. What fills a whole window of the longest tier
goes there at once. Each remainder is routed to the shortest context-size tier that holds
it; every tier is packed from its own remainders, longest tier first, and the gap a
remainder leaves in its window is filled from the shorter tiers, the last filler being
cut to fit. Windows whose material has run out are carried on; at the end of a task the
carried pieces are joined and cut into windows that are powers of two. Each window is
therefore full, whatever its tier. Step groups have equal token counts: each takes windows
of one size until it is full, and the windows that are left in a task's open groups share
groups at its end, so that only a task's last one is partial.

The job is one scan without a shuffle: a task packs what it reads, in blocks of a bounded
number of tokens, and a lost task is repeated with the same result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BatchEncoder
from .words import steps
from .workers import release, tidy

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that are packed together, at most one document more.
BLOCK_TOKENS = 1 << 19
#: Bytes of text that are encoded together.
STEP = 1 << 18


class Packer:
    """Packs (document, start, ids) pieces; windows are lists of pieces."""

    def __init__(self, tiers: tuple[int, ...]):
        if not tiers or any(t & (t - 1) or t < 1 for t in tiers):
            raise ValueError("tiers are powers of two")
        self.tiers = tuple(sorted(set(tiers)))
        self.longest = self.tiers[-1]
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, document: tuple, ids: np.ndarray) -> Iterator[list[tuple]]:
        whole = len(ids) // self.longest * self.longest
        for start in range(0, whole, self.longest):
            yield [(document, start, ids[start : start + self.longest])]
        if whole < len(ids):
            self.waiting.append((document, whole, ids[whole:]))
            self.tokens += len(ids) - whole

    def block(self) -> Iterator[list[tuple]]:
        """Pack what waits; what can't fill a window goes on waiting."""
        pool = sorted(((len(p[2]), i) for i, p in enumerate(self.waiting)))
        pieces, kept = dict(enumerate(self.waiting)), []
        fresh = len(pieces)
        for tier in reversed(self.tiers):
            while pool and pool[-1][0] > (tier // 2 if tier > self.tiers[0] else 0):
                size, i = pool.pop()
                window, gap = [pieces.pop(i)], tier - size
                while gap and pool:
                    at = bisect.bisect_right(pool, (gap, fresh))
                    if at:
                        size, i = pool.pop(at - 1)
                        window.append(pieces.pop(i))
                    else:  # the shortest is too long: its head fills the gap
                        size, i = pool.pop(0)
                        document, start, ids = pieces.pop(i)
                        window.append((document, start, ids[:gap]))
                        pieces[fresh] = (document, start + gap, ids[gap:])
                        bisect.insort(pool, (size - gap, fresh))
                        fresh, size = fresh + 1, gap
                    gap -= size
                if gap:
                    kept += window
                else:
                    yield window
        self.waiting, self.tokens = kept, sum(len(p[2]) for p in kept)

    def rest(self) -> Iterator[list[tuple]]:
        """Windows of powers of two for all that is left."""
        yield from self.block()
        left, pieces = self.tokens, self.waiting[::-1]
        self.waiting, self.tokens = [], 0
        while left:
            gap = min(self.longest, 1 << (left.bit_length() - 1))
            left -= gap
            window = []
            while gap:
                document, start, ids = pieces.pop()
                if len(ids) > gap:
                    pieces.append((document, start + gap, ids[gap:]))
                    ids = ids[:gap]
                window.append((document, start, ids))
                gap -= len(ids)
            yield window


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", tiers: tuple[int, ...] = TIERS, step_tokens: int = 16_384) -> DataFrame:
    """Sequences of packed token ids, one row for each piece.

    Result: the key, ``start`` (ids of its document before the piece), ``length``,
    ``token_ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (ids of the whole
    document with the closing id), ``sequence_id``, ``offset`` in the sequence,
    ``window`` (the sequence's length, a power of two up to the longest tier) and
    ``step_group`` (sequences that hold ``step_tokens`` ids together, of one length but for
    those a task is left with; its last group may hold fewer). A task keeps up to
    ``step_tokens`` ids of each length until their group is full.

    A null or empty text is the closing id alone. Rows with a null or repeated key are
    packed like others, each by itself, and so are repeated rows. A very long text is
    encoded in one task and cut over as many sequences as it needs; until then its ids are
    held there, four bytes each. Of remainders of equal length the one read first is placed
    last. Columns other than the key and the text are not read, whatever they are called.
    An empty table gives no rows. Ids of sequences and groups are those of the
    task's partition in the high bits and a count in the low 33.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(c, t) for c, t in (
        ("start", T.LongType()), ("length", T.LongType()), ("token_ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("window", T.LongType()), ("step_group", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = BatchEncoder(tokenizer_path), Packer(tiers)
        release()  # reading the vocabulary takes more than keeping it
        base = TaskContext.get().partitionId() << 33
        made, out, held = 0, [], 0
        open_: dict[int, list[list[tuple]]] = {}
        groups = 0
        key_type = None

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            columns = list(zip(*out, strict=True))
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(columns[1:]))], schema.fieldNames())

        def close(group: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal groups, held
            for rows in group:
                out.extend((*row, base + groups) for row in rows)
                held += rows[0][-1]
            groups += 1
            if held >= BLOCK_TOKENS:
                yield flush()

        def emit(windows: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for window in windows:
                size = sum(len(p[2]) for p in window)
                rows, at = [], 0
                for (key_, n), start, ids in window:
                    rows.append((key_, start, len(ids), ids.astype("<u4").tobytes(), n, base + made, at, size))
                    at += len(ids)
                made += 1
                open_.setdefault(size, []).append(rows)
                if (len(open_[size]) + 1) * size > step_tokens:
                    yield from close(open_.pop(size))

        def shared() -> Iterator[pa.RecordBatch]:
            """Groups of what is left, longest windows first: as sizes are powers of two, all are full but the last."""
            bins: list[list] = []
            for size in sorted(open_, reverse=True):
                for rows in open_.pop(size):
                    into = next((b for b in bins if b[0] + size <= step_tokens), None)
                    if into is None:
                        bins.append(into := [0, []])
                    into[0] += size
                    into[1].append(rows)
            for _, group in bins:
                yield from close(group)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in steps(batch, text, STEP):
                coded = encode([t or "" for t in part.column(1).to_pylist()])
                for k, ids in zip(part.column(0).to_pylist(), coded, strict=True):
                    ids = np.append(ids, np.uint32(END_ID))
                    yield from emit(packer.add((k, len(ids)), ids))
                    if packer.tokens >= BLOCK_TOKENS:
                        yield from emit(packer.block())
        if key_type is not None:
            yield from emit(packer.rest())
            yield from shared()
            if out:
                yield flush()

    return df.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(tidy(run), schema)
