"""Word tools shared by the text operators, vectorised over UTF-8 bytes.

A word is a run of ``[0-9a-z]`` or non-ASCII characters after A-Z are lower-cased;
seen as UTF-8 that is a run of bytes in ``0-9a-z`` or from 0x80 on, so whole Arrow
buffers are cut into words without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20

_byte = np.arange(256)
_is_word = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_lower = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte)
WORD_BYTE = _is_word[_lower]
#: bytes.translate table: A-Z to a-z, everything that is in no word to a space.
FOLD = bytes(np.where(WORD_BYTE, _lower, 32).astype(np.uint8))
_rng = np.random.default_rng(20240229)
_value = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A random 64-bit value for each byte, 0 for those in no word.
_BYTE_VALUE = np.where(WORD_BYTE, _value[_lower], np.uint64(0))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        for base, name in ((_BASE, "_powers"), (_INVERSE, "_inverses")):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if at is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, and one row at least."""
    _, at = flat(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words(NamedTuple):
    """Words of several texts. first[i]:first[i + 1] are those of text i; start and end are byte positions in data."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    data: np.ndarray
    at: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.code[self.first[i] : self.first[i + 1]]

    def of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array) -> Words:
    """Cut a column into words and give each a 64-bit code."""
    data, at = flat(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(at), np.int64), none, none, np.zeros(0, np.uint64), data, at)
    inside = WORD_BYTE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(start):
        return Words(np.zeros(len(at), np.int64), start, end, np.zeros(0, np.uint64), data, at)
    size = end - start
    power, _ = _tables(int(size.max()) + 1)
    place = np.zeros(n, np.int64)
    covered = np.repeat(start, size)
    where = np.flatnonzero(inside)
    place[where] = where - covered
    code = np.add.reduceat(_BYTE_VALUE[data] * power[place], start)
    return Words(np.searchsorted(start, at), start, end, mix(code + size.astype(np.uint64) * _BASE), data, at)


def grams(code: np.ndarray, k: int) -> np.ndarray:
    """64-bit codes of the k consecutive words from each position on (len - k + 1 of them)."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += code[j : j + n] * _GRAM[j]
    return mix(out)


def spans(code: np.ndarray, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """64-bit codes of `length` words from each `start` on; cost doesn't depend on the length."""
    power, inverse = _tables(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * power[: len(code)], out=total[1:])
    return mix((total[start + length] - total[start]) * inverse[start] + np.uint64(1) * np.asarray(length).astype(np.uint64))


def char_offsets(data: np.ndarray) -> np.ndarray:
    """The character position of each byte position of one UTF-8 text (and of its end)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
