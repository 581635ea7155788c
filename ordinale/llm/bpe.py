"""Batch encoding with a word-splitting BPE tokenizer file, vectorised over whole batches.

The tokenizer library encodes about a megabyte a second on text with many distinct words.
Here a batch is split and merged with numpy: distinct pieces are merged once, all of them
together, one lowest-ranked pair of each piece at a time. Texts with characters for which
normalisation or classes need more than a small table go through the library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np

from .words import mix

#: Outside of this range, or where a special token may stand, the library encodes the text.
_UNSURE = re.compile(r"[^\t\n\r -~¡-įı-ſ]|<\|")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TOP = 0x180
#: Characters without a space beyond which a text goes to the library: merging takes as many rounds as a piece has merges.
LONGEST = 200
#: Characters that are split and merged together, in some 60 bytes each; longer texts are cut at spaces, which stand in no piece.
STEP = 1 << 18
_SPACE, _LONG = re.compile(r"\s"), re.compile(rf"\S{{{LONGEST + 1}}}")
_NEVER = np.int64(1) << 62


def _classes() -> np.ndarray:
    """0 space, 1 letter, 2 number, 3 other."""
    import unicodedata

    kinds = np.full(_TOP, 3, np.int8)
    for c in range(_TOP):
        kind = unicodedata.category(chr(c))[0]
        kinds[c] = 0 if chr(c).isspace() else {"L": 1, "N": 2}.get(kind, 3)
    return kinds


def _byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


class Encoded(NamedTuple):
    """ids[first[i]:first[i + 1]] are those of text i."""

    ids: np.ndarray
    first: np.ndarray


class BatchEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.fast = kinds == ["NFC", "Replace", "Lowercase"] and split[0]["pattern"]["Regex"] == _PATTERN and model["end_of_word_suffix"] == "</w>" and not model["ignore_merges"]
        if not self.fast:
            return
        vocab, names = model["vocab"], _byte_names()
        self.inner = np.array([vocab[n] for n in names], np.int64)
        self.last = np.array([vocab[n + "</w>"] for n in names], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = np.int64(1 + max(vocab.values()))
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.kinds = _classes()
        ids = np.unique(np.concatenate((self.inner, self.last)))
        self.small = int(ids.max()) + 1
        self.bytes = self._ranks(*(x.ravel() for x in np.meshgrid(np.arange(self.small), np.arange(self.small), indexing="ij"))).reshape(self.small, self.small) if self.small <= 1024 else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NEVER)

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> Encoded:
        """Apply the merges to all pieces at once; first has a piece's first symbol, and the end."""
        size = np.diff(first)
        n = len(size)
        piece = np.repeat(np.arange(n), size)
        final = np.zeros(len(symbols), bool)
        final[first[1:] - 1] = True
        rank = np.full(len(symbols), _NEVER)
        rank[:-1] = self._ranks(symbols[:-1], symbols[1:]) if self.bytes is None else self.bytes[symbols[:-1], symbols[1:]]
        rank[final] = _NEVER
        done_symbols, done_pieces = [], []
        while len(symbols):
            head = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            place = np.arange(len(symbols))
            best = np.minimum.reduceat(np.where(rank == _NEVER, _NEVER, (rank << 32) | place), head)
            more = best != _NEVER
            at = best[more] & 0xFFFFFFFF
            keep = np.ones(len(symbols), bool)
            symbols[at] = self.made[best[more] >> 32]
            final[at] = final[at + 1]
            keep[at + 1] = False
            if not more.all():
                over = np.repeat(~more, np.diff(np.append(head, len(symbols))))
                done_symbols.append(symbols[over])
                done_pieces.append(piece[over])
                keep &= ~over
            moved = np.cumsum(keep) - 1
            at = moved[at]
            symbols, piece, final, rank = symbols[keep], piece[keep], final[keep], rank[keep]
            if not len(symbols):
                break
            for i in (at, at[at > 0] - 1):
                i = i[~final[i]]
                rank[i] = self._ranks(symbols[i], symbols[i + 1])
            rank[final] = _NEVER
        if not done_symbols:
            return Encoded(np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
        symbols, piece = np.concatenate(done_symbols), np.concatenate(done_pieces)
        counts = np.bincount(piece, minlength=n)
        return Encoded(symbols[np.argsort(piece, kind="stable")], np.concatenate(([0], np.cumsum(counts))))

    def _sure(self, texts: list[str]) -> Encoded:
        """Ids of texts whose characters are all within the table."""
        chars = np.frombuffer("".join(texts).lower().encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(chars):
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        kind = self.kinds[chars]
        fresh = np.zeros(len(chars) + 1, bool)
        fresh[0] = True
        fresh[ends] = True
        fresh = fresh[:-1]
        start = (kind != 0) & (fresh | (kind == 2) | np.concatenate(([True], kind[1:] != kind[:-1])))
        # an apostrophe that begins a run takes one of the short endings along
        tick = np.flatnonzero(start & (chars == 39))
        if len(tick):
            padded, new = np.concatenate((chars, np.zeros(3, np.uint32))), np.concatenate((fresh, [True, True, True]))
            a, b = padded[tick + 1], np.where(new[tick + 2], 0, padded[tick + 2])
            a = np.where(new[tick + 1], 0, a)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            start[tick[one | two] + 1] = False
            after = np.concatenate((tick[one] + 2, tick[two] + 3))
            after = after[after < len(chars)]
            start[after[kind[after] != 0]] = True
        start = np.flatnonzero(start)
        if not len(start):
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        solid = np.flatnonzero(kind != 0)
        size = np.diff(np.append(np.searchsorted(solid, start), len(solid)))
        chars = chars[solid]
        # a code for each piece, to find the distinct ones
        place = np.arange(len(solid)) - np.repeat(np.cumsum(size) - size, size)
        code = mix((chars.astype(np.uint64) << np.uint64(20)) + place.astype(np.uint64))
        code = np.add.reduceat(code, np.cumsum(size) - size) + size.astype(np.uint64)
        _, sample, which = np.unique(code, return_index=True, return_inverse=True)
        # the bytes of the distinct pieces
        own = np.cumsum(size) - size
        picked = np.repeat(own[sample] - np.concatenate(([0], np.cumsum(size[sample])[:-1])), size[sample]) + np.arange(size[sample].sum())
        char = chars[picked].astype(np.int64)
        two = char >= 128
        where = np.cumsum(1 + two) - 1 - two
        out = np.empty(int((1 + two).sum()), np.int64)
        out[where] = np.where(two, 0xC0 | (char >> 6), char)
        out[where[two] + 1] = 0x80 | (char[two] & 63)
        per = np.add.reduceat(1 + two.astype(np.int64), np.concatenate(([0], np.cumsum(size[sample])[:-1])))
        first = np.concatenate(([0], np.cumsum(per)))
        symbols = self.inner[out]
        symbols[first[1:] - 1] = self.last[out[first[1:] - 1]]
        coded = self.merge(symbols, first)
        # back to all pieces
        count = np.diff(coded.first)[which]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = coded.ids[np.repeat(coded.first[which] - total[:-1], count) + np.arange(total[-1])]
        return Encoded(ids.astype(np.uint32), np.concatenate(([0], total[np.searchsorted(start, ends)])))

    def _sure_parts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, of STEP characters at a time."""
        held: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) > STEP:
                yield from self._each(held)
                held, size = [], 0
            if len(text) > STEP:
                cuts = [0]
                while len(text) - cuts[-1] > STEP and (space := _SPACE.search(text, cuts[-1] + STEP)):
                    cuts.append(space.start())
                yield np.concatenate([self._sure([text[a:b]]).ids for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)])
            else:
                held.append(text)
                size += len(text)
        yield from self._each(held)

    def _each(self, texts: list[str]) -> Iterator[np.ndarray]:
        coded = self._sure(texts)
        yield from (coded.ids[a:b] for a, b in pairwise(coded.first.tolist()))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        sure = list(range(len(texts))) if self.fast else []
        joined = "\n".join(texts)
        if sure and _UNSURE.search(joined):
            sure = [i for i in sure if not _UNSURE.search(texts[i])]
        if sure and _LONG.search(joined):
            sure = [i for i in sure if not _LONG.search(texts[i])]
        out: list = [None] * len(texts)
        for i, ids in zip(sure, self._sure_parts([texts[i] for i in sure]), strict=True):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.asarray(x.ids, np.uint32)
        return out
