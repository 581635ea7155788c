"""Licence scans: an exact set-similarity join of text blocks with templates.

A text block is any window of consecutive words: BLOCK of them, or twice a template's own
if that is more, so whole licence texts are templates too. A template is a set of tokens and
a threshold t: a block matches when it holds the share t of the template's tokens. Tokens
are ordered globally by how often the corpus has them, rarest first, and three filters
leave few pairs to verify, without losing any: a matching block has one of the template's
first n - ceil(t n) + 1 tokens (prefix), has ceil(t n) distinct words (length), and from
the first shared token on enough template tokens must still follow in the template and in
the block (position). The filters are applied to the stretches that all blocks around
prefix tokens make up; there a window slides from one template token to the next, and
its count of distinct ones is the greatest overlap of any block. Templates marked as
phrases (short notices, of which a set of words would say little) must also stand word
for word, which is checked on the stretches that match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import steps, words, words_of

#: Words of a window at least; a longer template has windows of twice its own words.
BLOCK = 96


class Template(NamedTuple):
    """A label's text. A phrase must stand word for word; base phrases are those that are counted as places."""

    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False
    base: bool = False


#: The phrases whose places count, and their labels.
PHRASES = (Template("mit", "under the mit license", 1.0, True, True), Template("apache-2", "apache license version 2", 1.0, True, True), Template("cc-by-nc", "cc by nc", 1.0, True, True))
#: Short notices, which must stand word for word.
NOTICES = (
    Template("gpl", "gnu general public license", 1.0, True),
    Template("cc-by-sa", "creative commons attribution sharealike", 1.0, True),
    Template("cc-by-sa", "creative commons attribution share alike", 1.0, True),
    Template("all-rights-reserved", "all rights reserved", 1.0, True),
)
#: Openings, notices and whole texts of well-known licences, found at a containment of 0.8.
TEXTS = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at www apache org"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    Template(
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    Template(
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)
TEMPLATES = PHRASES + NOTICES + TEXTS


def window(template: Template) -> int:
    """Words of the windows that are compared with a template."""
    return max(BLOCK, 2 * len(words_of(template.text)))


def codes(text: str) -> np.ndarray:
    return words(pa.array([text])).code


def frequencies(df: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[int, int]:
    """How often each template token stands in all of the texts: one scan, one small row a task and token."""
    vocabulary = np.unique(np.concatenate([codes(t.text) for t in templates]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in steps(batch, text):
                code = words(part.column(0)).code
                at = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == code], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], ["code", "n"])

    rows = df.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n")).collect()  # a row a template token
    return {int(np.int64(c).view(np.uint64)): n for c, n in rows}


class Join:
    """The index of template prefixes, and the join of one text's windows with it."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[int, int]):
        self.templates, self.sequences, self.order, self.needed = templates, [], [], []
        self.windows = [window(t) for t in templates]
        self.widest = max(self.windows, default=BLOCK)
        index: dict[int, list[tuple[int, int]]] = {}
        self.rank = {c: i for i, c in enumerate(sorted({int(c) for t in templates for c in codes(t.text)}, key=lambda c: (frequency.get(c, 0), c)))}
        for i, t in enumerate(templates):
            sequence = codes(t.text)
            tokens = sorted({int(c) for c in sequence}, key=self.rank.__getitem__)
            if not tokens:
                raise ValueError("a template has words")
            needed = math.ceil(t.threshold * len(tokens) - 1e-9)
            self.sequences.append(sequence)
            self.order.append(tokens)
            self.needed.append(max(1, needed))
            for place, c in enumerate(tokens[: len(tokens) - self.needed[-1] + 1]):
                index.setdefault(c, []).append((i, place))
        self.index = index
        self.prefix = np.array(sorted(index), np.uint64)
        self.vocabulary = np.array(sorted(self.rank), np.uint64)

    def regions(self, n: int, rare: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of a text of n words that hold all windows with a word of rare, each window whole in one of them."""
        if len(rare):
            gap = np.flatnonzero(np.diff(rare) >= 2 * self.widest - 1)
            for first, last in zip(rare[np.append(0, gap + 1)].tolist(), rare[np.append(gap, -1)].tolist(), strict=True):
                yield max(0, first - self.widest + 1), min(n, last + self.widest)

    def candidates(self, own: np.ndarray, shared: list[int]) -> Iterator[int]:
        """Templates that some window of a stretch may match, by its words and its template tokens in the order."""
        n, seen = len(np.unique(own)), set()
        for at, c in enumerate(shared):
            for i, place in self.index.get(c, ()):
                if i in seen:
                    continue
                seen.add(i)  # c is the first shared token of the order, so positions bound the overlap
                if n >= self.needed[i] and min(len(self.order[i]) - place, len(shared) - at) >= self.needed[i]:
                    yield i

    def most(self, i: int, places: list[int], tokens: list[int]) -> int:
        """The most tokens of template i in any of its windows, by the places of template tokens."""
        wanted, inside = set(self.order[i]), {}
        held = [(p, c) for p, c in zip(places, tokens, strict=True) if c in wanted]
        left = best = 0
        size = self.windows[i]
        for p, c in held:
            inside[c] = inside.get(c, 0) + 1
            while held[left][0] <= p - size:
                gone = held[left][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            best = max(best, len(inside))
        return best

    def scan(self, code: np.ndarray, rare: np.ndarray) -> tuple[dict[int, float], dict[int, list[int]]]:
        """Best containment by template, and the first words of phrase places by template; rare: where prefix tokens stand."""
        best: dict[int, float] = {}
        places: dict[int, list[int]] = {}
        for start, end in self.regions(len(code), rare):
            own = code[start:end]
            near = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            at = np.flatnonzero(self.vocabulary[near] == own)
            at, tokens = at.tolist(), own[at].tolist()
            for i in self.candidates(own, sorted(set(tokens), key=self.rank.__getitem__)):
                overlap = self.most(i, at, tokens)
                if overlap < self.needed[i]:
                    continue
                if self.templates[i].phrase:
                    word = self.sequences[i]
                    found = [start + int(p) for p in np.flatnonzero(own[: max(0, len(own) - len(word) + 1)] == word[0]) if (own[p : p + len(word)] == word).all()]
                    if not found:
                        continue
                    places.setdefault(i, []).extend(found)
                best[i] = max(best.get(i, 0.0), overlap / len(self.order[i]))
        return best, {i: sorted(set(p)) for i, p in places.items()}


def scan(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """`df` with ``n_words`` and ``matches``, an array of (template, label, phrase, base, score, places).

    Each template that some window of the text matches is there once, with its best
    containment; ``places`` has the first words of a phrase's occurrences, and a phrase
    without any is no match. A null or empty text has no words and no matches. Of templates
    with equal scores all are reported; repeated rows have equal matches, and an empty
    table stays empty. A very long text is scanned in one task, in time that grows with
    its template tokens. Templates may be of any length and number; they are sent to every
    executor, and a task's index takes about 150 bytes for each of their distinct words.
    Columns of these two names are replaced, others are carried along.
    """
    match = T.StructType([T.StructField(n, t) for n, t in (("template", T.IntegerType()), ("label", T.StringType()), ("phrase", T.BooleanType()), ("base", T.BooleanType()), ("score", T.DoubleType()), ("places", T.ArrayType(T.LongType())))])
    made = (("n_words", T.LongType()), ("matches", T.ArrayType(match)))
    kept = df.select(*(c for c in df.columns if c not in dict(made)))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in made)])
    shared = df.sparkSession.sparkContext.broadcast((templates, frequencies(df, text, templates)))
    kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("phrase", pa.bool_()), ("base", pa.bool_()), ("score", pa.float64()), ("places", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Join(*shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in steps(batch, text):
                cut = words(part.column(at))
                near = np.minimum(np.searchsorted(join.prefix, cut.code), len(join.prefix) - 1)
                rare = np.flatnonzero(join.prefix[near] == cut.code)
                split = np.searchsorted(rare, cut.first)
                found = []
                for i in range(part.num_rows):
                    own = rare[split[i] : split[i + 1]] - cut.first[i]
                    best, places = join.scan(cut.text(i), own) if len(own) else ({}, {})
                    found.append([{"template": j, "label": join.templates[j].label, "phrase": join.templates[j].phrase, "base": join.templates[j].base, "score": s, "places": places.get(j, [])} for j, s in sorted(best.items())])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(cut.first)), pa.array(found, kind)], schema.fieldNames())

    return kept.mapInArrow(run, schema)
