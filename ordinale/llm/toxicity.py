"""Toxicity by a weighted lexicon, matched by one Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs of Latin letters and digits or signs that
stand for letters replaced, words joined by single spaces. The lexicon (words and word
beginnings with log-odds weights) is learned from a bounded sample of labelled rows; one
automaton finds all its terms, and exception phrases blank the terms they cover. The sum
of the weights is normalised by the text's length and turned into a score by a logistic
fit on the same sample.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fitting import labelled, logistic, with_label
from .words import FOLD, steps
from .workers import tidy

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвеіјкмнорсѕтухԁһӏαβεικνορτυχω", "abbeijkmhopcstyxdhlabeiknoptuxw", strict=True))
#: Digits and signs written for letters.
SIGNS = dict(zip("0134578@$", "oieastbas", strict=True))
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum", "pathetic fallacy", "class clown")
#: Beginnings of words have every length from 3 to this one, and then each half as long again as the one before.
DENSE_PREFIX = 10
#: The log-odds of every text where nothing could be learned.
UNKNOWN = -4.0
#: Evidence that a term needs (counts times Kullback-Leibler divergence from the toxic share): chance alone reaches it once in some thousand terms.
EVIDENCE = 8.0
#: Toxic documents that a term needs, whatever the size of the sample.
LEAST = 3

_FOREIGN = re.compile("[" + "".join(HOMOGLYPHS) + "А-Яа-яΑ-Ωα-ω]")
_LOOK = str.maketrans(HOMOGLYPHS)
_BYTES = bytearray(FOLD)
for _sign, _letter in SIGNS.items():
    _BYTES[ord(_sign)] = ord(_letter)
_BYTES = bytes(_BYTES)


def fold(text: str | None) -> str:
    """The words of a text as they are matched, with a space around each; empty for none."""
    text = text or ""
    if _FOREIGN.search(text):
        text = text.lower().translate(_LOOK)
    words = text.encode("utf-8", "replace").translate(_BYTES).split()
    return " " + b" ".join(words).decode() + " " if words else ""


def terms(folded: str) -> set[str]:
    """What may become a term: each word with its spaces, and its beginnings. Of a long word these are three times its length together."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        n = 3
        while n <= len(w):
            out.add(" " + w[:n])
            n += 1 if n < DENSE_PREFIX else n // 2
    return out


class Model(NamedTuple):
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    intercept: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.lexicon.items():
            a.add_word(t, (len(t), w))
        for phrase in self.exceptions:
            t = fold(phrase)
            if t:
                a.add_word(t, (len(t), None))
        a.make_automaton()
        return a


def weigh(folded: str, automaton) -> tuple[int, float]:
    """How many terms stand in a text, and the sum of their weights by its length in words.

    A term within an exception phrase doesn't count: of the phrases that begin no later
    than the term one must reach its end, so the farthest end of those is looked up.
    """
    found, blank = [], []
    for end, (length, weight) in automaton.iter(folded):
        (blank if weight is None else found).append((end - length + 1, end, weight))
    if blank:
        blank.sort(key=lambda x: x[0])
        starts, far, most = [], [], -1
        for b, e, _ in blank:
            most = max(most, e)
            starts.append(b)
            far.append(most)
        found = [x for x in found if not (at := bisect.bisect_right(starts, x[0])) or far[at - 1] < x[1]]
    return len(found), sum(x[2] for x in found) / math.log2(2 + folded.count(" ")) if found else 0.0


def _scan(df: DataFrame, text: str, model: Model) -> DataFrame:
    made = (("n_terms", T.LongType()), ("weight", T.DoubleType()))
    kept = df.select(*(c for c in df.columns if c not in ("n_terms", "weight")))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in made)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.automaton() if model.lexicon else None
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in steps(batch, text):
                both = [weigh(f, automaton) if automaton is not None and (f := fold(t)) else (0, 0.0) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.float64())], schema.fieldNames())

    return kept.mapInArrow(tidy(run), schema)


def _evidence(toxic: int, clean: int, share: float) -> float:
    """The evidence that EVIDENCE is about, of a term in so many documents where `share` of all are toxic."""
    n = toxic + clean
    return sum(k * math.log(k / n / p) for k, p in ((toxic, share), (clean, 1 - share)) if k)


def _families(found: dict) -> dict[str, float]:
    """Weights of the terms that stand for their families of beginnings."""
    lexicon: dict[str, float] = {}
    ordered = sorted(found)
    for t in sorted(found, key=lambda t: (len(t), t)):
        if any(t[:n] in found for n in range(4, len(t))):
            continue  # a shorter beginning stands for its family
        best = t
        family = ordered[bisect.bisect_left(ordered, t) : bisect.bisect_left(ordered, t + "\U0010ffff")]
        for longer in sorted(family, key=len):
            if found[longer].toxic >= 0.95 * found[t].toxic:
                best = longer
        lexicon[best] = found[best].odds
    return lexicon


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int | None = None, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Fit the lexicon and the score on at most `rows` labelled documents (fitting.SAMPLE_ROWS by default).

    A term is listed if LEAST toxic documents have it, its odds there are twenty times those
    in the rest, and chance would hardly bring that about. A large sample tests very many
    terms, and copies of its toxic documents share many words, so a term that less than a
    hundredth of them have must also be what is toxic there: it is judged by the toxic
    documents without any commoner term, and chance must let one of all tested terms through
    at most. Of the beginnings of one word the longest that loses no more than a twentieth
    of the documents stays. Unless the sample holds both labels there is nothing to learn:
    the lexicon is empty and every score is low.

    Every term that passes is listed. Each stands in LEAST toxic documents of the bounded
    sample, so their number is bounded by the sample's words: about 200 bytes a term on
    the driver and 500 in each worker's automaton; 20,000 terms are 4 and 10 MB.
    """
    sample = labelled(labels, label, key, **({} if rows is None else {"rows": rows}))
    if not sample:
        return Model({}, exceptions, 1.0, UNKNOWN)
    chosen = with_label(docs.select(key, F.col(text).cast("string").alias("_text")), sample, key).select("_text", "_label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for part in steps(batch, "_text"):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen[y].update(terms(fold(t)))
                    seen[y][""] += 1
        for t in [*seen[1], *(x for x in seen[0] if x not in seen[1])]:
            out.append((t, seen[1][t], seen[0][t]))
            if len(out) == 50_000:
                yield _rows(out)
        if out:
            yield _rows(out)

    out: list = []

    def _rows(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["term", "toxic", "clean"])

    counts = chosen.mapInArrow(tidy(count), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = sum(sample.values()), len(sample) - sum(sample.values())
    odds = F.log((F.col("toxic") + 0.5) / (totals[0] + 1)) - F.log((F.col("clean") + 0.5) / (totals[1] + 1))
    share = totals[0] / (totals[0] + totals[1])
    n, q = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    evidence = n * (q * F.log(q / max(share, 1e-9)) + F.when(q < 1, (1 - q) * F.log((1 - q) / max(1 - share, 1e-9))).otherwise(0.0))
    tested = counts.where((F.col("term") != "") & (n >= LEAST)).select("term", "toxic", "clean", odds.alias("odds"), evidence.alias("evidence"))
    passed = (F.col("toxic") >= LEAST) & (F.col("odds") >= math.log(20)) & (F.col("evidence") >= EVIDENCE)
    # the terms that fail are one row without a term, which tells how many they are
    rows = tested.groupBy(F.when(passed, F.col("term")).alias("term")).agg(F.max("toxic").alias("toxic"), F.max("clean").alias("clean"), F.max("odds").alias("odds"), F.max("evidence").alias("evidence"), F.count("*").alias("n")).collect()
    chance = math.log(max(1, sum(r.n for r in rows)))
    found = {r.term: r for r in rows if r.term is not None}
    listed = {t for t, r in found.items() if r.toxic >= totals[0] // 100}
    rare = set(found) - listed
    if rare:
        common = docs.sparkSession.sparkContext.broadcast(Model(_families({t: found[t] for t in listed}), exceptions, 1.0, 0.0))

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rare terms of the texts without any common one; scanned here, as a Python node before this one would need workers of its own."""
            seen: Counter = Counter()
            automaton = common.value.automaton() if common.value.lexicon else None
            for batch in batches:
                for part in steps(batch, "_text"):
                    for f in map(fold, part.column(0).to_pylist()):
                        if not f or automaton is None or not weigh(f, automaton)[0]:
                            seen.update(terms(f) & rare)
                            seen[""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        alone = {r.term: r[1] for r in chosen.where("_label = 1").select("_text").mapInArrow(tidy(tally), "term string, n long").groupBy("term").agg(F.sum("n")).collect()}  # a row a rare term at most
        left = alone.pop("", 0)
        listed |= {t for t, k in alone.items() if k >= LEAST and _evidence(k, found[t].clean, left / (left + totals[1])) >= chance}
    lexicon = _families({t: found[t] for t in listed})
    covered = Model(lexicon, exceptions, 1.0, 0.0)
    rows = _scan(chosen, "_text", covered).select("weight", "_label").collect()  # at most the sample
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model({}, exceptions, 1.0, UNKNOWN)
    slope, intercept = logistic(x[:, None], y, ridge=0.1)
    return covered._replace(slope=float(slope), intercept=float(intercept))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with ``n_terms``, ``weight`` (length-normalised) and ``toxicity`` (0 to 1).

    Null and empty texts have no terms and get the score of weight 0. Repeated rows get
    equal scores; an empty table stays empty. A very long text is folded and scanned in
    one task, in time that grows with its length and its matches. Columns of the three
    names are replaced, others are carried along.
    """
    logit = F.lit(model.slope) * F.col("weight") + F.lit(model.intercept)
    return _scan(docs.drop("toxicity"), text, model).withColumn("toxicity", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
