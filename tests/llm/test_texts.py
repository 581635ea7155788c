"""Decontamination, licence scans, toxicity, quality and packing against plain versions of the same rules."""

import hashlib
import json
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinale.llm import bpe, contamination, fitting, licences, packing, quality, queries, toxicity
from ordinale.llm.bpe import BatchEncoder
from ordinale.llm.words import FOLD, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs_of(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()}


@pytest.mark.parametrize("text", ["", None, "Ab-C_d É\u0001x9{y}~z", "ſtraße ÄÖ 😀q", "a\u00a0b\u2003c"])
def test_words(text):
    import pyarrow as pa

    from ordinale.llm.words import words

    assert [w.decode() for w in words_of(text)] == plain_words(text)
    cut = words(pa.array(["x", text, "Yy"]))
    got = [cut.data[a:b].tobytes().translate(FOLD).decode() for a, b in zip(cut.start, cut.end, strict=True)]
    assert got == ["x", *plain_words(text), "yy"]
    assert list(np.diff(cut.first)) == [1, len(plain_words(text)), 1]


def test_equal_words_have_equal_codes(prose):
    import pyarrow as pa

    from ordinale.llm.words import words

    cut = words(pa.array([prose(1, 500), prose(1, 500).upper(), None, prose(2, 500)]))
    by = defaultdict(set)
    for a, b, c in zip(cut.start, cut.end, cut.code, strict=True):
        by[cut.data[a:b].tobytes().lower()].add(int(c))
    assert all(len(c) == 1 for c in by.values()) and len({min(c) for c in by.values()}) == len(by)


# decontamination


def contamination_brute(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs.items():
        w, hit, names = plain_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_on_the_whole_table(spark, data):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/sf0.001/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_decontamination(spark, f"{data}/sf0.001").collect()}
    want = contamination_brute(docs_of(spark, data), items)
    assert got == want and any(w[4] for w in want.values())


def test_decontamination_windows_and_spans(spark, documents, prose, monkeypatch):
    item = prose(77, 20).split()
    items = [(1, " ".join(item)), (2, "Short question"), (2, "other text of the item"), (None, prose(5, 30)), (3, None), (4, " ".join(item[3:16]))]
    rows = [(1, "so " + " ".join(item[:13]).upper() + "!! end"), (2, " ".join(item[:12])), (3, "a short question, é short-QUESTION"), (4, None), (5, ""), (5, ""), (6, prose(5, 30)), (7, "😀 " + ", ".join(item))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (contamination.AUTOMATON_BYTES, 50):
        monkeypatch.setattr(contamination, "AUTOMATON_BYTES", most)
        got = {r.doc_id: r for r in contamination.find(documents(rows), bench).collect()}
        assert [list(s) for s in got[1].spans] == [[3, 3 + len(" ".join(item[:13]))]] and got[1].n_hit == 13 and got[1]["items"] == ["1"]
        assert got[2].n_hit == 0 and got[6].n_hit == 0 and got[4].n_words == 0 and got[7]["items"] == ["1", "4"] and got[7].n_hit == 20
        text = dict(rows)[3]
        assert [text[a:b] for a, b in got[3].spans] == ["short question", "short-QUESTION"]
    none = contamination.find(documents(rows), bench.limit(0))
    assert none.agg(F.sum("n_hit")).first()[0] == 0 and contamination.find(documents([]), bench).count() == 0


def test_decontamination_by_a_large_benchmark(spark, data, monkeypatch):
    """Beyond the automaton's limit, joined by code: the same on the whole table, and with items of every length."""
    monkeypatch.setattr(contamination, "AUTOMATON_BYTES", 10)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/sf0.001/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_decontamination(spark, f"{data}/sf0.001").collect()}
    assert got == contamination_brute(docs_of(spark, data), items)


@pytest.mark.parametrize("most", [contamination.AUTOMATON_BYTES, 0])
def test_decontamination_odd(spark, documents, odd, clashing, prose, monkeypatch, most):
    monkeypatch.setattr(contamination, "AUTOMATON_BYTES", most)
    df, names = clashing(documents([*odd, (20, prose(5, 40)), (20, prose(5, 40)), (21, "a few"), (22, "x " + prose(6, 5))]))
    items = [(i, prose(5 + i % 2, 1 + i)) for i in range(20)] + [(30, "one"), (31, "one"), (32, "few words"), (33, ""), (34, None), (35, "the text of a long text of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contamination.find(df.withColumn("n_hit", F.lit("old")), bench)
    assert out.columns == [*df.columns, "n_words", "n_hit", "items", "spans"]
    rows = out.collect()
    assert len(rows) == df.count() and all(r[n] == f"own {n}" for r in rows for n in names)
    for r in rows:
        want = contamination_brute({0: r.text}, items)[0]
        assert (r.n_words, r.n_hit, len(r["items"])) == want[:3] and hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == want[3]
        assert sum(len(plain_words(r.text[a:b])) for a, b in r.spans) == r.n_hit
    assert contamination.find(documents([]), bench).count() == 0


def test_decontamination_by_items_without_an_id(spark, tmp_path, documents, prose):
    import corpus_pipeline

    documents([(1, prose(5, 30)), (2, prose(6, 30)), (3, prose(7, 30))]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, prose(5, 30)), (None, prose(6, 30)), (9, prose(6, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in queries.op8_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: (30, 0, True), 2: (30, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in corpus_pipeline.without_benchmark(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()] == [3]


# licences


def licences_brute(text, templates=None):
    """Every window, one word apart, of twice a template's words or 96."""
    w = plain_words(text)
    places, labels, more, score = [], set(), set(), 0.0
    for t in licences.TEMPLATES if templates is None else templates:
        own = plain_words(t.text)
        if t.phrase:
            found = [i for i in range(len(w) - len(own) + 1) if w[i : i + len(own)] == own]
            if found:
                more.add(t.label)
                score = 1.0
                if t.base:
                    places += found
                    labels.add(t.label)
            continue
        size, want = max(96, 2 * len(own)), set(own)
        if len(want & set(w)) / len(want) >= t.threshold:
            share = max(len(want & set(w[at : at + size])) for at in range(max(1, len(w) - size + 1))) / len(want)
            if share >= t.threshold:
                more.add(t.label)
                score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score


def test_licences_on_the_whole_table(spark, data):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_licences(spark, f"{data}/sf0.001").collect()}
    assert got == {i: licences_brute(t) for i, t in docs_of(spark, data).items()}


def test_licences_planted(spark, tmp_path, documents, prose, odd):
    mit = licences.TEXTS[0].text
    rows = [(i, t) for i, t in [
        (1, "Released UNDER the MIT  license, under the-mit/license."), (2, prose(1, 94) + " under the mit license"), (3, prose(1, 70) + " " + mit + " " + prose(2, 200)), (4, " ".join(mit.split()[: len(mit.split()) * 3 // 5])),
        (5, "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0"), (6, "license mit the under " * 50), (7, "All rights reserved. " + prose(4, 500) + " cc by nc"), (8, mit.replace("copy", "clone")), (9, " ".join(f"{x} {prose(i, 1)}" for i, x in enumerate(mit.split()))),
    ]] + [(100 + k, t) for k, (_, t) in enumerate(odd)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_licences(spark, str(tmp_path)).collect()}
    assert got == {i: licences_brute(t) for i, t in rows}
    assert got[1][:4] == (9, 2, 1, 5) and got[8][5] == "mit" and got[4][5] == "" and got[7][5] == "all-rights-reserved,cc-by-nc"
    assert licences.scan(documents([])).count() == 0


def test_licences_carry_clashing_names(documents, odd, clashing):
    df, names = clashing(documents(odd))
    rows = licences.scan(df.withColumn("matches", F.lit("old"))).collect()
    assert len(rows) == len(odd) and all(r[n] == f"own {n}" for r in rows for n in names) and all(r.matches == [] for r in rows)


def labels_of(frame):
    return {r.doc_id: {m.label for m in r.matches} for r in frame.collect()}


def test_licence_notices_of_the_gpl(spark, documents, prose):
    notice = "This work is licensed under the GNU General Public License, version 3."
    got = labels_of(licences.scan(documents([(1, notice), (2, prose(1, 300) + " " + notice + " " + prose(2, 300)), (3, "A general public notice on GNU and a licence; public GNU license, general"), (4, licences.TEXTS[3].text)])))
    assert got == {1: {"gpl"}, 2: {"gpl"}, 3: set(), 4: {"gpl"}}


def test_words_of_short_notices_in_another_order_are_no_notice(spark, documents):
    rows = ["reserved seats for all who have rights", "creative commons attribution license", "Creative Commons Attribution-NonCommercial 4.0", "ShareAlike is no part of creative commons attribution", "All rights reserved."]
    got = labels_of(licences.scan(documents(list(enumerate(rows)))))
    assert got == {0: set(), 1: set(), 2: set(), 3: set(), 4: {"all-rights-reserved"}}


def test_whole_licence_texts(spark, documents, prose):
    """Texts of hundreds of words are templates: found whole, with words left out or put in, and not by a half."""
    rows, want = [], {}
    for k, t in enumerate(x for x in licences.TEXTS if len(plain_words(x.text)) > 48):
        w = plain_words(t.text)
        fewer, halved = [x for i, x in enumerate(w) if i % 12 != 5], w[: len(w) // 2]
        spread = " ".join(f"{x} {prose(i, 1)}" if i % 3 == 0 else x for i, x in enumerate(w))
        rows += [(10 * k, prose(k, 300) + " " + t.text.upper() + " " + prose(k + 1, 300)), (10 * k + 1, " ".join(fewer)), (10 * k + 2, prose(k, 100) + " " + spread), (10 * k + 3, prose(k, 80) + " " + " ".join(halved))]
    long = (licences.Template("long", prose(77, 4000)), licences.Template("short", prose(78, 60)))
    out = licences.scan(documents(rows + [(1000, prose(5, 900) + " " + prose(77, 3600) + " " + prose(6, 900)), (1001, prose(77, 1500)), (1002, prose(78, 55))]), templates=licences.TEMPLATES + long)
    got = {r.doc_id: (r.n_words, ",".join(sorted({m.label for m in r.matches})), max((m.score for m in r.matches), default=0.0)) for r in out.collect()}
    for i, t in [*rows, (1000, prose(5, 900) + " " + prose(77, 3600) + " " + prose(6, 900)), (1001, prose(77, 1500)), (1002, prose(78, 55))]:
        want[i] = licences_brute(t, licences.TEMPLATES + long)
        assert got[i] == (want[i][0], want[i][5], want[i][6]), i
    assert got[1000][1] == "long" and got[1001][1] == "" and got[1002][1] == "short" and all(got[10 * k][1] and got[10 * k + 1][1] for k in range(5))


def test_licence_notices_of_creative_commons(spark, documents):
    kinds = {"Attribution": set(), "Attribution-NonCommercial": set(), "Attribution-NoDerivatives": set(), "Attribution-ShareAlike": {"cc-by-sa"}, "Attribution-Share Alike": {"cc-by-sa"}}
    rows = [(f"Creative Commons {kind} 4.0 International{end}", want) for kind, want in kinds.items() for end in (" License", "")]
    assert labels_of(licences.scan(documents([(i, t) for i, (t, _) in enumerate(rows)]))) == {i: want for i, (_, want) in enumerate(rows)}


def test_licences_in_every_window(spark, documents, prose):
    """All windows, one word apart, of texts with templates spread over them at every offset of 73 words."""
    rows = []
    for k, t in enumerate(licences.TEXTS[:4]):
        spread = [" ".join(f"{x} {prose(n, 1)}" for n, x in enumerate(t.text.split())), " ".join(x + f" {prose(n, 4)}" * (n % 2) for n, x in enumerate(t.text.split()))]
        rows += [(f"{k} {i} {at}", prose(at, at) + f" {s} " + prose(at + 1, 100)) for i, s in enumerate(spread) for at in range(73)]
    rows += [("twice", prose(1, 60) + " " + licences.TEXTS[0].text + " " + prose(2, 80) + " " + licences.TEXTS[0].text), ("halves", " ".join(licences.TEXTS[2].text.split()[:10]) + " " + prose(3, 90) + " " + " ".join(licences.TEXTS[2].text.split()[10:]))]
    four = licences.TEXTS[:4]
    got = {i: {m.template: m.score for m in r.matches if not m.phrase} for (i, _), r in zip(rows, licences.scan(documents([(i, t) for i, (_, t) in enumerate(rows)]), templates=licences.PHRASES + four).orderBy("doc_id").collect(), strict=True)}
    want = {}
    for i, t in rows:
        w, best = plain_words(t), {}
        for k, x in enumerate(four):
            own = set(x.text.split())
            share = max(len(own & set(w[at : at + licences.BLOCK])) / len(own) for at in range(max(1, len(w) - licences.BLOCK + 1)))
            if share >= x.threshold:
                best[k + len(licences.PHRASES)] = share
        want[i] = best
    assert got == want and all(want[i] for i in want if i != "halves")


# toxicity


def test_folding():
    assert toxicity.fold("L0SER l0sеr lоser") == " loser loser loser "
    assert toxicity.fold("$cum, @b") == " scum ab " and toxicity.fold(None) == "" == toxicity.fold(" .,")


def test_exceptions_blank_their_terms():
    model = toxicity.Model({" scum": 5.0, " trash ": 4.0}, ("pond scum",), 1.0, 0.0)
    a = model.automaton()
    assert toxicity.weigh(toxicity.fold("pond scum"), a) == (0, 0.0)
    n, w = toxicity.weigh(toxicity.fold("pond scum, trash scumbag"), a)
    assert n == 2 and w == pytest.approx(9 / np.log2(2 + 5))


def test_exceptions_in_time_that_grows_with_the_text():
    import time

    a = toxicity.Model({" scum": 5.0, " trash ": 4.0}, ("pond scum", "trash can"), 1.0, 0.0).automaton()
    text = toxicity.fold("pond scum trash " * 100_000)
    begin = time.perf_counter()
    assert toxicity.weigh(text, a)[0] == 100_000 and time.perf_counter() - begin < 5


def test_exceptions_against_all_pairs():
    """Terms and phrases that overlap in every way, by comparing each with each."""
    import random

    rng = random.Random(4)
    model = toxicity.Model({" ab": 1.0, " ab ": 2.0, " b ab ": 4.0, " a b": 8.0, " aab": 16.0}, ("ab ab", "b ab a", "a b ab b", "aab a"), 1.0, 0.0)
    automaton = model.automaton()
    for _ in range(300):
        text = toxicity.fold(" ".join(rng.choice(["a", "b", "ab", "aab", "abb"]) for _ in range(rng.randint(1, 30))))
        blank = [(i, i + len(p)) for x in model.exceptions for p in [f" {x} "] for i in range(len(text)) if text.startswith(p, i)]
        found = [w for t, w in model.lexicon.items() for i in range(len(text)) if text.startswith(t, i) and not any(b <= i and i + len(t) <= e for b, e in blank)]
        assert toxicity.weigh(text, automaton) == (len(found), pytest.approx(sum(found) / np.log2(2 + text.count(" ")) if found else 0.0))


def test_toxicity_terms_of_long_words(spark, documents, prose):
    """A word of any length becomes a term; so do long beginnings."""
    word = "unbelievablylongtoxicwordofmanyletters"
    assert f" {word} " in toxicity.terms(f" {word} ") and {" " + word[:n] for n in (3, 10, 15, 22, 33)} <= toxicity.terms(f" {word} ") and sum(map(len, toxicity.terms(" " + "x" * 100_000 + " "))) < 500_000
    rows = [(i, prose(i, 40) + (f" {word}" if i % 4 == 0 else "")) for i in range(200)]
    model = toxicity.learn(documents(rows), spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int"))
    assert list(model.lexicon) == [f" {word} "]


def plain_toxicity(texts, labels):
    """Lexicon and scores by counting in plain Python, apart from the operator: all terms of all labelled texts, their evidence, families and the logistic fit."""
    import math

    look = str.maketrans({**toxicity.HOMOGLYPHS, **toxicity.SIGNS})

    def folded(text):
        text = text or ""
        if any(c in toxicity.HOMOGLYPHS or "\u0391" <= c <= "\u03c9" or "\u0410" <= c <= "\u044f" for c in text):
            text = text.lower()
        return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text.translate(look)))]

    def own_terms(ws):
        out = set()
        for w in set(ws):
            sizes, n = [], 3
            while n <= len(w):
                sizes.append(n)
                n = n + 1 if n < 10 else n + n // 2
            out |= {" " + w[:n] for n in sizes} | {f" {w} "}
        return out

    words_by = {i: folded(t) for i, t in texts.items()}
    sample = {i: y for i, y in labels.items() if y in (0, 1) and i in texts and zlib.crc32(str(i).encode()) % 4 != 2}
    both = sum(sample.values()), len(sample) - sum(sample.values())
    count = defaultdict(lambda: [0, 0])
    for i, y in sample.items():
        for t in own_terms(words_by[i]):
            count[t][1 - y] += 1
    share = both[0] / sum(both)

    def evidence(a, b, p):
        return sum(k * math.log(k / (a + b) / q) for k, q in ((a, p), (b, 1 - p)) if k)

    tested = {t: c for t, c in count.items() if sum(c) >= 3}
    good = {t: c for t, c in tested.items() if c[0] >= 3 and evidence(*c, share) >= 8 and math.log((c[0] + 0.5) / (both[0] + 1)) - math.log((c[1] + 0.5) / (both[1] + 1)) >= math.log(20)}
    assert all(c[0] >= both[0] // 100 for c in good.values()), "the rule for rare terms of large samples has a test of its own"
    lexicon = {}
    for t in good:
        if not any(len(s) >= 4 and len(s) < len(t) and t.startswith(s) for s in good):
            near = [s for s in good if s.startswith(t) and good[s][0] >= 0.95 * good[t][0]]
            best = max(near, key=len)
            lexicon[best] = math.log((good[best][0] + 0.5) / (both[0] + 1)) - math.log((good[best][1] + 0.5) / (both[1] + 1))

    def weight(ws):
        text = " " + " ".join(ws) + " " if ws else ""
        blank = [(m.start(), m.start() + len(x) + 2) for x in toxicity.EXCEPTIONS for m in re.finditer(f"(?= {x} )", text)]
        total = 0.0
        for t, w in lexicon.items():
            at = text.find(t)
            while at >= 0:
                total += 0 if any(b <= at and at + len(t) <= e for b, e in blank) else w
                at = text.find(t, at + 1)
        return total / math.log2(2 + text.count(" ")) if text else 0.0

    weights = {i: weight(w) for i, w in words_by.items()}
    x, y = np.array([weights[i] for i in sample]), np.array([float(v) for v in sample.values()])
    a = b = 0.0
    for _ in range(200):  # Newton's steps for slope and intercept
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [((p - y) * x).sum() + 0.1 * a, (p - y).sum() + 1e-6 * b])
        a, b = a - da, b - db
    return {i: 1 / (1 + math.exp(-(a * w + b))) for i, w in weights.items()}


def test_toxicity_on_the_whole_table(spark, data):
    """The query's scores against those of plain counting, at sf0.01, as fewer labels teach no terms."""
    d = f"{data}/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    want = plain_toxicity(texts, labels)
    got = {r.doc_id: r.score for r in queries.op9_toxicity(spark, d).collect()}
    assert got.keys() == want.keys() and sum(s >= 0.3 for s in want.values()) > 20
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_toxicity_held_out(spark, data):
    d = f"{data}/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, d).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(held) >= 0.95
    assert sum(s >= 0.3 for s, y in held if not y) <= 0.01 * len(held)


def test_toxicity_ignores_held_out_labels(spark, documents, prose):
    rows = [(i, prose(i, 60) + (" vilething" if i % 3 == 0 else "")) for i in range(300)]
    labels = [(i, 0, int(i % 3 == 0) if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - int(i % 3 == 0)) for i in range(300)]
    df, y = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, y)
    assert list(model.lexicon) == [" vilething "]
    scores = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    assert all((scores[i] >= 0.3) == (i % 3 == 0) for i in scores)
    assert len(fitting.labelled(y, "toxic", rows=50)) == 50


def test_toxicity_rare_terms_of_a_large_sample(spark, documents, prose):
    """A term of fewer than a hundredth of the toxic documents is learned if chance can't explain it."""
    ids = [i for i in range(13_000) if zlib.crc32(str(i).encode()) % 4 != 2][:9000]
    toxic = ids[::15]
    extra = dict.fromkeys(toxic, " vilething") | dict.fromkeys(toxic[100:105], " rarething") | dict.fromkeys(toxic[200:203], " vilething byaccident")
    docs = documents([(i, prose(i, 8) + extra.get(i, "")) for i in ids])
    model = toxicity.learn(docs, spark.createDataFrame([(i, 0, int(i in extra)) for i in ids], "doc_id long, quality int, toxic int"))
    assert len(toxic) // 100 > 5 and set(model.lexicon) == {" vilething ", " rarething "}
    assert {r.doc_id for r in toxicity.score(docs, model).where("toxicity >= 0.3").collect()} == set(toxic)


def test_toxicity_odd(spark, documents, odd, clashing):
    df, names = clashing(documents(odd))
    model = toxicity.learn(df, spark.createDataFrame([(1, 0, 1), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    out = toxicity.score(df, model)
    assert out.columns == [*df.columns, "n_terms", "weight", "toxicity"] and out.count() == len(odd)
    assert toxicity.score(documents([]), model).count() == 0
    assert toxicity.learn(documents([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).lexicon == {}


# quality


def test_quality_held_out(spark, data):
    d = f"{data}/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op1_quality(spark, d).collect()
    assert len(rows) == 1000
    held = [(r.quality, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(held) >= 0.9 and np.mean([(s >= 0.5) == y for s, y in held]) >= 0.9


def test_quality_shrinks_sparse_sites(spark):
    """The same arithmetic in plain Python: a path towards its host, a host towards the prior."""
    evidence = {("a", "x"): [0.9] * 50, ("a", "y"): [0.2], ("b", "x"): [0.1] * 40, ("b", "z"): [0.3] * 20, ("c", "x"): [0.95], (None, None): [0.5, 0.6]}
    rows = [(i, h, p, v) for i, ((h, p), vs) in enumerate(evidence.items()) for v in vs]

    def fake(docs, model, text):
        return docs.withColumn("evidence", F.round(F.col(text).cast("double") * quality.UNIT).cast("long")).drop(text)

    held, quality.evidence = quality.evidence, fake
    try:
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, v double").withColumn("text", F.col("v").cast("string"))
        got = {(r.source, r.lang): r for r in quality.classify(df, None).collect()}
    finally:
        quality.evidence = held
    prior = np.mean([r[3] for r in rows])
    hosts = defaultdict(list)
    for (h, _), vs in evidence.items():
        hosts[h] += vs

    def strength(groups):
        n = np.array([len(g) for g in groups], float)
        spread = sum(len(g) * (np.mean(g) - prior) ** 2 for g in groups)
        chance = prior * (1 - prior)
        between = max((spread - (len(groups) - 1) * chance) / (n.sum() - (n**2).sum() / n.sum()), 0)
        return min(max(chance / between - 1 if between else 1e6, 1), 1e6)

    k_host, k_path = strength(list(hosts.values())), strength(list(evidence.values()))
    for (h, p), vs in evidence.items():
        host = (sum(hosts[h]) + k_host * prior) / (len(hosts[h]) + k_host)
        path = (sum(vs) + k_path * host) / (len(vs) + k_path)
        assert got[h, p].host_quality == pytest.approx(host, abs=1e-5) and got[h, p].path_quality == pytest.approx(path, abs=1e-5)
    assert 0.2 < got["a", "y"].path_quality < got["a", "y"].host_quality


def plain_quality(rows, labels):
    """The query apart from the operator: features of each text counted in plain Python, the classifier by Newton's steps, posteriors from lists of other documents."""
    import math

    def features(text):
        text = text or ""
        ws = plain_words(text)
        if not ws:
            return [0.0] * 10
        raw = text.encode()
        letters = max(1, sum(b >= 128 or chr(b).isalpha() for b in raw))
        lines = text.split("\n")
        return [
            sum(65 <= b <= 90 for b in raw) / letters, sum(chr(b) in "#$%&*<>{}[]\\^_~=+@|/" for b in raw if b < 128) / len(raw), sum(48 <= b <= 57 for b in raw) / len(raw), text.count("|") / len(ws), text.count("!") / len(ws),
            sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / len(ws), len(set(ws)) / len(ws) ** 0.8, math.log1p(len(ws)) / 5, letters / len(ws) / 10, 1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0,
        ]

    x = {i: np.array(features(t)) for i, t, _, _ in rows}
    own = [i for i in x if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2]
    held = np.array([x[i] for i in own])
    middle, scale = held.mean(axis=0), np.maximum(held.std(axis=0), 1e-3)

    def design(v):
        z = (v - middle) / scale
        return np.concatenate((z, np.minimum(z * z, 9), np.ones((*z.shape[:-1], 1))), axis=-1)

    d, y = design(held), np.array([float(labels[i]) for i in own])
    w, ridge = np.zeros(d.shape[1]), np.array([1.0] * (d.shape[1] - 1) + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        w = w - np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.diag(ridge), d.T @ (p - y) + ridge * w)
    e = {i: round(1e6 / (1 + math.exp(-max(-30, min(30, float(design(v) @ w)))))) / 1e6 for i, v in x.items()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, h, p in rows:
        hosts[h].append(i)
        paths[h, p].append(i)
    prior = sum(e.values()) / len(e)

    def strength(groups):
        n = np.array([len(g) for g in groups], float)
        spread = sum(len(g) * (np.mean([e[i] for i in g]) - prior) ** 2 for g in groups)
        between = max((spread - (len(groups) - 1) * prior * (1 - prior)) / (n.sum() - (n**2).sum() / n.sum()), 0)
        return min(max(prior * (1 - prior) / between - 1 if between else 1e6, 1), 1e6)

    k_host, k_path = strength(list(hosts.values())), strength(list(paths.values()))
    logit = lambda v: math.log(min(max(v, 1e-4), 1 - 1e-4) / (1 - min(max(v, 1e-4), 1 - 1e-4)))
    out = {}
    for i, _, h, p in rows:
        others = [e[j] for j in hosts[h] if j != i], [e[j] for j in paths[h, p] if j != i]
        host = (sum(others[0]) + k_host * prior) / (len(others[0]) + k_host)
        path = (sum(others[1]) + k_path * host) / (len(others[1]) + k_path)
        out[i] = e[i], 1 / (1 + math.exp(-(logit(e[i]) + quality.SITE_WEIGHT * (logit(path) - logit(prior)))))
    return out


def test_quality_on_the_whole_table(spark, data):
    d = f"{data}/sf0.01"
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = plain_quality(rows, {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()})
    got = {r.doc_id: r for r in queries.op1_quality(spark, d).collect()}
    assert got.keys() == want.keys()
    for i, (own, quality_) in want.items():
        assert got[i].document_quality == pytest.approx(own, abs=2e-5) and got[i].quality == pytest.approx(quality_, abs=1e-3), i
        assert abs(quality_ - 0.5) < 1e-3 or got[i].keep == (quality_ >= 0.5)


def test_quality_counts_no_document_twice(spark, documents, prose):
    """A document alone on its path and host keeps its own odds; on a site with others only those move it."""
    rows = [(i, prose(i, 30)) for i in range(9)]
    df = documents(rows).withColumn("source", F.when(F.col("doc_id") == 0, "alone").otherwise("many"))
    got = {r.doc_id: r for r in quality.classify(df, None).collect()}
    assert all(r.document_quality == 0.5 and r.quality == pytest.approx(0.5) for r in got.values())
    held, quality.evidence = quality.evidence, lambda docs, model, text: docs.withColumn("evidence", F.when(F.length(text) % 2 == 0, 900_000).otherwise(200_000).cast("long")).drop(text)
    try:
        got = {r.doc_id: r for r in quality.classify(df, None).collect()}
    finally:
        quality.evidence = held
    assert got[0].quality == pytest.approx(got[0].document_quality, abs=0.05) and got[0].host_quality != pytest.approx(0.5, abs=1e-3)


def test_quality_odd(spark, documents, odd, clashing):
    df, _ = clashing(documents(odd).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source"))))
    out = quality.classify(df, quality.learn(df, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")))
    assert out.count() == len(odd) and out.where("quality is null or keep is null").count() == 0
    assert out.columns == [*(c for c in df.columns if c != "text"), "document_quality", "host_quality", "path_quality", "quality", "keep"]
    assert quality.classify(documents([]), None).count() == 0


# packing


def packed_checks(rows, texts, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == pieces[0].window <= 2048 and at & (at - 1) == 0
    return by_sequence


def test_packing_on_the_whole_table(spark, data):
    encode = BatchEncoder(queries.tokenizer_path())
    rows = queries.op5_packing(spark, f"{data}/sf0.001").collect()
    packed_checks(rows, docs_of(spark, data), encode.tokenizer)
    groups = defaultdict(int)
    for r in rows:
        groups[r.step_group] += r.length
    assert max(groups.values()) <= 16_384 and sum(n == 16_384 for n in groups.values()) >= len(groups) // 2


def test_packing_small_blocks(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3000)
    texts = {i: prose(i, 1 + (i * 97) % 900) for i in range(60)} | {60: None, 61: "", 62: "word " * 9000}
    out = packing.pack(documents(list(texts.items())).repartition(3), queries.tokenizer_path())
    rows = out.withColumn("ids_crc32", F.crc32("token_ids")).collect()
    sequences = packed_checks(rows, texts, BatchEncoder(queries.tokenizer_path()).tokenizer)
    assert sum(p[0].window < 256 for p in sequences.values()) <= 3 * 8  # what a task is left with at its end
    assert packing.pack(documents([]), queries.tokenizer_path()).count() == 0


def test_packing_step_groups_are_full(spark, documents, prose):
    """All step groups hold the same number of ids, but for the last one of each task."""
    texts = {i: prose(i, 1 + (i * 97) % 900) for i in range(400)}
    rows = packing.pack(documents(list(texts.items())).repartition(3), queries.tokenizer_path()).withColumn("ids_crc32", F.crc32("token_ids")).collect()
    sequences = packed_checks(rows, texts, BatchEncoder(queries.tokenizer_path()).tokenizer)
    groups = defaultdict(list)
    for pieces in sequences.values():
        groups[pieces[0].step_group].append(pieces[0].window)
    partial = [g >> 33 for g, sizes in groups.items() if sum(sizes) != 16_384]
    assert len(groups) > 6 and len(partial) == len(set(partial)) and all(sum(sizes) <= 16_384 for sizes in groups.values())
    assert any(len(set(sizes)) == 1 for sizes in groups.values())


def test_packing_repeated_and_null_keys(spark, documents, odd, clashing):
    df, names = clashing(documents(odd))
    for source in (documents(odd), df.withColumns({"window": F.lit("own"), "start": F.lit("own"), "sequence_id": F.lit("own")})):
        rows = packing.pack(source, queries.tokenizer_path()).collect()
        assert sum(r.start == 0 for r in rows) == len(odd)
        assert {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1} and sum(r.doc_id is None and r.start == 0 for r in rows) == 2
        long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.start)
        assert len(long) > 30 and [r.start for r in long][1:] == list(np.cumsum([r.length for r in long]))[:-1]


@pytest.mark.parametrize("text", ["don't we'll they've I'm he'd 'street 're''s x's's '5 '' ''s l'll", "", "  ", " <|endoftext|> ok", "a1b22 c³½ ñ×ª", "İstanbul Σας", "' s", "o'", "'", "'ll\n'l l", "Ünïcödé aaa aaaaaaa", "日本語 text", "e\u0301 combining", "x" * 5000])
def test_batch_encoder(text):
    encode = BatchEncoder(queries.tokenizer_path())
    got = encode(["before", text, "'s after"])
    assert [list(x) for x in got] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in ("before", text, "'s after")]
    assert json.dumps([int(x) for x in got[1]]) is not None


def test_batch_encoder_on_the_whole_table(spark, data):
    encode = BatchEncoder(queries.tokenizer_path())
    texts = [t or "" for t in docs_of(spark, data).values()]
    assert all(list(a) == b.ids for a, b in zip(encode(texts), encode.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True))


def test_batch_encoder_in_steps(monkeypatch):
    """Cut at spaces or not, texts have the same ids."""
    encode = BatchEncoder(queries.tokenizer_path())
    texts = ["", "don't we'll\tthey've  I'm\n" * 60, "a1b22 c³½ ñ×ª 's ' ll\r\n " * 70, "x", " " * 500, "'s", "ünïcödé " * 9, "y" * 199 + " z'll" * 90]
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for step in (1, 2, 7, 64, 300, 1 << 20):
        monkeypatch.setattr(bpe, "STEP", step)
        assert [list(x) for x in encode(texts)] == want


def test_batch_encoder_takes_bounded_memory(prose):
    """Four million characters, as many texts and as one, are not held as arrays all at once."""
    encode = BatchEncoder(queries.tokenizer_path())
    many = [prose(i, 3500) for i in range(200)]
    for texts in (many, [" ".join(many)]):
        tracemalloc.start()
        ids = encode(texts)
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert sum(map(len, texts)) > 4_000_000 and sum(map(len, ids)) > 1_000_000
        assert peak < 130 << 20, peak >> 20


def test_batch_encoder_takes_a_quarter_of_a_million_characters(prose):
    """The arrays of 2^20 characters took 37 MB in each worker beside what is kept."""
    encode = BatchEncoder(queries.tokenizer_path())
    text = prose(1, 400_000)
    tracemalloc.start()
    ids = encode([text])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(text) > 2 << 20 and len(ids[0]) > 400_000
    assert peak < 20 << 20, peak >> 20
