"""Repeated passages against every stretch of fifty words compared by brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from ordinale.llm import passages
from ordinale.llm.words import words_of


def brute(rows):
    at = defaultdict(set)
    own = {}
    for i, t in rows:
        own[i] = words_of(t)
        for k in range(len(own[i]) - 49):
            at[tuple(own[i][k : k + 50])].add(i)
    out = {}
    for i, w in own.items():
        met = [(k, at[tuple(w[k : k + 50])]) for k in range(len(w) - 49)]
        out[i] = (len(w), [k for k, d in met if len(d) > 1], [k for k, d in met if min(d) < i])
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.starts, r.later) for r in passages.repeated(df).collect()}


def planted(prose):
    p, q = prose(900, 51), prose(901, 120)
    rows = [(i, prose(i, 150 + 11 * i)) for i in range(40)]
    for i in (3, 9, 21):
        rows[i] = (i, f"{prose(i + 200, 70)} {p} {prose(i + 300, 33)}")
    for i in (4, 10):
        rows[i] = (i, f"{q} {prose(i + 400, 90)} {p}")
    cut = q.split()
    rows += [(40, " ".join(cut[:60]) + " " + prose(40, 60)), (41, prose(41, 60) + " " + " ".join(cut[61:])), (42, prose(7, 227)), (43, prose(7, 227)), (44, rows[5][1]), (45, " ".join(cut[:49])), (46, "same " * 300), (47, "same " * 120 + "other"), (48, p), (49, " ".join(cut[30:90]) + " " + " ".join(cut[30:90]))]
    return rows


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_planted(documents, prose):
    rows = planted(prose)
    assert result(documents(rows).repartition(7)) == brute(rows)


def test_removal(documents, prose, clashing):
    rows = planted(prose)
    df, names = clashing(documents(rows))
    out = passages.remove_repeats(df)
    assert out.columns == df.columns
    left = {r.doc_id: r for r in out.collect()}
    for i, (_, _, later) in brute(rows).items():
        w = dict(rows)[i]
        if not later:
            assert left[i].text == w
            continue
        gone = {k for s in later for k in range(s, s + 50)}
        want = [x for k, x in enumerate(words_of(w)) if k not in gone]
        assert (i not in left) if not want else words_of(left[i].text) == want
    assert all(r[n] == f"own {n}" for r in left.values() for n in names)


def test_odd_rows(documents, odd):
    df = documents(odd)
    out = passages.repeated(df).collect()
    assert len(out) == len(odd)
    assert sorted(passages.remove_repeats(df).collect(), key=str) == sorted(df.collect(), key=str)
    assert passages.repeated(documents([])).count() == 0 and passages.remove_repeats(documents([])).count() == 0


def test_neighbours_across_batches():
    rng = np.random.default_rng(3)
    rows = sorted((int(s), int(t)) for s, t in zip(rng.integers(0, 60, 400), rng.integers(0, 9, 400), strict=True))
    held = {s: {t for x, t in rows if x == s} for s, _ in rows}
    want = {r for r in rows if len(held[r[0]]) > 1}
    for size in (1, 2, 7, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array([bytes([7] * 17 + [s]) for s, _ in rows[i : i + size]]), pa.array([t for _, t in rows[i : i + size]], pa.int64()), pa.array([1] * len(rows[i : i + size]), pa.int32())], ["head", "_hash", "n"]) for i in range(0, 400, size)]
        got = [(s[-1], t) for b in passages.neighbours(iter(batches)) for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert len(got) == len(set(got)) and want <= set(got)
        assert set(got) - want <= {r for r in rows if r[0] in (rows[0][0], rows[-1][0])}


def test_large_runs_are_met_by_grouping(documents, prose, monkeypatch):
    """The same result whether a run's matches are grown pair by pair or its stretches are grouped."""
    rows = planted(prose)
    for run in (0, 4):
        monkeypatch.setattr(passages, "RUN", run)
        assert result(documents(rows).repartition(3)) == brute(rows)


def test_matches_with_several_texts(documents, prose):
    """The longest match to the left is with another text than the one to the right, and neither reaches the length alone."""
    left, middle, right = prose(1, 20), prose(2, 30), prose(3, 20)
    rows = [(1, f"{prose(11, 60)} {left} {middle} {prose(12, 60)}"), (2, f"{prose(13, 60)} {middle} {right} {prose(14, 60)}"), (3, f"{prose(15, 60)} {left} {middle} {right} {prose(16, 60)}"), (4, f"{prose(17, 60)} {middle} {prose(18, 60)}")]
    want = brute(rows)
    assert result(documents(rows)) == want and want[3][1] and want[4][1] == []


def test_order_of_documents_with_equal_and_null_keys(documents, prose):
    """Keys order documents whatever else is in the table; nulls come last, and equal keys go by their texts."""
    p = prose(900, 60)
    rows = [(5, f"{p} {prose(1, 80)}"), (9, f"{prose(2, 80)} {p}"), (7, f"{prose(3, 70)} {p} x"), (2, prose(4, 90))]
    plain = {r.doc_id: r.text for r in passages.remove_repeats(documents(rows)).collect()}
    assert words_of(plain[5]) == words_of(rows[0][1]) and (len(words_of(plain[9])), len(words_of(plain[7]))) == (80, 71)
    more = rows + [(2, prose(5, 90)), (None, f"{p} null"), (None, prose(6, 60))]
    got = [(r.doc_id, r.text) for r in passages.remove_repeats(documents(more)).collect()]
    assert {(i, t) for i, t in got if i in (5, 7, 9)} == set(plain.items()) - {(2, plain[2])}
    assert (None, "null") in got


def test_removal_from_many_texts_at_once():
    texts = pa.array(["a b, c d.", None, "", "(x) y z", "no change!", "p q r s t"])
    out, gone = passages.without(texts, pa.array([[1], None, None, [0, 1], None, [0, 3]], pa.list_(pa.int32())), 2)
    assert out.to_pylist() == ["a d.", None, "", "(", "no change!", "r "] and list(gone) == [False, False, False, True, False, False]


def test_keys_called_like_working_columns(documents, prose):
    rows = planted(prose)
    df = documents(rows).withColumnsRenamed({"doc_id": "stretch", "text": "_hash"})
    assert {r["stretch"]: (r.n_words, r.starts, r.later) for r in passages.repeated(df, "stretch", "_hash").collect()} == brute(rows)


def test_merged(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([],), ([0],), ([0, 1, 2, 60, 110, 111, 300],)], "s array<int>")
    got = [[tuple(p) for p in r[0]] for r in df.select(passages.merged(F.col("s"))).collect()]
    assert got == [[], [(0, 50)], [(0, 52), (60, 161), (300, 350)]]


def test_anchors_cover_and_depend_on_content_only():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 40, 600).astype(np.uint64)
    code[200:300] = code[400:500]
    start, at = passages.anchors(code, np.zeros(600, int))
    assert (start == np.arange(551)).all() and ((at >= start) & (at + passages.HEAD <= start + passages.LENGTH)).all()
    assert (at[200:251] - 200 == at[400:451] - 400).all()
