"""The n-gram join against all pairs compared by brute force."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from ordinale.llm import near
from ordinale.llm.words import words, words_of


def shingle_set(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{key: (class, links)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted, common = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for ids in inverted.values():
        for a, b in combinations(sorted(ids), 2):
            common[a, b] += 1
    links = dict.fromkeys(sets, 0)
    for (a, b), n in common.items():
        if n * 10 >= 8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(df).collect()}


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_chains_and_large_groups(documents, prose, monkeypatch):
    """A chain of edits, a group split over several blocks, copies and texts at the threshold."""
    monkeypatch.setattr(near, "BLOCK_TEXTS", 8)
    base = prose(1, 300).split()
    rows = []
    for i in range(60):
        edited = list(base)
        for j in range(i % 7):
            edited[(37 * i + 41 * j) % 300] = f"edit{i}x{j}"
        rows.append((i, " ".join(edited)))
    chain = prose(2, 120).split()
    for i in range(60, 80):
        chain = chain[2:] + [f"c{i}a", f"c{i}b"]
        rows.append((i, " ".join(chain)))
    rows += [(i, prose(3, 40)) for i in range(80, 95)] + [(i, prose(100 + i, 80)) for i in range(95, 120)]
    nine = " ".join(f"w{i}" for i in range(13))  # nine shingles; eight of ten are 0.8
    rows += [(120, nine), (121, " ".join(f"w{i}" for i in range(12))), (122, nine + " more"), (123, "short one"), (124, "short  ONE!"), (125, "another short")]
    got = result(documents(rows))
    assert got == brute(rows)
    assert len({got[i][0] for i in range(60, 80)}) == 1


def test_odd_rows(spark, documents, odd, clashing):
    df, names = clashing(documents(odd))
    out = near.near_duplicates(df).collect()
    renamed = df.drop("fp", "_hash").withColumnsRenamed({"doc_id": "fp", "text": "_hash"})  # keys and texts called like working columns
    assert {(r.fp, r.class_id) for r in near.near_duplicates(renamed, "fp", "_hash").collect()} == {(r.doc_id, r.class_id) for r in out}
    assert len(out) == len(odd)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.class_id, r.n_links))
    assert by[1] == [(1, 0)] and by[2] == [(2, 0)] and by[3] == [(3, 1), (3, 1)] and by[7] == [(7, 1)]
    assert sorted(by[None], key=str) == [(7, 1), (None, 0)]
    one = near.one_of_each(df)
    assert one.columns == df.columns
    one = one.collect()
    kept = sorted((str(r.doc_id), len(r.text or "")) for r in one)
    assert kept == sorted((str(i), len(t or "")) for i, t in odd if (i, t) not in ((None, "a few words here"), (3, "one"))) + [] or ("3", 3) in kept
    assert sum(k == ("3", 3) for k in kept) == 1
    assert all(r[n] == f"own {n}" for r in one for n in names)
    assert near.one_of_each(documents([])).count() == 0


def test_shortest_prefix_reaches_the_recall():
    d = near.prefix_depth()
    assert near.found(0.8, d) >= near.RECALL > near.found(0.8, d + 1)
    assert near.prefix_depth(0.3, 0.999999) == 1 and near.prefix_depth(1.0, 1.0) == near.DEPTH


def table(texts, copies, side):
    codes, first = near.shingles(words(pa.array(texts)))
    c, at, _ = near.sets(codes, first)
    return pa.table({"fp": [30, 10, 20], "copies": copies, "side": side, "codes": pa.array([c[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})


def test_verify_matrix_in_slices(prose, monkeypatch):
    monkeypatch.setattr(near, "MATRIX", 600)
    texts = [prose(1, 400), prose(1, 400) + " tail of it", prose(2, 400)]
    out = near.verify(table(texts, [1, 2, 1], [2, 2, 2]), 0.8, [8, 7]).to_pydict()
    similar = 396 / 399
    assert (out["fp"], out["root"], out["links"]) == ([30, 10, 20], [10, 10, 20], [2, 1, 0])
    assert out["missed"][1] == pytest.approx([1 / near.found(similar, d) - 1 for d in (8, 7)], abs=1e-12) and out["missed"][2] == [0, 0]
    across = near.verify(table(texts, [1, 2, 1], [0, 0, 1]), 0.8, []).to_pydict()
    assert across["links"] == [0, 0, 0] and across["root"] == [30, 10, 20]


def test_nodes_of_the_sorted_tries():
    """The runs of each prefix that add texts, whatever the batches; those cut by a batch's end are kept in any case."""
    rng = np.random.default_rng(2)
    rows = sorted((int(t), int(x)) for t, x in zip(rng.integers(0, 2, 300), rng.choice(np.array([0, 1, 2, 1 << 8, 1 << 16, 3 << 16, 1 << 40]), 300) + rng.integers(0, 3, 300), strict=True))
    by = {d: defaultdict(set) for d in (8, 7, 6)}
    for fp, (t, x) in enumerate(rows):
        for d in by:
            by[d][t, x >> 8 * (8 - d)].add(fp)
    for size in (1, 7, 50, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + size]], pa.int32()), pa.array([r[1] for r in rows[i : i + size]], pa.int64()), pa.array(range(i, min(i + size, 300)), pa.int64())], ["tree", "label", "fp"]) for i in range(0, 300, size)]
        got = defaultdict(set)
        for b in near.nodes(iter(batches), 6):
            for d, node, fp in zip(*b.to_pydict().values(), strict=True):
                got[d, node].add(fp)
        for d in by:
            want = {frozenset(s) for k, s in by[d].items() if len(s) > 1 and (d == 8 or len({rows[f] for f in s} if d == 7 else {rows[f][1] >> 8 for f in s}) > 1)}
            here = {frozenset(s) for (k, _), s in got.items() if k == d}
            assert want <= here and all(s in {frozenset(x) for x in by[d].values()} for s in here)


def test_prefixes_shorten_only_for_open_texts(documents, prose, monkeypatch):
    """Twenty texts with nineteen close links each are done one step before texts with one link are."""
    base = prose(1, 300).split()
    rows = [(i, " ".join(f"e{i}" if j == 11 * i else w for j, w in enumerate(base))) for i in range(20)]
    searched = []
    plain = near._pairs
    monkeypatch.setattr(near, "_pairs", lambda met: searched.append(met.where("open").count()) or plain(met))
    assert result(documents(rows)) == brute(rows)
    assert len(searched) == 3 and searched[0] > 0 and searched[1] > 0 == searched[2]
    searched.clear()
    few = [(50, prose(9, 300)), (51, " ".join(prose(9, 300).split()[:270] + ["x"] * 30))]
    assert result(documents(few)) == brute(few)
    assert len(searched) == 3 and searched[2] > 0


def test_long_texts_meet_in_occupied_blocks_only(spark, documents, prose, monkeypatch):
    """Two texts of many times a block's size are two blocks, and compared once."""
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 500)
    tasks = []
    plain = near._pairs
    monkeypatch.setattr(near, "_pairs", lambda met: tasks.append(plain(met).count()) or plain(met))
    long = prose(1, 20_000)
    rows = [(1, long), (2, long + " and more"), (3, prose(2, 100))]
    assert result(documents(rows)) == brute(rows)
    assert 1 <= sum(tasks) <= 3


def test_sizes_too_far_apart_are_not_compared(spark, documents, prose, monkeypatch):
    """Blocks meet if a node has texts of both, one of them is open, and their bands of set sizes follow each other."""
    rows = [(1, 10, 0, True), (1, 10, 0, True), (1, 11, 1, False), (1, 12, 2, False), (2, 12, 2, True), (2, 13, None, False), (3, 11, 1, False), (3, 12, 2, False), (4, 14, 5, True), (5, 10, 0, True), (5, 14, 5, True)]
    met = spark.createDataFrame(rows, "node long, block long, band int, open boolean")
    assert sorted(map(tuple, near._pairs(met).collect())) == [(10, 10), (10, 11), (12, 13)]
    monkeypatch.setattr(near, "BLOCK_TEXTS", 8)
    long = prose(1, 900).split()
    texts = [(k, " ".join(long[: 60 + 14 * k])) for k in range(60)] + [(100 + k, " ".join([*long[:500], f"x{k}"])) for k in range(20)]
    assert result(documents(texts)) == brute(texts)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_linked_sets_are_in_bands_that_follow_each_other(threshold):
    """The largest set that can be linked to one of n is in the next band at most, also where logarithms are rounded."""
    width = -np.log(threshold - 1e-6)
    n = np.arange(1, 200_000)
    most = np.floor(n / threshold + 1e-9)
    assert (np.floor(np.log(most) / width) - np.floor(np.log(n) / width) <= 1).all()


def test_recall_by_similarity(documents):
    """Pairs of random texts at given similarities, most of them just above the threshold: none is missed."""
    rows, want = [], 0
    for k in range(400):
        n = 200 + k % 100
        w = [f"w{k}x{i}" for i in range(n)]
        other = w[: n - 1 - int(n * (k % 9) / 100)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    want = brute(rows)
    assert result(documents(rows)) == want and sum(n for _, n in want.values()) == 800


@pytest.mark.parametrize("text", ["", "...", "a b c d", "a b c d e", "a a a a a a a"])
def test_shingles(text):
    codes, first = near.shingles(words(pa.array([text, "p q r s t u", text])))
    assert first[1] - first[0] == len([1 for _ in range(max(1, len(words_of(text)) - 4))] if words_of(text) else [])
    assert (codes[first[0] : first[1]] == codes[first[2] : first[3]]).all()
