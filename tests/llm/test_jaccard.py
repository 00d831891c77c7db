"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperloom.llm import entry, jaccard
from paperloom.llm.jaccard import drop_near_copies, jaccard_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    n = min(n, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def plain(rows):
    """(set size, component) of each document, by overlap counts over an inverted index."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        for j, common in Counter(j for g in sets[i] for j in index[g]).items():
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            index[g].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, label string, size int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice("abcdefgh") * rng.randint(1, 4)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "One\ttwo", "one  two three four five", "ONE two three four\x0bFive six", "é " * 5, "É " * 5]
    for _ in range(8):
        base = " ".join(word() for _ in range(rng.randint(6, 120)))
        texts += copies(rng, base, rng.randint(1, 12), 4)
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)]  # one passage, some of it linked
    hot = " ".join(word() for _ in range(80))
    texts += copies(rng, hot, 150, 6) + [hot] * 50
    rng.shuffle(texts)
    rows = list(enumerate(texts, 5))
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "TILE_GRAMS", 500)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    monkeypatch.setattr(jaccard, "PAIRS", 100)
    monkeypatch.setattr(jaccard, "SHARD", 50)
    assert run(spark, rows) == plain(rows)


def test_nulls_repeats_and_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = "a b c d e f g h"
    assert run(spark, [(1, same), (1, same), (None, same), (2, same), (3, None)]) == {1: (4, 1), 2: (4, 1), 3: (0, 3)}
    df = spark.createDataFrame([(2, same, "x"), (1, same, "y"), (None, same, "z"), (3, "", "w")], "doc_id long, text string, _gone string")
    assert sorted(((r.doc_id or 0), r._gone) for r in drop_near_copies(df).collect()) == [(0, "z"), (1, "y"), (3, "w")]


def test_the_comparison_is_exact_beyond_single_precision():
    a = np.array([2_800_006])
    assert not jaccard.linked(np.array([[2_400_005]]), a, a, 3, 4)[0, 0] and jaccard.linked(np.array([[2_400_006]]), a, a, 3, 4)[0, 0]
    n = 1 << 28
    assert jaccard.linked(np.array([[n]]), np.array([n]), np.array([n // 3 * 4 + 1]), 3, 4)[0, 0] and not jaccard.linked(np.array([[n]]), np.array([n]), np.array([n // 3 * 4 + 2]), 3, 4)[0, 0]


@pytest.mark.parametrize("dense", [0, 4, 10**9])
def test_tiles_against_plain_overlaps(monkeypatch, dense):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    monkeypatch.setattr(jaccard, "ROWS", 4)
    monkeypatch.setattr(jaccard, "COLUMNS", 8)
    rng = np.random.default_rng(dense % 7)
    for _ in range(20):
        base = rng.choice(200, 40, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 40), replace=False), rng.choice(200, rng.integers(0, 6))])).astype(np.uint64) for _ in range(30)]
        left, right = np.sort(rng.choice(30, 11, replace=False)), np.sort(rng.choice(30, 23, replace=False))
        a, b = jaccard.tile_links(np.arange(30) + 100, sets, left, right, 3, 4)
        label = jaccard.forest(a - 100, b - 100, 30)
        i, j = np.array([(x, y) for x in left for y in right if 4 * len(np.intersect1d(sets[x], sets[y])) >= 3 * len(np.union1d(sets[x], sets[y]))]).T
        assert (label == jaccard.forest(i, j, 30)).all() and len(set(label)) < 30


def test_the_first_pass_sends_as_much_for_many_blocks(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(50_000)}" for _ in range(300))) for k in range(200)], "doc_id long, text string").repartition(1)
    ids, sent = docs.select("doc_id"), []
    for blocks in (1, 200):  # 296 n-grams of a document
        rows = jaccard.slice_rows(docs, 5, blocks, ids.limit(0), ids).collect()
        sent.append(sum(len(r.grams) + len(r.owners) + len(r.classes) + len(r.shared) for r in rows))
    assert 200 * 296 * 4 < sent[1] < min(1.02 * sent[0], 200 * 296 * 6)


def test_groups_of_many_tiles_that_fall_apart(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    common = " ".join(word() for _ in range(24))
    texts = []
    for _ in range(6):  # groups that share a passage, linked within and hardly across
        own = common + " " + " ".join(word() for _ in range(12))
        texts += copies(rng, own, 25, 1)
    texts += [common + " " + " ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "TILE", 8)
    assert run(spark, rows) == plain(rows)


def test_what_cannot_link_joins_no_group(spark, monkeypatch):
    """Documents that all share a passage, each half as long again as the one before, and a group that falls apart."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    groups, read = [], []
    linked, multiplied = jaccard.linked_in_groups, jaccard.products
    monkeypatch.setattr(jaccard, "linked_in_groups", lambda sets, found, *a: (groups.append(found.groupBy("label").count().toPandas()["count"].tolist()), linked(sets, found, *a))[1])
    monkeypatch.setattr(jaccard, "products", lambda sets, *a: (read.append(sets.count()), multiplied(sets, *a))[1])
    passages = [" ".join(word() for _ in range(30)) for _ in range(14)]
    texts = [" ".join(passages[:k]) for k in (1, 2, 3, 5, 8, 13)]
    assert run(spark, list(enumerate(texts))) == plain(list(enumerate(texts)))
    assert groups == [[]]
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "CELLS", 1)  # any order is right
    groups.clear()
    read.clear()
    common = " ".join(word() for _ in range(24))
    texts = [c for _ in range(4) for c in copies(rng, common + " " + " ".join(word() for _ in range(12)), 10, 1)]
    texts += [c for _ in range(100) for c in copies(rng, " ".join(word() for _ in range(60)), 2, 2)]
    assert run(spark, list(enumerate(texts))) == plain(list(enumerate(texts)))
    assert max(groups[0]) > 8 and len(read) == 2 and read[1] < 80 < read[0]


@pytest.mark.parametrize("holders", [2, 1000])
def test_proposals_connect_all_links(spark, monkeypatch, holders):
    monkeypatch.setattr(jaccard, "HOLDERS", holders)
    monkeypatch.setattr(jaccard, "ENTRIES", 300)
    rng = random.Random(holders)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    texts = []
    for _ in range(12):  # parts of one text, of many lengths
        base = [word() for _ in range(90)]
        for _ in range(25):
            a = rng.randrange(40)
            texts.append(" ".join(base[a : a + rng.randint(6, 90)]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == plain(rows)


def test_exact_bound(spark):
    words = [f"w{k}" for k in range(40)]
    a = " ".join(words[:11])  # 7 shingles
    b = " ".join(words[:11] + ["x"])  # 8 shingles, 7 in common: 7 / 8
    c = " ".join(words[:10])  # 6: 6 / 8 of b, exactly three quarters
    assert run(spark, [(1, b), (2, c)]) == {1: (8, 1), 2: (6, 1)}
    d = " ".join(words[:9])  # 5 / 7 of a
    assert run(spark, [(1, a), (2, d)]) == {1: (7, 1), 2: (5, 2)}


def test_a_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(60_000))
    got = run(spark, [(1, long), (2, long + " tail"), (3, "x" * 200_000)])
    assert got[1][1] == got[2][1] == 1 and got[3] == (1, 3)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in entry.op7_jaccard(spark, "/root/testdata/sf0.01").collect()} == plain(rows)
