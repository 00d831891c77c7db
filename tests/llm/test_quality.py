"""The quality classifier against a plain Kneser-Ney, and its decisions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import entry, quality
from paperloom.llm.quality import EVEN, FOLDS, ORDER, START, TABLE, filter_quality, fold_of, grams, score_quality, shards_of, text_costs

GOOD = "The small river runs past the old mill and under the stone bridge. "


def symbol(c):
    return int(TABLE[ord(c)]) if ord(c) < 0x10000 else 0xD800 + ord(c) % 0x700


def plain_model(texts):
    """P(w | h) by the textbook recursion over dictionaries."""
    counts = [None] + [Counter() for _ in range(ORDER)]
    for t in texts:
        s = [START] * (ORDER - 1) + [symbol(c) for c in t]
        for k in range(ORDER - 1, len(s)):
            counts[ORDER][tuple(s[k - ORDER + 1 : k + 1])] += 1
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, by = [None], [None]
    for n in range(1, ORDER + 1):
        n1, n2, n3, n4 = (max(sum(c == k for c in counts[n].values()), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        off.append([0] + [min(max(d, 0.05), k) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)])
        own = defaultdict(list)
        for g, c in counts[n].items():
            own[g[:-1]].append(c)
        by.append(own)

    def p(gram):
        if not gram:
            return 1 / 65536
        n, lower = len(gram), p(gram[1:])
        seen = by[n].get(gram[:-1])
        if not seen:
            return lower
        c = counts[n][gram]
        return (c - off[n][min(c, 3)] + sum(off[n][min(x, 3)] for x in seen) * lower) / sum(seen)

    return p


def plain_cost(p, text):
    s = [START] * (ORDER - 1) + [symbol(c) for c in text or ""]
    return -sum(math.log(p(tuple(s[k - ORDER + 1 : k + 1]))) for k in range(ORDER - 1, len(s)))


TRUSTED = [GOOD * 3, "Another short text, quite different!", "ÄÖ é 漢字 123 漢語", "Ещё один текст на другом языке.", "emoji 😀😀 and\u00a0a 𝒳"]


@pytest.mark.parametrize("shard", [1_000_000, 20])
def test_model_is_kneser_ney(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD", shard)
    rows = [(k % 2, t) for k, t in enumerate(TRUSTED)]
    counts = quality.count_grams(spark.createDataFrame(rows, "fold int, text string"))
    model = list(shards_of(*quality.kneser_ney(counts)))
    assert (len(model) > 3) == (shard < 100)
    asked = TRUSTED + ["", "an unseen text? ФЫВ 漢漢", "7 8 9\n\x00", GOOD]
    for fold in range(FOLDS):
        p = plain_model([t for f, t in rows if f != fold])
        got = sum(text_costs(asked, [fold] * len(asked), folded, s, len(model)) for s, folded in enumerate(model))
        assert np.allclose(got, [plain_cost(p, t) for t in asked], rtol=1e-5)


def test_probabilities_add_up_to_one():
    p = plain_model(TRUSTED)
    known = {symbol(c) for t in TRUSTED for c in t}
    for context in ("The", "漢字 ", "qqq", " on"):
        h = tuple(symbol(c) for c in context[-3:])
        assert abs(sum(p((*h, w)) for w in known) + (65536 - len(known)) * p((*h, 0xFFF0)) - 1) < 1e-9


def plain_decisions(rows, trusted, folds, quantile=0.999):
    """(score, excess, limit) of each (id, text, lang), by dictionaries and sorting."""
    own = [(t or "", f) for (i, t, _), f in zip(rows, folds) if i in trusted]
    models = [plain_model([t for t, f in own if f == fold]) if any(f == fold for _, f in own) else None for fold in range(FOLDS)]
    cost = [plain_cost(models[1 - f] or models[f], t) for (_, t, _), f in zip(rows, folds)]
    known = [(lang, c, len(t)) for (i, t, lang), c in zip(rows, cost) if i in trusted and t]
    mean = {g: sum(c for x, c, n in known if x == g) / sum(n for x, c, n in known if x == g) for g, _, _ in known}
    z = {g: sorted((c - n * mean[g]) / math.sqrt(n + EVEN) for x, c, n in known if x == g) for g in mean}
    every = sorted(x for xs in z.values() for x in xs)
    at = lambda xs: xs[math.ceil(quantile * len(xs)) - 1]
    limit = {g: max(0, at(xs), at(every) if len(xs) * (1 - quantile) < 1 else 0) for g, xs in z.items()}
    whole = sum(c for _, c, _ in known) / sum(n for *_, n in known)
    out = []
    for (_, t, lang), c in zip(rows, cost):
        m, n = mean.get(lang, whole), len(t or "")
        out.append((c / n if n else m, (c - n * m) / math.sqrt(n + EVEN), limit.get(lang, max(limit.values()))))
    return out


@pytest.mark.parametrize("shard", [1_000_000, 40])
def test_scores_and_decisions_against_a_plain_version(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD", shard)
    rng = np.random.default_rng(5)
    words = GOOD.split()
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 30)).tolist()), ("en", "de", None)[k % 3]) for k in range(60)]
    rows += [(100 + k, "".join(rng.choice(list("qxz!&рфы漢"), 80).tolist()), ("en", "de", "xx")[k % 3]) for k in range(9)]
    rows += [(200, "", "en"), (201, None, "xx"), (None, rows[0][1], "en"), (202, rows[3][1], "de"), (5, rows[7][1], "de")]
    labels = spark.createDataFrame([(k, 1) for k in range(0, 60, 2)] + [(k, 0) for k in (1, 100, 101)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folds = [r.f for r in df.select(fold_of(F.coalesce("text", F.lit(""))).alias("f")).collect()]
    want = plain_decisions([(i, t, lang) for i, t, lang in rows], set(range(0, 60, 2)), folds)
    got = sorted(map(repr, ((r.doc_id, r.text, r.lang, round(r._score, 3), r._keep) for r in score_quality(df, labels).collect())))
    assert all(abs(z - limit) > 2e-3 or z <= limit for _, z, limit in want)
    assert got == sorted(repr((*r, round(s, 3), z <= limit + 1e-3)) for r, (s, z, limit) in zip(rows, want))


def test_quantile_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(("a", "b")[k % 2], float(x)) for k, x in enumerate(rng.normal(0, 3, 4000))] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "_lang string, _z double")
    for q in (0.5, 0.9, 0.999, 1.0):
        got = {r._lang: (r._own, r._n) for r in quality.quantiles(df, q).collect()}
        for g in "abc":
            xs = sorted(z for lang, z in rows if lang == g)
            assert got[g] == (math.ceil(xs[math.ceil(q * len(xs)) - 1] * 1000) / 1000, len(xs))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", -1) for i, t, lang in rows], "doc_id long, text string, lang string, _score string, _keep int")


def test_junk_goes_and_the_rest_stays(spark):
    rng = np.random.default_rng(2)
    words = GOOD.split()
    good = [(k, " ".join(rng.permutation(words).tolist() * 3), ("en", "de", None)[k % 3]) for k in range(120)]
    junk = [(1000 + k, " ".join(rng.permutation([w.upper() + "!!&&" for w in words]).tolist() * 3), "en") for k in range(20)]
    odd = [(2000, None, "en"), (2001, "", "xx"), (2002, "The small river.", "en"), (0, good[0][1], "en"), (None, good[1][1], "en")]
    labels = spark.createDataFrame([(k, 1) for k in range(0, 120, 2)] + [(1000, 0), (1, None), (None, 1)], "doc_id long, quality int")
    df = frame(spark, good + junk + odd)
    kept = filter_quality(df, labels)
    assert kept.columns == df.columns and {(r["_score"], r["_keep"]) for r in kept.collect()} == {("s", -1)}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([k for k, *_ in good] + [2000, 2001, 2002, 0, -1])


def test_a_very_long_text_and_gibberish_of_another_script(spark):
    rng = np.random.default_rng(6)
    words = "река мост камень вода старый мельница тихий берег".split()
    text = lambda n: " ".join(rng.choice(words, n).tolist())
    rows = [(k, text(40), "ru") for k in range(80)] + [(1000, text(60_000), "ru"), (1001, "".join(rng.permutation(list(text(40))).tolist()), "ru")]
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int")
    kept = {r.doc_id for r in filter_quality(frame(spark, rows), labels).collect()}
    assert 1000 in kept and 1001 not in kept and len(kept & set(range(80))) >= 78


def test_without_trusted_documents_all_stay(spark):
    df = frame(spark, [(1, "a!!", "en"), (2, None, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert filter_quality(df, labels).count() == 2
    assert score_quality(df.where("false"), labels).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_separates_the_labels(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = {r.doc_id: r for r in entry.op9_quality(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good, bad = ([got[r.doc_id].keep for r in labels if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.995 and np.mean(bad) <= 0.1
